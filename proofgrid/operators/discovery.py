"""Merging provider results: first-wins dedupe, anti-joins, quotas and stamping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.text import tokens
from proofgrid.operators.address import _street_terms, address_text_match, house_token
from proofgrid.operators.policy import classify_source
from proofgrid.operators.ranking import first_by, join_back, top_k

# Providers in their fixed order, limits, and confidence per source class.
PROVIDER_ORDER = ["street", "commons", "openverse", "brave", "agent", "browser"]
PROVIDER_LIMITS = {"commons": 8, "openverse": 12, "brave": 20}
IMPORTING_PROVIDERS = ["street", "commons", "openverse"]
MAX_AUTOMATIC_IMPORTS = 6
SOURCE_CONFIDENCE = {"link": 0.22, "openverse": 0.24, "commons": 0.34, "street_far": 0.36, "web_search": 0.42,
                     "image_search": 0.46, "agent_link": 0.46, "street_facing": 0.48, "listing": 0.52,
                     "agent_import": 0.56}
OPERATOR_LINK_CONFIDENCE = 0.35
MAP_RECORD_CONFIDENCE = 0.68


def union_providers(parts: dict[str, DataFrame], enabled: dict[str, bool] | None = None) -> DataFrame:
    """Enabled providers stacked with their fixed rank."""
    frames = [
        df.withColumn("provider", F.lit(name)).withColumn("provider_rank", F.lit(PROVIDER_ORDER.index(name)))
        for name, df in parts.items() if enabled is None or enabled.get(name, True)
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def drop_known(df: DataFrame, known: DataFrame, *, case: str, url: str, known_urls: list[str]) -> DataFrame:
    """Rows whose URL is not an origin or download URL of stored evidence."""
    urls = known.select(case, F.explode(F.array_compact(F.array(*[F.col(c) for c in known_urls]))).alias(url))
    return df.join(urls.filter(F.col(url) != "").distinct(), [case, url], "left_anti")


def first_wins(df: DataFrame, *, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in input order."""
    return first_by(df, keys, order)


def last_value_first_place(df: DataFrame, *, keys: list[str], pos: str) -> DataFrame:
    """The last row per key, standing at the position of the first one."""
    rest = [c for c in df.columns if c not in keys and c != pos]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("__row"), F.min(pos).alias(pos))
    return agg.select(*keys, pos, "__row.*")


def limit_per_source(df: DataFrame, *, case: str, provider: str, order: list[Column],
                     limits: dict[str, int] = PROVIDER_LIMITS) -> DataFrame:
    """The first k results of each limited provider per case, all of the others."""
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    capped = F.col(provider).isin(list(limits))
    kept = top_k(df.filter(capped), [case, provider], order, max(limits.values()), "__r")
    kept = kept.filter(F.col("__r") <= F.try_element_at(limit, F.col(provider))).drop("__r")
    return kept.unionByName(df.filter(~capped))


def import_attempts(df: DataFrame, *, case: str, order: list[str], ok: Column,
                    quota: int = MAX_AUTOMATIC_IMPORTS) -> DataFrame:
    """Rows on which an import is tried: all up to the quota-th success.

    Only the first ``quota`` successes per case are ranked, so no case is
    gathered whole in one task.
    """
    place = F.struct(*order)
    wins = top_k(df.filter(ok), [case], [F.col(c) for c in order], quota, "__r").filter(F.col("__r") == quota)
    stops = wins.select(case, place.alias("__stop"))
    return join_back(df, stops, [case]).withColumn(
        "import_tried", F.coalesce(place <= F.col("__stop"), F.lit(True))).withColumn(
        "imported", F.col("import_tried") & ok).drop("__stop")


def stamp_link(df: DataFrame, *, url: str, tags: Column, score: Column) -> DataFrame:
    """A discovered link with its source policy, tags and confidence."""
    policy = classify_source(F.col(url))
    return df.withColumn("__p", policy).select(
        "*", F.col("__p.provider").alias("source_provider"), F.col("__p.rights").alias("rights"),
        F.col("__p.cache_policy").alias("cache_policy"), F.col("__p.redistributable").alias("redistributable"),
        F.array_distinct(F.concat(F.array(F.lit("automated-discovery"), F.lit("browser-reviewed")),
                                  F.coalesce(tags, F.array().cast("array<string>")))).alias("tags"),
        F.coalesce(score, F.lit(SOURCE_CONFIDENCE["link"])).alias("confidence_score")).drop("__p")


def stamp_open_image(licence: Column, provider: Column, address: Column, title: Column, url: Column) -> Column:
    """Rights, tags and confidence of an openly licensed image."""
    matched = address_text_match(address, F.concat_ws(" ", title, url))
    return F.struct(
        F.when(licence.isin("pdm", "cc0"), "public_domain").otherwise("open_license").alias("rights"),
        F.array(F.lit("automated-discovery"), F.lit("open-license"), F.lit("property-photo"),
                F.concat(F.lit("license:"), licence),
                F.when(matched, "address-text-match").otherwise("address-relevance-unverified")).alias("tags"),
        F.when(provider == "commons", SOURCE_CONFIDENCE["commons"])
        .otherwise(SOURCE_CONFIDENCE["openverse"]).alias("confidence_score"))


def run_summary(df: DataFrame, *, case: str, warning: Column | None = None) -> DataFrame:
    """Added and imported rows, providers that answered, warnings."""
    extra = [] if warning is None else [F.count_if(warning).alias("warnings")]
    return df.groupBy(case).agg(
        F.count(F.lit(1)).alias("added"), F.count_if("imported").alias("imported"),
        F.array_sort(F.collect_set("provider")).alias("providers"), *extra)


def text_search(requests: DataFrame, pages: DataFrame, *, request: str, address: str, page: str,
                text: Column) -> DataFrame:
    """(request, page) pairs that pass the address text match, without all pairs.

    A pair must share min(2, n) of the request's n street terms, so it shares
    one of any n-1 of them: the request's most frequent term is left out of the
    join keys (prefix filter), and the match itself is then verified.
    """
    want = requests.withColumn("__w", tokens(F.col(address))).withColumn("__h", house_token(F.col("__w"))) \
        .filter(F.col("__h").isNotNull()) \
        .withColumn("__t", F.array_distinct(_street_terms(F.col("__w"), F.col("__h"))))
    have = pages.withColumn("__text", text).withColumn("__w", tokens(F.col("__text"))) \
        .withColumn("__h", house_token(F.col("__w"))).filter(F.col("__h").isNotNull()) \
        .withColumn("__t", F.array_distinct(_street_terms(F.col("__w"), F.col("__h"))))
    have_terms = have.select(page, "__h", F.explode("__t").alias("__term"))
    frequency = have_terms.groupBy("__term").agg(F.count(F.lit(1)).alias("__df"))
    want_terms = want.select(request, "__h", F.size("__t").alias("__n"), F.explode("__t").alias("__term"))
    rated = want_terms.join(frequency, "__term", "left").withColumn("__df", F.coalesce("__df", F.lit(0)))
    common = rated.groupBy(request).agg(F.max(F.struct("__df", "__term"))["__term"].alias("__common"))
    keys = rated.join(common, request).filter((F.col("__n") == 1) | (F.col("__term") != F.col("__common")))
    pairs = keys.select(request, "__h", "__term").join(have_terms, ["__h", "__term"]).select(request, page).distinct()
    bare = want.filter(F.size("__t") == 0).select(request, "__h").join(have.select(page, "__h"), "__h") \
        .select(request, page)
    verified = pairs.unionByName(bare) \
        .join(requests.select(request, address), request).join(have.select(page, "__text"), page) \
        .filter(address_text_match(F.col(address), F.col("__text")))
    return verified.select(request, page)


def stamp_operator_link(df: DataFrame, *, url: str) -> DataFrame:
    """An operator's link with policy fields, pending review."""
    out = df.withColumn("__p", classify_source(F.col(url)))
    return out.select(
        *df.columns, F.col("__p.rights").alias("rights"), F.col("__p.cache_policy").alias("cache_policy"),
        F.col("__p.redistributable").alias("redistributable"), F.lit("pending").alias("validation"),
        F.lit(OPERATOR_LINK_CONFIDENCE).alias("confidence_score"))


def map_record() -> Column:
    """The stamp of a building record of the open map."""
    return F.struct(F.lit("map").alias("kind"), F.lit("open_license").alias("rights"),
                    F.lit("local_allowed").alias("cache_policy"), F.lit(True).alias("redistributable"),
                    F.lit("reachable").alias("validation"), F.lit(MAP_RECORD_CONFIDENCE).alias("confidence_score"))
