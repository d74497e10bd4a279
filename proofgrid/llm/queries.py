"""The dealt operators bound to the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import (
    bpe_chunks, collocations, conversations, decontaminate, exact_dedup, html_text, language, near_dup, packing, pii,
    sharding, url_filter, warc,
)
from proofgrid.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return language.identify(docs.withColumn("held_out", held_out), train=~held_out, columns=["doc_id", "held_out"],
                             with_spans=False)


def _url_log(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts, domains and first path segments of the pages."""
    urls = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"),
                        url_filter.path_of(F.col("url")).alias("path")).filter("host <> ''")
    values = urls.select("page_id", F.inline(F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("value")),
        F.struct(F.lit("prefix").alias("kind"),
                 F.concat("host", F.regexp_extract("path", "^(/[^/]*/)", 1)).alias("value"))))) \
        .filter("value <> '' and (kind <> 'prefix' or value like '%/')")
    firsts = values.groupBy("kind", "value").agg(F.min("page_id").alias("m"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("action")) for i, a in
                      enumerate(("add", "remove", "add"))])
    return firsts.withColumn("step", F.explode(steps)).filter("step.i = 0 or m % (2 * step.i) = 0").select(
        "kind", "value", "step.action",
        F.when((F.col("m") + F.col("step.i")) % 3 == 0, "allow").otherwise("block").alias("verdict"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("m") * 13) % 300 + F.col("step.i") * 45).cast("int")).alias("at"))


@query("op2_url_filter", """
    with hosted as (
        select page_id, url, cast('2024-01-01' as date) + cast(page_id * 37 % 366 as int) as fetched_on,
               lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) as host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages),
    named as (
        select 'host' as kind, host as value, page_id from hosted where host <> ''
        union all select 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1), page_id from hosted where host <> ''
        union all select 'prefix', host || regexp_extract(path, '^(/[^/]*/)', 1), page_id from hosted where host <> ''),
    firsts as (
        select kind, value, min(page_id) as m from named
        where value <> '' and (kind <> 'prefix' or value like '%/') group by all),
    log as (
        select kind, lower(value) as value, if(i = 1, 'remove', 'add') as action,
               if((m + i) % 3 = 0, 'allow', 'block') as verdict,
               cast('2024-01-01' as date) + cast(m * 13 % 300 + i * 45 as int) as since
        from firsts, range(3) t(i) where i = 0 or m % (2 * i) = 0),
    held as (
        select *, lead(since, 1, date '9999-12-31') over (partition by kind, value order by since) as until from log),
    active as (
        select page_id, h.verdict, h.value,
               case kind when 'prefix' then 1 + length(h.value) - length(replace(h.value, '/', '')) when 'host' then 1
                    else -1 - (length(host) - length(replace(host, '.', ''))
                               - length(h.value) + length(replace(h.value, '.', ''))) end as rank
        from hosted c join held h on h.action = 'add' and c.fetched_on >= h.since and c.fetched_on < h.until
         and case kind when 'host' then host = h.value
                       when 'domain' then host = h.value or ends_with(host, '.' || h.value)
                       else starts_with(host || path, h.value) end
        where host <> ''),
    best as (
        select page_id, count(*) as n_active, arg_max(verdict, rank * 2 + (verdict = 'block')::int) as verdict,
               arg_max(value, rank * 2 + (verdict = 'block')::int) as matched from active group by page_id)
    select page_id, url, fetched_on, coalesce(n_active, 0) as n_active, matched, coalesce(verdict, 'none') as verdict
    from hosted left join best using (page_id)
""")
def judged_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return url_filter.judge(pages.withColumn("fetched_on", fetched), _url_log(pages))


@query("op3_exact_dedup", """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window g as (partition by coalesce(text, ''))
""")
def exact_dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op4_warc", """
    with sized as (
        select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes,
               ('0x' || sha1(coalesce(html, ''))) as hex, min(page_id) over (partition by coalesce(html, '')) as first
        from pages)
    select page_id, payload_bytes,
           (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    (((strpos('0123456789abcdef', substr(hex, 3 + 5 * (k // 4) + 0, 1)) - 1) * 65536
                    + (strpos('0123456789abcdef', substr(hex, 3 + 5 * (k // 4) + 1, 1)) - 1) * 4096
                    + (strpos('0123456789abcdef', substr(hex, 3 + 5 * (k // 4) + 2, 1)) - 1) * 256
                    + (strpos('0123456789abcdef', substr(hex, 3 + 5 * (k // 4) + 3, 1)) - 1) * 16
                    + strpos('0123456789abcdef', substr(hex, 3 + 5 * (k // 4) + 4, 1)) - 1)
                    // (32 ** (3 - k % 4))::int) % 32 + 1, 1), '' order by k) from range(32) t(k)) as payload_digest,
           if(page_id = first, 'response', 'revisit') as record_type,
           if(page_id = first, null, first) as refers_to
    from sized
""")
def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    pages = table(spark, folder, "pages")
    warc.write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    records = warc.read_warc(spark, path, {"payload_bytes": lambda p: F.octet_length(p).cast("bigint"),
                                           "payload_digest": warc.sha1_base32})
    return warc.with_referred(records, ["payload_bytes", "payload_digest"]).select(
        warc.urn_id(F.col("id"), kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), warc.urn_id(F.col("refers_to"), kind).alias("refers_to"))


@query("op5_sharding", """
    with hashed as (
        select doc_id, strlen(coalesce(text, '')) as n_bytes, md5(doc_id::varchar) as h, md5(coalesce(text, '')) as g
        from documents),
    bits as (
        select doc_id, n_bytes, (select string_agg(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000',
            '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, k + 1, 1))],
            '' order by k) from range(8) t(k)) as b from hashed),
    sums as (
        select substr(b, 1, d) as shard, d, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows
        from bits, range(33) t(d) group by all having shard_bytes <= 1048576 or shard_rows = 1)
    select doc_id, n_bytes, shard, shard_bytes, shard_rows from (
        select *, row_number() over (partition by doc_id order by d) as r
        from bits join sums on substr(b, 1, d) = shard) where r = 1
""")
def sharded_documents(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place_rows(table(spark, folder, "documents"), limit=1 << 20)


def _listed(spans, parts=("kind", "start", "end")):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[p].cast("string") for p in parts])), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@query("op6_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), F.col("spans.score").alias("scores"))


@query("op7_best_fit_packing")
def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op8_minhash_near_dup")
def near_duplicate_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), width=3, ratio=(85, 100))


@query("op9_decontamination")
def contaminated_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["past"] - r["first"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"))


@query("op10_html_extraction")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"), ["page_id", "url"])


@query("op11_conversation_repair")
def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    talks, copies = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.repair(talks, copies=copies)


@query("op12_collocations", r"""
    with pieces as (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    worded as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), w -> w <> '') as w from pieces),
    totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
    placed as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from worded, range(1, 6) t(k) where len(w) >= k),
    f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from placed group by all having f >= 100),
    longer as (
        select s.lang, s.phrase, max(l.f) as f from f s join f l on l.lang = s.lang and l.k = s.k + 1
         and (starts_with(l.phrase, s.phrase || ' ') or ends_with(l.phrase, ' ' || s.phrase)) where s.k > 1 group by all),
    kept as (
        select f.lang, f.phrase, f.f as a, f.k, string_split(f.phrase, ' ') as w from f
        left join longer using (lang, phrase) where f.k > 1 and coalesce(longer.f, 0) < f.f),
    cuts as (select *, unnest(range(1, k)) as j from kept),
    scored as (
        select c.lang, c.phrase, c.a, x.f as l, y.f as r, n, j,
               ((1000 * c.a::hugeint * n) // (x.f::hugeint * y.f))::bigint as score
        from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ')
        join f y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:], ' ') join totals on totals.lang = c.lang),
    lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from lowest qualify rank <= 2000
""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


@query("op13_bpe_chunks")
def bpe_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe_chunks.encode(table(spark, folder, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries of this subpackage, the pipeline included, and their SQL."""
    import corpus_pipeline

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLES, **sql}
