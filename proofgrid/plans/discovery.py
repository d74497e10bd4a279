"""Provider merges: customers, suppliers and parts act as three providers of links."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import discovery as dis
from proofgrid.plans.registry import query


def link(key, case):
    url = F.concat(F.lit("https://example.org/"), (key % 37).cast("string"), F.lit("/"), F.floor(key / 700).cast("string"))
    return case.cast("int").alias("case_id"), key.alias("pos"), url.alias("url")


def providers(t):
    return {
        "street": t.supplier.select(*link(F.col("s_suppkey"), F.col("s_nationkey")), F.col("s_name").alias("title")),
        "commons": t.customer.select(*link(F.col("c_custkey"), F.col("c_nationkey")), F.col("c_name").alias("title")),
        "brave": t.part.select(*link(F.col("p_partkey"), F.col("p_size") % 25), F.col("p_name").alias("title")),
    }


def known(t):
    k = F.col("s_suppkey")
    case, _, url = link(k * 3, F.col("s_nationkey"))
    download = F.concat(F.lit("https://example.org/1/"), (k % 5).cast("string"))
    return t.supplier.filter("s_acctbal < 0").select(case, url.alias("origin_url"), download.alias("download_url"))


LINKS = """
    l as (select s_nationkey::int case_id, s_suppkey pos, 'https://example.org/' || s_suppkey % 37 || '/' || s_suppkey // 700 url, s_name title, 'street' provider, 0 rank from supplier
      union all select c_nationkey::int, c_custkey, 'https://example.org/' || c_custkey % 37 || '/' || c_custkey // 700, c_name, 'commons', 1 from customer
      union all select (p_size % 25)::int, p_partkey, 'https://example.org/' || p_partkey % 37 || '/' || p_partkey // 700, p_name, 'brave', 3 from part),
    kn as (select s_nationkey::int case_id, 'https://example.org/' || (s_suppkey * 3) % 37 || '/' || (s_suppkey * 3) // 700 url from supplier where s_acctbal < 0
      union select s_nationkey::int, 'https://example.org/1/' || s_suppkey % 5 from supplier where s_acctbal < 0),
    fresh as (select * from l where not exists (select 1 from kn where kn.case_id = l.case_id and kn.url = l.url)),
    f as (select * from (select *, row_number() over (partition by case_id, url order by rank, pos) rn from fresh) where rn = 1)"""


def merged(t):
    rows = dis.union_providers(providers(t))
    fresh = dis.drop_known(rows, known(t), case="case_id", url="url", known_urls=["origin_url", "download_url"])
    return dis.first_wins(fresh, keys=["case_id", "url"], order=[F.col("provider_rank"), F.col("pos")])


@query("d01_provider_union", f"with {LINKS} select provider, rank::int as provider_rank, count(*) as links from l where provider <> 'commons' group by all")
def d01(t):
    rows = dis.union_providers(providers(t), {"commons": False})
    return rows.groupBy("provider", "provider_rank").agg(F.count(F.lit(1)).alias("links"))


@query("d02_new_links", f"with {LINKS} select case_id, url, provider, pos from f")
def d02(t):
    return merged(t).select("case_id", "url", "provider", "pos")


@query("d03_first_wins", f"""
    with {LINKS} select case_id, url, min(pos) as pos from l where provider = 'brave' group by case_id, url""")
def d03(t):
    return dis.first_wins(providers(t)["brave"], keys=["case_id", "url"], order=[F.col("pos")]) \
        .select("case_id", "url", "pos")


@query("d04_last_value_first_place", f"""
    with {LINKS} select case_id, url, min(pos) as pos, arg_max(title, pos) as title from l where provider = 'brave' group by case_id, url""")
def d04(t):
    return dis.last_value_first_place(providers(t)["brave"], keys=["case_id", "url"], pos="pos") \
        .select("case_id", "url", "pos", "title")


@query("d05_provider_limits", f"""
    with {LINKS}, k as (select *, row_number() over (partition by case_id, provider order by pos) r from f)
    select case_id, provider, pos from k where provider = 'street' or r <= case provider when 'commons' then 8 else 20 end""")
def d05(t):
    return dis.limit_per_source(merged(t), case="case_id", provider="provider", order=[F.col("pos")]) \
        .select("case_id", "provider", "pos")


TRIED = LINKS + """,
    o as (select *, pos % 3 = 0 as ok, coalesce(sum(case when pos % 3 = 0 then 1 else 0 end) over (partition by case_id
      order by rank, pos, url rows between unbounded preceding and 1 preceding), 0) wins from f where provider in ('street', 'commons'))"""


def tried(t):
    rows = merged(t).filter(F.col("provider").isin(dis.IMPORTING_PROVIDERS))
    return dis.import_attempts(rows, case="case_id", order=["provider_rank", "pos", "url"], ok=F.col("pos") % 3 == 0)


@query("d06_import_quota", f"""
    with {TRIED} select case_id, provider, pos, wins < 6 as import_tried, wins < 6 and ok as imported from o""")
def d06(t):
    return tried(t).select("case_id", "provider", "pos", "import_tried", "imported")


@query("d07_stamped_links", """
    select page_id, regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www[.]', '') as source_provider,
      'research_unknown' as rights, false as redistributable, 3::bigint as tags,
      case when page_id % 2 = 0 then 0.52 else 0.22 end as confidence_score, 'license:by' as licence_tag from pages""")
def d07(t):
    score = F.when(F.col("page_id") % 2 == 0, dis.SOURCE_CONFIDENCE["listing"])
    out = dis.stamp_link(t.pages.select("page_id", "url"), url="url",
                         tags=F.array(F.lit("listing-source"), F.lit("browser-reviewed")), score=score)
    image = dis.stamp_open_image(F.lit("by"), F.lit("commons"), F.col("url"), F.lit(""), F.col("url"))
    return out.select("page_id", "source_provider", "rights", "redistributable",
                      F.size("tags").cast("bigint").alias("tags"), "confidence_score",
                      F.element_at(image["tags"], 4).alias("licence_tag"))


@query("d08_run_summary", f"""
    with {TRIED} select case_id, count(*) as added, count(*) filter (wins < 6 and ok) as imported,
      count(*) filter (not ok) as warnings, string_agg(distinct provider, ',' order by provider) as providers from o group by case_id""")
def d08(t):
    out = dis.run_summary(tried(t), case="case_id", warning=F.col("pos") % 3 != 0)
    return out.withColumn("providers", F.array_join("providers", ","))


@query("d09_text_search", """
    with r as (select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey),
    p as (select c_custkey, c_custkey // 15 as house, n_name, lower(c_mktsegment) seg from customer join nation on c_nationkey = n_nationkey)
    select s_suppkey, c_custkey from r join p on s_suppkey = house and r.n_name = p.n_name and seg = 'building'""")
def d09(t):
    n = t.nation
    requests = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(
            F.col("s_suppkey").cast("string"), F.lit(" Building "), F.translate("n_name", "_0123456789", "xabcdefghij"),
            F.lit(" Street")).alias("address"))
    pages = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(
        " ", F.lit("Home for sale:"), F.floor(F.col("c_custkey") / 15).cast("string"),
        F.translate("n_name", "_0123456789", "xabcdefghij"),
        F.col("c_mktsegment")).alias("title"))
    return dis.text_search(requests, pages, request="s_suppkey", address="address", page="c_custkey", text=F.col("title"))


@query("d10_operator_links", """
    select page_id, 'metadata_only' as cache_policy, 'pending' as validation, 0.35 as confidence_score, 0.68 as map_score from pages""")
def d10(t):
    out = dis.stamp_operator_link(t.pages.select("page_id", "url"), url="url")
    return out.select("page_id", "cache_policy", "validation", "confidence_score",
                      dis.map_record()["confidence_score"].alias("map_score"))
