"""URL and rights policy on ``pages``: hosts are varied so that every rule is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import policy as pol
from proofgrid.plans.registry import query

HOSTS = ["www.youtube.com", "maps.google.com", "m.facebook.com", "zillow.com", "www.redfin.com",
         "tile.openstreetmap.org", "www.loc.gov", "notyoutube.com"]


def links(t):
    """Pages whose host is replaced for eight of nine page numbers."""
    pick = F.get(F.array(*[F.lit(h) for h in HOSTS]), (F.col("page_id") % 9).cast("int"))
    url = F.when(pick.isNull(), F.col("url")).otherwise(F.concat(F.lit("https://"), pick, F.lit("/p?id="),
                                                                 F.col("page_id").cast("string")))
    return t.pages.select("page_id", url.alias("link"), "url", "html")


LINKS = """
    links as (select page_id, url, html, page_id % 9 as k, case page_id % 9 when 0 then 'https://www.youtube.com'
      when 1 then 'https://maps.google.com' when 2 then 'https://m.facebook.com' when 3 then 'https://zillow.com'
      when 4 then 'https://www.redfin.com' when 5 then 'https://tile.openstreetmap.org' when 6 then 'https://www.loc.gov'
      when 7 then 'https://notyoutube.com' end || '/p?id=' || page_id as link,
      regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www[.]', '') own_host from pages)"""


@query("u01_source_policy", f"""
    with {LINKS} select page_id, case k when 0 then 'YouTube' when 1 then 'Google' when 2 then 'm.facebook.com'
      when 3 then 'Zillow' when 4 then 'Redfin' when 5 then 'OpenStreetMap' when 6 then 'loc.gov'
      when 7 then 'notyoutube.com' else own_host end provider,
      case when k in (0,1,3,4) then 'link_only' when k = 2 then 'restricted' when k = 5 then 'open_license'
           when k = 6 then 'public_domain' else 'research_unknown' end rights,
      case when k in (0,1) then 'prohibited' when k in (5,6) then 'local_allowed' else 'metadata_only' end cache_policy,
      k in (5,6) redistributable, k in (0,1,3,4) hard_blocked from links""")
def u01(t):
    return links(t).select("page_id", pol.classify_source(F.col("link")).alias("p")).select("page_id", "p.*")


@query("u02_suffix_rules", """
    with h as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) host from pages),
    r(suffix, priority, verdict) as (values ('cheap-pills.example.com', 0, 'spam'), ('example.org', 1, 'org'), ('example.com', 2, 'com'))
    select page_id, arg_min(verdict, priority) verdict from h join r on host = suffix or ends_with(host, '.' || suffix) group by page_id""")
def u02(t):
    rules = t.region.filter("r_regionkey < 3").select(
        F.get(F.array(F.lit("cheap-pills.example.com"), F.lit("example.org"), F.lit("example.com")),
              F.col("r_regionkey")).alias("suffix"), F.col("r_regionkey").alias("priority"),
        F.get(F.array(F.lit("spam"), F.lit("org"), F.lit("com")), F.col("r_regionkey")).alias("verdict"))
    out = pol.classify_with_table(t.pages.select("page_id", "url"), rules, url="url", key="page_id")
    return out.filter("rule is not null").select("page_id", F.col("rule.verdict").alias("verdict"))


@query("u03_http_links", """
    select page_id, page_id % 4 <> 0 and page_id % 4 <> 1 as remote from pages""")
def u03(t):
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://"), F.substring_index("url", "://", -1))) \
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("not a url "), F.col("url"))).otherwise(F.col("url"))
    return t.pages.select("page_id", pol.is_http(u).alias("remote"))


@query("u04_redirect_targets", "select page_id, url as target from pages")
def u04(t):
    code = F.translate(F.base64(F.col("url").cast("binary")), "+/=\r\n", "-_")
    wrapped = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), code))
    return t.pages.select("page_id", pol.unwrap_redirect(wrapped).alias("target"))


@query("u05_external_and_listing", f"""
    with {LINKS} select page_id, true as external, k in (3, 4) as listing from links""")
def u05(t):
    return links(t).select("page_id", pol.is_external(F.col("link")).alias("external"),
                           pol.is_listing(F.col("link")).alias("listing"))


@query("u06_allowed_navigation", f"with {LINKS} select page_id from links where k not in (0, 1, 3, 4)")
def u06(t):
    return links(t).filter(pol.allowed_navigation(F.col("link"))).select("page_id")


@query("u07_reserved_addresses", """
    with a as (select event_id, event_id % 256 a, (event_id // 7) % 256 b from events)
    select event_id, case when event_id % 10 = 0 then true when event_id % 10 = 1 then false
      else a in (0,10,127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254)
        or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) end as reserved from a""")
def u07(t):
    e = F.col("event_id")
    v4 = F.concat_ws(".", (e % 256).cast("string"), (F.floor(e / 7) % 256).cast("string"), F.lit("3"), F.lit("4"))
    ip = F.when(e % 10 == 0, F.when(e % 20 == 0, "fe80::1").otherwise("no address")) \
        .when(e % 10 == 1, "2001:db8::1").when(e % 10 == 2, F.concat(F.lit("::ffff:"), v4)).otherwise(v4)
    return t.events.select("event_id", pol.is_private_ip(ip).alias("reserved"))


@query("u08_licence_codes", """
    select p_partkey, case p_partkey % 7 when 0 then 'pdm' when 1 then 'cc0' when 2 then 'by-sa' when 3 then 'by' end as licence
    from part""")
def u08(t):
    labels = ["Public domain", "CC0", "CC BY-SA 4.0", "CC BY 2.0", "CC BY-NC 2.0", "CC BY-ND 4.0", "GFDL"]
    label = F.get(F.array(*[F.lit(v) for v in labels]), (F.col("p_partkey") % 7).cast("int"))
    return t.part.select("p_partkey", pol.licence_code(F.lower(F.regexp_replace(label, " ", "-")), label).alias("licence"))


@query("u09_licence_allowed", "select p_type as licence, count(*) as parts from part where p_partkey % 5 < 4 group by p_type")
def u09(t):
    code = F.get(F.array(*[F.lit(v) for v in (" BY", "cc0", "pdm", "by-sa", "by-nc")]), (F.col("p_partkey") % 5).cast("int"))
    return t.part.filter(pol.licence_allowed(code)).groupBy(F.col("p_type").alias("licence")) \
        .agg(F.count(F.lit(1)).alias("parts"))


@query("u10_clean_metadata", r"""
    with c as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&quot;', '"', 'g'),
      '(?i)&#0*39;|&apos;', '''', 'g'), '[\s\pZ]+', ' ', 'g')) t from pages)
    select page_id, nullif(t, '') as text, trim(regexp_replace(regexp_replace(url, '[^\pL\pN\s]', ' ', 'g'), '[\s\pZ]+', ' ', 'g')) as words from c""")
def u10(t):
    return t.pages.select("page_id", pol.clean_metadata(F.col("html"), 2_000_000_000).alias("text"),
                          pol.search_query(F.col("url")).alias("words"))


@query("u11_import_eligible", f"""
    with {LINKS} select page_id from links where k in (5, 6) and page_id % 2 = 0""")
def u11(t):
    l = links(t).withColumn("p", pol.classify_source(F.col("link")))
    download = F.when(F.col("page_id") % 2 == 0, F.col("link"))
    return l.filter(pol.import_eligible(l.p.cache_policy, l.p.rights, download, l.p.hard_blocked)).select("page_id")


@query("u12_link_kinds", """
    select p_partkey, case p_partkey % 4 when 0 then 'blueprint' when 1 then 'record' when 2 then 'record' else 'web_page' end as kind from part""")
def u12(t):
    note = F.get(F.array(F.lit("Floor Plan of a record"), F.lit("County Assessor"), F.lit("public RECORDS"), F.lit("")),
                 (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", pol.link_kind(F.col("p_name"), note).alias("kind"))


@query("u13_page_images", f"""
    with {LINKS} select page_id from links where k not in (0, 1, 3, 4) and page_id % 5 <> 0""")
def u13(t):
    l = links(t)
    address = F.concat((F.col("page_id") + 1).cast("string"), F.lit(" Oakfield Terrace"))
    title = F.concat((F.col("page_id") + 1).cast("string"), F.lit(" OAKFIELD terrace "), F.col("url"))
    width = F.when(F.col("page_id") % 5 == 0, 200).otherwise(640)
    return l.filter(pol.page_image_admitted(l.link, F.concat(l.url, F.lit("x.jpg")), width, F.lit(480), address,
                                            title, l.html)).select("page_id")


@query("u14_same_url", "select page_id, page_id % 3 <> 2 as same from pages")
def u14(t):
    u = F.col("url")
    other = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(u, "^http(s?)://", "HTTP$1://")) \
        .when(F.col("page_id") % 3 == 1, u).otherwise(F.concat(u, F.lit("/more")))
    return t.pages.select("page_id", pol.same_url(u, other).alias("same"))


@query("u15_exportable", f"with {LINKS} select page_id, link from links where k in (5, 6)")
def u15(t):
    l = links(t).withColumn("redistributable", pol.classify_source(F.col("link"))["redistributable"])
    return pol.exportable(l, redistributable="redistributable").select("page_id", "link")
