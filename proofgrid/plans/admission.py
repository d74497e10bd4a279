"""Admission checks: orders are upload batches, lines are files."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import admission as adm
from proofgrid.plans.registry import query

TYPES = ["image/jpeg", "image/png", "image/webp", "application/pdf", "text/html"]


def mime(k):
    return F.get(F.array(*[F.lit(m) for m in TYPES]), (k % 5).cast("int"))


@query("v01_type_allow_list", """
    select event_id, case event_id % 5 when 0 then '.jpg' when 1 then '.png' else '.webp' end as extension from events where event_id % 5 < 3""")
def v01(t):
    e = t.events.select("event_id", adm.file_extension(mime(F.col("event_id")), allow_pdf=False).alias("extension"))
    return e.filter("extension is not null")


@query("v02_file_signatures", "select doc_id, doc_id % 5 < 3 and doc_id % 2 = 0 as genuine from documents")
def v02(t):
    k = F.col("doc_id")
    head = F.when(k % 2 == 1, "00").when(k % 5 == 0, "FFD8").when(k % 5 == 1, "89504E470D0A1A0A") \
        .otherwise("52494646AABBCCDD57454250")
    content = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return t.documents.select("doc_id", adm.signature_matches(content, mime(k)).alias("genuine"))


@query("v03_batch_quota", """
    select l_orderkey, count(*) as files, round(sum(l_quantity), 2) as bytes, count(*) <= 5 and sum(l_quantity) <= 120 as accepted from lineitem group by l_orderkey""")
def v03(t):
    return adm.batch_quota(t.lineitem, batch="l_orderkey", size="l_quantity", max_files=5, max_bytes=120)


@query("v03_first_over_quota", """
    with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity
      rows unbounded preceding) run from lineitem)
    select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, run)) as l_partkey, round(min(run), 2) as running_bytes from r where run > 120 group by l_orderkey""")
def v03_first(t):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    out = adm.first_over_quota(t.lineitem, batch="l_orderkey", size="l_quantity", order=order, max_bytes=120,
                               slice_by=F.floor(F.col("l_linenumber") / 4))
    return out.select("l_orderkey", "l_partkey", F.round("running_bytes", 2).alias("running_bytes"))


PHOTO = """p as (select l.*, count(*) over (partition by l_orderkey) n, l_quantity / (l_discount * 100 + 10) ratio from lineitem l)"""
PROJ = """case when l_returnflag = 'R' then 'panorama_180' when n = 1 and ratio >= 1.85 then 'panorama_360' else 'perspective' end"""


def photos(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("width"),
                           (F.col("l_discount") * 100 + 10).alias("height"),
                           F.when(F.col("l_returnflag") == "R", "panorama_180").otherwise("auto").alias("requested"))
    return adm.resolve_projection(df, batch="l_orderkey", requested="requested", width="width", height="height")


@query("v04_projections", f"with {PHOTO} select {PROJ} as projection, count(*) as photos from p group by 1")
def v04(t):
    return photos(t).groupBy("projection").agg(F.count(F.lit(1)).alias("photos"))


@query("v05_capture_info", f"""
    with {PHOTO} select l_orderkey, l_linenumber, l_partkey, l_suppkey, case {PROJ} when 'panorama_360' then 360 when 'panorama_180' then 180 else 62 end::int as coverage_degrees,
      case when l_returnflag = 'R' then 'operator' when {PROJ} = 'panorama_360' then 'aspect_ratio' else 'default' end as projection_source,
      (l_linenumber - 1)::int as capture_order from p""")
def v05(t):
    info = adm.capture_info(F.col("projection"), F.col("l_linenumber") - 1, F.col("l_orderkey").cast("string"),
                            F.col("width").cast("int"), F.col("height").cast("int"), F.col("requested"))
    out = photos(t).withColumn("i", info)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "i.coverage_degrees", "i.projection_source", "i.capture_order")


@query("v06_panorama_shapes", f"""
    with {PHOTO}, q as (select *, {PROJ} proj from p)
    select case when proj = 'panorama_180' and (ratio < 0.9 or ratio > 1.1) then 'half_sphere_needs_1_to_1'
      when proj = 'panorama_360' and (ratio < 1.9 or ratio > 2.1) then 'full_sphere_needs_2_to_1' end as problem,
      case when l_quantity * 20 < 128 or (l_discount * 100 + 10) * 20 < 64 then 'too_small' when ratio between 0.9 and 1.1 then null when ratio < 1.2 then 'not_landscape' end as worker_problem,
      count(*) as photos from q group by all""")
def v06(t):
    p = photos(t).select(adm.panorama_problem(F.col("projection"), F.col("width"), F.col("height")).alias("problem"),
                         adm.worker_panorama_problem(F.col("width") * 20, F.col("height") * 20).alias("worker_problem"))
    return p.groupBy("problem", "worker_problem").agg(F.count(F.lit(1)).alias("photos"))


@query("v07_oriented_sizes", """
    select p_partkey, (case when p_partkey % 9 between 5 and 8 then p_partkey else p_size end)::bigint as width,
      (case when p_partkey % 9 between 5 and 8 then p_size else p_partkey end)::bigint as height from part""")
def v07(t):
    w, h = adm.oriented_size(F.col("p_size").cast("bigint"), F.col("p_partkey"), F.col("p_partkey") % 9)
    return t.part.select("p_partkey", w.alias("width"), h.alias("height"))


@query("v08_page_likeness", """
    with px as (select l_suppkey, 255 - l_quantity / 2 as r, 250 - l_quantity / 2 as g, 245.0 - l_discount * 100 as b, floor(l_quantity / 10) as grey from lineitem),
    h as (select l_suppkey, grey, count(*) c from px group by all),
    n as (select l_suppkey, -sum(c / t * log2(c / t)) entropy from (select *, sum(c) over (partition by l_suppkey)::double t from h) group by 1),
    s as (select l_suppkey, (avg(r) + avg(g) + avg(b)) / 3 mean, greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b)) spread,
      (stddev_samp(r) + stddev_samp(g) + stddev_samp(b)) / 3 dev from px group by 1)
    select l_suppkey, round(mean, 4) as mean, round(spread, 4) as spread, round(dev, 4) as deviation, round(entropy, 4) as entropy,
      mean >= 215 and spread <= 22 and dev between 8 and 65 and entropy between 0.5 and 4.6 as page_like from s join n using (l_suppkey)""")
def v08(t):
    px = t.lineitem.select("l_suppkey", (F.lit(255) - F.col("l_quantity") / 2).alias("r"), (F.lit(250) - F.col("l_quantity") / 2).alias("g"),
                           (F.lit(245.0) - F.col("l_discount") * 100).alias("b"), F.floor(F.col("l_quantity") / 10).alias("grey"))
    out = adm.page_likeness(px, image="l_suppkey", channels=("r", "g", "b"), grey="grey")
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("mean", "spread", "deviation", "entropy")], "page_like")


def digests(t, changed=False):
    text = F.col("text")
    if changed:
        text = F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    return t.documents.select("doc_id", "source", F.sha2(text, 256).alias("digest"))


@query("v09_digest_reconciliation", """
    select source, bool_and(doc_id % 13 <> 0 and doc_id % 17 <> 0) as verified, count(*) filter (doc_id % 17 <> 0) as found from documents group by source""")
def v09(t):
    actual = digests(t, True).filter(F.col("doc_id") % 17 != 0)
    checked = adm.reconcile_digests(digests(t), actual.drop("source"), key="doc_id", digest="digest")
    found = checked.groupBy("source").agg(F.count_if("exists").alias("found"))
    return adm.all_match(checked, job="source").join(found, "source")


@query("v10_job_problems", """
    select o_orderkey, array_to_string(list_filter([case when o_orderkey % 10 = 0 then 'bad_identifier' end, case when o_orderkey % 7 = 0 then 'bad_digest' end,
      case when o_orderkey % 4 = 2 and o_orderkey % 5 = 0 then 'counts_differ' end, case when o_orderkey % 4 = 2 and o_orderkey % 3 = 0 then 'needs_two_inputs' end,
      case when o_orderkey % 4 = 3 then 'floor_number_per_plan' end, case when o_orderkey % 4 in (0, 1) and o_orderkey % 11 = 0 then 'digests_only_for_grouped' end],
      lambda x: x is not null), ',') as problems from orders""")
def v10(t):
    k = F.col("o_orderkey")
    mode = F.get(F.array(F.lit("single_image"), F.lit("panorama"), F.lit("multi_image"), F.lit("floorplan")), (k % 4).cast("int"))
    digest = F.when(k % 7 == 0, "zz").otherwise(F.sha2(k.cast("string"), 256))
    grouped = k % 4 >= 2
    two = ~((k % 4 == 2) & (k % 3 == 0))
    paths = F.when(two, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    ids = F.transform(paths, lambda p: F.concat(F.lit("evidence_"), p))
    ids = F.when((k % 4 == 2) & (k % 5 == 0), F.concat(ids, F.array(F.lit("evidence_z")))).otherwise(ids)
    shas = F.transform(paths, lambda p: digest)
    cols = {"job_id": F.when(k % 10 == 0, "x!").otherwise(F.concat(F.lit("job_0000"), k.cast("string"))), "mode": mode,
            "input_sha256": digest, "input_paths": F.when(grouped, paths), "evidence_ids": F.when(grouped, ids),
            "input_sha256s": F.when(grouped, shas).when(k % 11 == 0, F.array(digest)),
            "floor_numbers": F.when(k % 4 == 3, F.array(F.lit(1)))}
    return t.orders.select("o_orderkey", F.array_join(adm.job_problems(cols), ",").alias("problems"))


@query("v11_range_rules", """
    with p as (select *, concat_ws(',', case when l_quantity > 45 then 'quantity' end, case when l_discount > 0.09 then 'discount' end,
      case when l_returnflag not in ('A', 'R') then 'flag' end) problems from lineitem)
    select problems, count(*) as rows, problems = '' as valid from p group by problems""")
def v11(t):
    rules = [(F.col("l_quantity") > 45, "quantity"), (F.col("l_discount") > 0.09, "discount"),
             (~F.col("l_returnflag").isin("A", "R"), "flag")]
    good, bad = adm.split_valid(adm.validate(t.lineitem, rules))
    parts = [df.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("valid", F.lit(ok)) for df, ok in ((good, True), (bad, False))]
    return parts[0].unionByName(parts[1])


@query("v12_id_sets", """
    with s as (select l_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) ids from lineitem group by 1)
    select l_orderkey, array_to_string(ids, '|') as signature, ids = ['AF'] as only_af from s""")
def v12(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("ids"))
    return sets.select("l_orderkey", F.translate(adm.id_signature(F.col("ids")), "\0", "|").alias("signature"),
                       adm.same_id_set(adm.id_set(F.col("ids")), F.array(F.lit("AF"))).alias("only_af"))


@query("v14_drifted_inputs", "select doc_id from documents where doc_id % 13 = 0")
def v14(t):
    return adm.drifted(digests(t), digests(t, True), key="doc_id", digest="digest").select("doc_id")


@query("v15_confidence", """
    select user_id, count(*)::int as source_count, round(least(1, count(*) / 100.0), 6) as score, 'estimated' as band, 0.0::double as unknown_score from events group by user_id""")
def v15(t):
    g = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("now"))
    c = adm.confidence(F.least(F.lit(1.0), F.col("n") / 100), "estimated", "observed", "events seen", F.col("n"), F.col("now"))
    u = adm.unknown_confidence("nothing known", F.col("now"))
    return g.select("user_id", c["source_count"].alias("source_count"), F.round(c["score"], 6).alias("score"),
                    c["band"].alias("band"), u["score"].alias("unknown_score"))
