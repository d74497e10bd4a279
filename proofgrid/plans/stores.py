"""Logs, documents, files and exports on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofgrid.functions.text import natural_key
from proofgrid.operators.ranking import first_by
from proofgrid.plans.registry import query
from proofgrid.session import ensure_checkpoint_dir
from proofgrid.sources import stores


def scratch(t):
    """A fresh folder under the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("s01_entity_scan", """
    select user_id, event_id, (props->>'k')::int as k from events where user_id = 7""")
def s01(t):
    log = t.events.select("user_id", "event_id", F.col("props").alias("payload"))
    return stores.scan_entities(log, "k int", where=F.col("user_id") == 7)


@query("s02_keyed_lookup", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 4711")
def s02(t):
    return stores.lookup(t.orders, "o_orderkey", 4711).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s03_latest_entities", """
    select user_id, arg_min(event_id, (ts, event_id)) as created_at, arg_max(event_id, (ts, event_id)) as updated_at,
      arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by user_id""")
def s03(t):
    return stores.latest_entities(t.events, key="user_id", seq=["ts", "event_id"], payload=["event_type", "value"],
                                  created="event_id", stamp="event_id")


@query("s04_cascade_delete", """
    with gone as (select c_custkey from customer where c_acctbal < 0)
    select 'orders' as child, count(*) as rows from orders where o_custkey not in (select c_custkey from gone)
    union all select 'customer', count(*) from customer where c_custkey not in (select c_custkey from gone)""")
def s04(t):
    children = {"orders": t.orders.withColumnRenamed("o_custkey", "c_custkey"), "customer": t.customer}
    left = stores.cascade_delete(children, t.customer.filter("c_acctbal < 0"), case="c_custkey")
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("child"), "rows")
              for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("s05_workspace_pages", """
    with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as rn from orders),
    e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events),
    op as (select o_custkey k, rn // 10 page, count(*) orders, min(o_orderkey) first_order from o group by all),
    ep as (select user_id k, rn // 10 page, count(*) events from e group by all),
    p as (select coalesce(op.k, ep.k) k, coalesce(op.page, ep.page) page, orders, first_order, events
          from op full join ep on op.k = ep.k and op.page = ep.page)
    select c_custkey, coalesce(page, 0)::bigint as page, coalesce(orders, 0) as orders, first_order, coalesce(events, 0) as events
    from customer left join p on p.k = c_custkey""")
def s05(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    events = t.events.select(F.col("user_id").alias("c_custkey"), "event_id", "ts")
    pages = stores.workspace_pages(t.customer.select("c_custkey"), {
        "orders": (orders, [F.col("o_orderdate"), F.col("o_orderkey")], F.to_date("o_orderdate")),
        "events": (events, [F.col("ts"), F.col("event_id")], F.to_date("ts")),
    }, case="c_custkey", page_size=10)
    def size(c):
        return F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return pages.select("c_custkey", "page", size("orders").alias("orders"),
                        F.array_min(F.transform("orders", lambda o: o["o_orderkey"])).alias("first_order"),
                        size("events").alias("events"))


@query("s06_replayed_events", """
    select event_id, user_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as position from events""")
def s06(t):
    """Every event is delivered twice, in two batches, and the second batch once more; the log holds each event once."""
    path = f"{scratch(t)}/log"
    events = t.events.select("event_id", "user_id", "event_type", "ts")
    late = F.col("event_id") % 3 == 0
    for batch, part in ((0, events.filter(~late)), (1, events), (1, events)):
        stores.append_events(part, path, batch, ident="event_id", time="ts")
    return stores.replay_events(t.spark, path, events.schema, case="user_id", ident="event_id", time="ts") \
        .select("event_id", "user_id", "event_type", "ts", F.col("position").cast("bigint"))


@query("s08_ingested_files", """
    select regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') || '.json' as name, sha256('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' || chr(10)) as sha256,
      strlen(s_name) + strlen(s_suppkey::varchar) + 27 as byte_size, 'application/json' as media_type from supplier""")
def s08_files(t):
    """One file per supplier, written to shared storage and ingested as bytes."""
    path, spark = f"{scratch(t)}/files", t.spark
    text = t.supplier.select(F.regexp_replace("s_name", "[^A-Za-z0-9]", "_").alias("name"),
                             F.to_json(F.struct("s_suppkey", "s_name")).alias("value"))
    stores.write_files(text, path, name="name")
    found = stores.ingest_files(spark, path, "part-*")
    return found.select(F.concat(F.regexp_extract("path", "name=([^/]*)", 1), F.lit(".json")).alias("name"), "sha256", "byte_size",
                        F.lit(stores.MEDIA_TYPES["json"]).alias("media_type"))


@query("s08_fingerprints", "select doc_id, sha256(text) as sha256, octet_length(encode(text)) as byte_size from documents")
def s08(t):
    return t.documents.select("doc_id", stores.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("s09_missing_inputs", """
    select doc_id from documents where doc_id not in (select doc_id from labels)""")
def s09(t):
    return stores.missing_inputs(t.documents.select("doc_id"), t.labels, name="doc_id")


@query("s09_manifest_frames", """
    select s_nationkey::varchar as dataset_id, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as index, s_name as file, sha256(s_name) as sha256,
      s_suppkey % 2 = 0 as "expectedRegistered" from supplier""")
def s09_frames(t):
    """A manifest per nation with its suppliers as frames, written as JSON and scanned."""
    path = f"{scratch(t)}/manifests"
    frame = F.struct(F.col("s_suppkey"), F.struct(F.col("s_name").alias("file"), F.sha2("s_name", 256).alias("sha256"),
                                                  (F.col("s_suppkey") % 2 == 0).alias("expectedRegistered")).alias("f"))
    sets = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("datasetId")).agg(F.sort_array(F.collect_list(frame)).alias("l"))
    sets.select("datasetId", F.col("l.f").alias("frames")).write.json(path)
    return stores.manifest_frames(t.spark, path).select("dataset_id", "index", "file", "sha256", "expectedRegistered")


@query("s10_report_scan", """
    select event_id, case when event_id % 4 <> 0 then (props->>'k')::int end as k from events""")
def s10(t):
    text = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    out = stores.scan_reports(t.events.select("event_id", text.alias("raw")), "k int", text="raw")
    return out.select("event_id", F.col("report.k").alias("k"))


def reports(t):
    """Orders as artifacts: the lines of an order are its frames."""
    line = F.struct(F.col("l_linenumber").cast("double").alias("frame"),
                    F.array(F.col("l_quantity"), F.col("l_tax"), F.when(F.col("l_discount") > 0.01, F.col("l_discount"))
                            ).alias("position"),
                    F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("l_tax")).alias("rotationWxyz"),
                    (F.col("l_quantity") - 10).alias("scale"),
                    F.when(F.col("l_returnflag") == "R", stores.MEASURED_PLACEMENT).otherwise("other").alias("placement"))
    lines = first_by(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])
    return lines.groupBy("l_orderkey").agg(
        F.collect_list(line).alias("poses"), F.collect_list(F.when(F.col("l_linestatus") == "O", F.struct(
            F.col("l_linenumber").cast("double").alias("frame"), (F.col("l_discount") * 5).alias("confidence")))).alias("joint")
    ).withColumn("ids", F.array(*[F.lit(f"e{i}") for i in range(6)]))


@query("s11_camera_poses", """
    with l as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) rn from lineitem) where rn = 1),
    v as (select *, case when l_linestatus = 'O' then l_discount * 5 end jc from l where l_discount > 0.01 and l_linenumber <= 5)
    select l_orderkey, 'e' || l_linenumber as evidence_id, l_linenumber as source_index, round(l_quantity, 6) as px,
      round(case when l_quantity > 10 then l_quantity - 10 else 1 end, 6) as scale,
      round(case when l_returnflag = 'R' then greatest(0.4, coalesce(jc, 0)) else coalesce(jc, 0.55) end, 6) as confidence_score from v""")
def s11(t):
    df = reports(t).withColumn("reg", F.lit(0.4))
    out = stores.flatten_poses(df, artifact="l_orderkey", evidence_ids="ids", poses="poses", joint="joint", registration="reg")
    return out.select("l_orderkey", "evidence_id", "source_index", F.round("px", 6).alias("px"),
                      F.round("scale", 6).alias("scale"), F.round("confidence_score", 6).alias("confidence_score"))


@query("s12_reconstruction_quality", """
    select o_orderkey, round(case when o_orderstatus <> 'F' then 1.0 else (o_orderkey % 5 + 1) / 6.0 end, 6) as registered_ratio,
      (case when o_orderstatus = 'F' then 1 + (o_custkey % 8 < 6)::int else 0 end)::bigint as missing_bridges,
      case when o_orderstatus = 'F' and o_custkey % 3 <> 0 then round(o_totalprice, 2) end as rmse,
      case when o_orderstatus = 'F' and o_custkey % 4 = 0 then 0.5 end as support from orders""")
def s12(t):
    c = F.col("o_custkey")
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "multi_image").otherwise("panorama").alias("mode"),
        (F.col("o_orderkey") % 5 + 1).alias("connected"), F.lit(6).alias("frames"),
        F.array(*[F.lit(f"e{i}") for i in range(6)]).alias("ids"),
        F.array(F.lit(0.0), (c % 8).cast("double"), F.lit(1.5)).alias("disconnected"),
        F.when(c % 3 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("raw_rmse"),
        F.when(c % 4 == 0, 0.5).otherwise(1.5).alias("raw_support"))
    out = stores.reconstruction_quality(
        df, mode="mode", connected="connected", frames="frames", evidence_ids="ids", disconnected="disconnected",
        metrics={"rmse": ("raw_rmse", "nonnegative"), "support": ("raw_support", "unit")})
    return out.select("o_orderkey", F.round("registered_ratio", 6).alias("registered_ratio"),
                      F.size("missing_bridge_ids").cast("bigint").alias("missing_bridges"),
                      F.round("rmse", 2).alias("rmse"), "support")


@query("s13_record_audit", """
    select p_partkey, count(l_partkey) as rows, case when p_size % 2 = 1 then 'size_mismatch' when count(l_partkey) < 30 then 'too_few' else 'ok' end as verdict
    from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_size""")
def s13(t):
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    files = t.part.join(counts, "p_partkey", "left").select(
        "p_partkey", (F.coalesce("n", F.lit(0)) * 32 + F.col("p_size") % 2).alias("bytes"))
    points = t.lineitem.select(F.col("l_partkey").alias("p_partkey"))
    return stores.audit_records(points, files, scene="p_partkey", size="bytes", minimum=30) \
        .select("p_partkey", "rows", "verdict")


@query("s14_artifact_manifests", """
    select o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","case":' || o_custkey || '}' as manifest from orders""")
def s14(t):
    return t.orders.select("o_orderkey", stores.manifest_json(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("case")
    ).alias("manifest"))


@query("s14_committed_manifests", """
    select o_custkey as case_key, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' as document from orders
    qualify o_custkey % 5 <> 0 or o_orderkey % 2 = 0 or not bool_or(o_orderkey % 2 = 0) over (partition by o_custkey)""")
def s14_committed(t):
    """A committed attempt, a newer one for some cases, and one that never committed."""
    path = f"{scratch(t)}/artifacts"
    made = t.orders.select("o_custkey", "o_orderkey", stores.manifest_json(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("document"))
    stores.write_manifests(made, path, "a", case="o_custkey")
    stores.write_manifests(made.filter("o_custkey % 5 = 0 and o_orderkey % 2 = 0"), path, "b", case="o_custkey")
    made.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("case_key"), "document", F.lit(0).alias("shard")) \
        .write.partitionBy("shard").json(f"{path}/documents/attempt=c")
    return stores.read_manifests(t.spark, path)


@query("s15_plan_models", """
    with f as (select o_custkey, o_orderstatus, count(*) rooms from orders group by all)
    select o_custkey, count(*) as floor_count, sum(rooms)::bigint as rooms_total, min(o_orderstatus) as first_floor from f group by o_custkey""")
def s15(t):
    floors = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("rooms"))
    out = stores.plan_model(floors, case="o_custkey", floor="o_orderstatus", members=["rooms"])
    return out.select("o_custkey", "floor_count", "rooms_total", F.get("floors", 0)["o_orderstatus"].alias("first_floor"))


def reviews(t):
    review = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending")
    o = t.orders.select("o_custkey", "o_orderkey", review.alias("review"), "o_orderpriority")
    return o.filter("o_orderpriority <> '1-URGENT'"), o.filter("o_orderpriority = '1-URGENT'")


@query("s16_briefing_header", """
    with r as (select o_custkey, o_orderpriority = '1-URGENT' route, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'rejected' else 'pending' end review from orders)
    select o_custkey, count(*) filter (not route and review = 'confirmed') as confirmed_hazards,
      count(*) filter (route and review = 'confirmed') as confirmed_routes, count(*) filter (review = 'pending') as unresolved,
      count(*) filter (route) > 0 and count(*) filter (route and review = 'pending') = 0 as final from r group by o_custkey""")
def s16(t):
    hazards, routes = reviews(t)
    return stores.briefing_header(hazards, routes, case="o_custkey", review="review")


@query("s16_briefing_items", """
    select o_custkey, o_orderkey as item_id, case when o_orderpriority = '1-URGENT' then 'route' else 'hazard' end as kind,
      (o_orderpriority = '1-URGENT')::int as kind_rank, case o_orderstatus when 'F' then 'confirmed' else 'unresolved' end as section
    from orders where o_orderstatus <> 'O'""")
def s16_items(t):
    hazards, routes = reviews(t)
    return stores.briefing_items(hazards, routes, case="o_custkey", item="o_orderkey", review="review")


@query("s17_geojson", """
    select c_custkey, case when c_acctbal >= 0 then '{"type":"Feature","properties":{"name":"' || c_name || '"},"geometry":{"type":"Point","coordinates":[' || c_nationkey || ',' || c_nationkey + 1 || ']}}' end as feature from customer""")
def s17(t):
    n = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    return t.customer.select("c_custkey", stores.geojson_point(F.struct(F.col("c_name").alias("name")), n, n + 1).alias("feature"))


@query("s17_footprints", """
    select c_custkey, '{"type":"Feature","properties":{"name":"' || c_name || '"},"geometry":{"type":"Polygon","coordinates":[[[' || n || ',0],[' || n + 1 || ',0],[' || n + 1 || ',1],[' || n || ',0]]]}}' as feature
    from (select *, c_nationkey n from customer)""")
def s17_footprints(t):
    n, zero = F.col("c_nationkey").cast("bigint"), F.lit(0).cast("bigint")
    ring = F.array(F.array(n, zero), F.array(n + 1, zero), F.array(n + 1, zero + 1), F.array(n, zero))
    return t.customer.select("c_custkey", stores.geojson_polygon(F.struct(F.col("c_name").alias("name")), ring).alias("feature"))


@query("s18_natural_order", r"""
    with k as (select c_custkey, c_nationkey, c_name, lower(c_mktsegment) || '_' || c_custkey as file from customer),
    n as (select *, list_aggregate(list_transform(regexp_extract_all(file, '([0-9]+|[^0-9]+)'),
      lambda x: case when regexp_matches(x, '^[0-9]+$') then lpad(length(ltrim(x, '0'))::varchar, 10, '0') || ltrim(x, '0') else x end), 'string_agg', '') key from k)
    select c_custkey, row_number() over (partition by c_nationkey order by key, file)::int as rank, key from n""")
def s18(t):
    files = t.customer.select("c_custkey", "c_nationkey", F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")).alias("file"))
    return stores.natural_order(files, keys=["c_nationkey"], name="file").select("c_custkey", "rank", natural_key(F.col("file")).alias("key"))
