"""Acceptance metrics: document labels as expectations, sources as datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import evaluation as ev
from proofgrid.plans.registry import query


def frames(t):
    f = t.documents.select("source", "doc_id", "lang").join(t.labels, "doc_id", "left")
    return f.withColumn("expected", F.col("quality") == 1), f.filter("toxic = 0").select("source", "doc_id")


@query("e01_recall_precision", """
    with f as (select source, quality = 1 as ex, toxic = 0 as reg from documents left join labels using (doc_id))
    select source, count(*) filter (ex) as expected, round(case when count(*) filter (ex) > 0 then count(*) filter (ex and reg) / count(*) filter (ex) else 1 end, 6) as recall,
      round(case when count(*) filter (reg and ex is not null) > 0 then count(*) filter (ex and reg) / count(*) filter (reg and ex is not null) else 1 end, 6) as precision from f group by source""")
def e01(t):
    f, reg = frames(t)
    out = ev.registration_metrics(f, reg, dataset="source", index="doc_id", expected="expected")
    return out.select("source", "expected", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("e02_room_completeness", """
    select source, lang, round(avg(case when toxic = 0 then 1 else 0 end), 6) as completeness from documents left join labels using (doc_id) group by source, lang""")
def e02(t):
    f, reg = frames(t)
    return ev.room_completeness(f, reg, dataset="source", index="doc_id", room="lang")


def metrics(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    n = F.lit(None)
    return t.orders.select(
        "o_orderkey", ((k % 10) / 10).alias("recall"), F.lit(1.0).alias("precision"), (k % 5000).alias("gaussian_count"), F.when(k % 7 != 0, k % 50).alias("color_samples"),
        F.when(k % 11 != 0, (k % 100) / 100).alias("cross_view_support"), F.when(k % 13 != 0, (k % 90) * 1.0).alias("rotation_deg"), (p / 1e6).alias("point_after"), F.lit(0.3).alias("point_before"),
        F.lit(0.2).alias("pose_before"), F.when(k % 3 == 0, 0.1).otherwise(0.2).alias("pose_after"), F.lit(True).alias("pose_optimized"), F.lit(0.2).alias("dense_before"), F.lit(0.1).alias("dense_after"),
        (k % 4 != 0).alias("dense_optimized"), F.lit(0.2).alias("color_before"), n.cast("double").alias("color_after"), F.lit(True).alias("color_applied"), F.lit(10).alias("scale_before"), F.when(k % 17 == 0, 9).otherwise(10).alias("scale_after"),
        n.cast("int").alias("coverage_before"), n.cast("int").alias("coverage_after"), F.lit(True).alias("joint_accepted"), F.when(k % 19 == 0, False).alias("inputs_verified"),
        F.when(k % 2 == 0, 0.5).alias("min_recall"), n.cast("double").alias("min_precision"), F.lit(1000).alias("min_gaussians"), F.lit(5).alias("min_color_samples"), F.when(k % 5 == 0, 0.3).alias("min_cross_view"),
        F.lit(0.45).alias("max_point_rmse"), F.lit(60.0).alias("max_rotation"), (k % 6 == 0).alias("require_pose"), F.lit(False).alias("require_point"), (k % 8 == 0).alias("require_dense"), (k % 23 == 0).alias("require_color"),
        F.lit(True).alias("require_scale_count"), (k % 29 == 0).alias("require_coverage_count"), F.lit(True).alias("require_joint"))


@query("e03_threshold_checks", """
    with c as (select o_orderkey k, o_orderkey % 2 <> 0 or (o_orderkey % 10) / 10.0 >= 0.5 as registration_recall, o_orderkey % 5000 >= 1000 as gaussian_count,
      case when o_orderkey % 7 <> 0 then o_orderkey % 50 else 0 end >= 5 as overlap_color_samples, o_orderkey % 5 <> 0 or (o_orderkey % 11 <> 0 and (o_orderkey % 100) / 100.0 >= 0.3) as cross_view_support,
      o_totalprice / 1e6 <= 0.45 as point_rmse, o_orderkey % 13 <> 0 and o_orderkey % 90 <= 60 as rotation_agreement, true as pose_graph_improved, o_orderkey % 8 <> 0 or o_orderkey % 4 <> 0 as dense_surface_improved,
      o_orderkey % 23 <> 0 as overlap_color_improved, o_orderkey % 17 <> 0 as scale_count_preserved, o_orderkey % 29 <> 0 as source_coverage_count_preserved, o_orderkey % 19 <> 0 as input_hashes from orders)
    select k as o_orderkey, registration_recall, gaussian_count, overlap_color_samples, cross_view_support, point_rmse, rotation_agreement, pose_graph_improved, dense_surface_improved, overlap_color_improved, scale_count_preserved,
      source_coverage_count_preserved, input_hashes, registration_recall and gaussian_count and overlap_color_samples and cross_view_support and point_rmse and rotation_agreement and pose_graph_improved and dense_surface_improved
      and overlap_color_improved and scale_count_preserved and source_coverage_count_preserved and input_hashes as passed from c""")
def e03(t):
    return ev.threshold_checks(metrics(t), dataset="o_orderkey").drop("registration_precision", "point_optimization", "joint_camera_accepted")


@query("e04_improved", "select case when l_linenumber = 1 then false else l_tax < l_discount end as better, count(*) as lines from lineitem group by 1")
def e04(t):
    before = F.when(F.col("l_linenumber") != 1, F.col("l_discount"))
    return t.lineitem.select(ev.improved(before, F.col("l_tax")).alias("better")).groupBy("better").agg(F.count(F.lit(1)).alias("lines"))


@query("e05_typed_metrics", """
    select event_id, case when event_id % 5 > 1 then round(value, 6) end as value, case when event_id % 3 = 0 then (props->>'k')::bigint end as k from events""")
def e05(t):
    v = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "null").otherwise(F.col("value").cast("string"))
    k = F.get_json_object("props", "$.k")
    k = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-1"), k)).otherwise(F.concat(k, F.lit(".5")))
    text = F.concat(F.lit('{"value": '), v, F.lit(', "k": '), k, F.lit("}"))
    out = ev.extract_metrics(t.events.select("event_id", text.alias("raw")), text="raw", schema="value double, k double", numbers=["value"], counts=["k"])
    return out.select("event_id", F.round("value", 6).alias("value"), "k")


@query("e06_baseline_gain", """
    with r as (select source, count(distinct doc_id) n from documents join labels using (doc_id) where toxic = 0 group by 1), b as (select source, count(*) c from documents where lang = 'en' group by 1)
    select source, n as registered, n - c as gain from r left join b using (source)""")
def e06(t):
    _, reg = frames(t)
    base = t.documents.filter("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("before"))
    return ev.baseline_gain(reg, base, dataset="source", index="doc_id", baseline="before")


@query("e07_component_separation", """
    with p as (select source, lang, count(*) n from documents join labels using (doc_id) where toxic = 0 group by all)
    select source, sum(n)::bigint as registered, (sum(n) - max(n))::bigint as foreign_frames, sum(n) = max(n) as separate from p group by source""")
def e07(t):
    f, reg = frames(t)
    return ev.separation(f, reg, dataset="source", index="doc_id", component="lang").withColumnRenamed("foreign", "foreign_frames")
