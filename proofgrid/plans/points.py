"""Points and cameras: lines as points, suppliers as scenes, embeddings as 3D pairs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from proofgrid.operators import points as pt
from proofgrid.operators.posegraph import refine_poses
from proofgrid.operators.ranking import even_sample, weighted_median
from proofgrid.plans.registry import query


def r6(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def cloud(t):
    """Every line is a point seen by a frame of its supplier's scene."""
    q, p = F.col("l_quantity"), F.col("l_partkey")
    idx = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")])
    return t.lineitem.select(
        F.col("l_suppkey").alias("scene"), (F.col("l_linenumber") % 3).alias("frame"), idx.alias("idx"),
        ((p % 64) / 16.0 - 2).alias("x"), ((F.col("l_orderkey") % 48) / 16.0 - 1.5).alias("y"), (q / 10).alias("z"),
        F.log(F.col("l_tax") * 0.1 + 0.002).alias("s0"), F.log(q / 400 + 0.004).alias("s1"), F.log(F.col("l_discount") * 0.2 + 0.01).alias("s2"),
        F.lit(1.0).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"),
        (F.lit(0.3) + F.col("l_discount") * 3).alias("r"), (F.lit(0.4) + F.col("l_tax") * 3).alias("g"), (q / 100 + 0.2).alias("b"), F.lit(1.0).alias("opacity"))


CLOUD = """
    cloud as (select l_suppkey scene, l_linenumber % 3 frame, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) idx,
      (l_partkey % 64) / 16.0::double - 2 x, (l_orderkey % 48) / 16.0::double - 1.5 y, l_quantity / 10 z, ln(l_tax * 0.1 + 0.002) s0, ln(l_quantity / 400 + 0.004) s1, ln(l_discount * 0.2 + 0.01) s2 from lineitem),
    proj as (select *, round_even(x / z * 40 + 32, 0)::int u, round_even(y / z * 40 + 24, 0)::int v from cloud where z > 0.01),
    buf as (select scene, frame, u, v, arg_min((x, y, z), (z, idx)) p from proj where u between 0 and 63 and v between 0 and 47 group by all)"""


def buffer(t):
    c = cloud(t).withColumn("f", F.lit(40.0)).withColumn("w", F.lit(64)).withColumn("h", F.lit(48))
    return pt.depth_buffer(c, keys=["scene", "frame"], focal="f", width="w", height="h", idx="idx")


@query("q01_depth_buffer", f"with {CLOUD} select scene, frame, u, v, round(p[1], 6) as x, round(p[2], 6) as y, round(p[3], 6) as z from buf")
def q01(t):
    return buffer(t).select("scene", "frame", "u", "v", *r6("x", "y", "z"))


@query("q02_lifted_pixels", f"""
    with {CLOUD}, px as (select s_suppkey scene, k frame, (s_suppkey * 7) % 64 + 0.5 px, (s_suppkey * 5) % 48 + 1.5 py from supplier, (select unnest([0, 1, 2]) k)),
    h as (select px.scene, px.frame, px.px, px.py, greatest(abs(u - round_even(px, 0)), abs(v - round_even(py, 0))) ring, p, u, v from px join buf on buf.scene = px.scene and buf.frame = px.frame
      and abs(u - round_even(px, 0)) <= 4 and abs(v - round_even(py, 0)) <= 4)
    select scene, frame, round(arg_min(p, (ring, p[3], u, v))[3], 6) as z from h group by all""")
def q02(t):
    k = F.col("s_suppkey")
    px = t.supplier.select(k.alias("scene"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("frame"), ((k * 7) % 64 + 0.5).alias("px"), ((k * 5) % 48 + 1.5).alias("py"))
    return pt.lift_pixels(px, buffer(t), keys=["scene", "frame"], pixel=["px", "py"], px="px", py="py").select("scene", "frame", *r6("z"))


@query("q03_metric_gate", """
    with g as (select l_partkey, count(*) * 2 n, count(*) filter (l_discount > 0.02) + 5 inl, avg(l_quantity) / 20 scale, stddev_pop(l_tax) rmse, median(l_quantity) md from lineitem group by 1),
    r as (select *, greatest(0.08, md * 0.05) ds, case when n < 12 then 'too_few_lifted' when inl < case when n >= 40 then 18 else 10 end or inl / n < 0.25 then 'too_few_inliers'
      when not scale between 0.5 and 2 then 'scale_out_of_range' when rmse > 1.5 * greatest(0.08, md * 0.05) then 'error_too_high' end reason from g)
    select l_partkey, reason is null as accepted, reason, round(case when reason is null then 0.35 * least(1, inl / 80.0) + 0.45 * least(1, inl / n / 0.65) + 0.2 * greatest(0, 1 - rmse / (ds * 1.5)) end, 6) as confidence from r""")
def q03(t):
    g = t.lineitem.groupBy("l_partkey").agg((F.count(F.lit(1)) * 2).alias("n"), (F.count_if(F.col("l_discount") > 0.02) + 5).alias("inl"),
                                            (F.avg("l_quantity") / 20).alias("scale"), F.stddev_pop("l_tax").alias("rmse"), F.median("l_quantity").alias("md"))
    out = g.select("l_partkey", pt.metric_gate(F.col("n"), F.col("inl"), F.col("scale"), F.col("rmse"), F.col("md")).alias("g"))
    return out.select("l_partkey", "g.accepted", "g.reason", F.round("g.confidence", 6).alias("confidence"))


ANGLE, SCALE, SHIFT = math.radians(23), 1.13, (0.4, -0.2, 1.7)


def known_pairs(t, outliers=False):
    """First three embedding numbers as source, a known similarity of them as target."""
    b = [F.col("embedding")[i].cast("double") for i in range(3)]
    c, s = math.cos(ANGLE), math.sin(ANGLE)
    a = [(b[0] * c - b[1] * s) * SCALE + SHIFT[0], (b[0] * s + b[1] * c) * SCALE + SHIFT[1], b[2] * SCALE + SHIFT[2]]
    if outliers:
        a = [F.when(F.col("vec_id") % 4 == 3, v + (F.col("vec_id") % 9) + 1).otherwise(v) for v in a]
    return t.embeddings.select(F.col("label").alias("pair"), "vec_id", *[v.alias(n) for v, n in zip(a, ("ax", "ay", "az"), strict=True)],
                               *[v.alias(n) for v, n in zip(b, ("bx", "by", "bz"), strict=True)])


@query("q04_robust_similarity", """
    select label as pair, count(*) as matches, count(*) filter (vec_id % 4 <> 3) as inliers, 1.13::double as scale, 0.0::double as rmse from embeddings group by label""")
def q04(t):
    out = pt.robust_similarity(known_pairs(t, True), keys=["pair"], order=[F.col("vec_id")], slice_by=F.floor(F.col("vec_id") / 1000))
    return out.select("pair", "matches", "inliers", *r6("scale", "rmse"))


@query("q05_similarity_fit", f"""
    select label as pair, count(*) as n, 1.13::double as scale, round(1.13 * cos(radians(23)), 6) as m00, 0.4::double as tx, 1.7::double as tz from embeddings group by label""")
def q05(t):
    out = pt.similarity_fits(known_pairs(t), keys=["pair"])
    m = F.col("transform")
    return out.select("pair", "n", F.round(pt.similarity_scale(m), 6).alias("scale"), F.round(m[0], 6).alias("m00"), F.round(m[3], 6).alias("tx"), F.round(m[11], 6).alias("tz"))


def cams(t):
    """Three cameras per supplier: turned about y by 10 degrees per frame and moved."""
    frame = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    c = t.supplier.select(F.col("s_suppkey").alias("scene"), frame.alias("frame"))
    a, s = F.radians(F.col("frame") * 10.0), F.col("frame") * 0.25 + 1
    z, o = F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(a) * s, z, F.sin(a) * s, F.col("frame") * 0.3, z, s, z, z, -F.sin(a) * s, z, F.cos(a) * s, F.col("frame") * -0.2, z, z, z, o)
    return c.withColumn("transform", m).withColumn("f", F.lit(40.0)).withColumn("w", F.lit(64)).withColumn("h", F.lit(48))


MOVED = CLOUD + """,
    moved as (select scene, frame, idx, (cos(radians(frame * 10)) * x + sin(radians(frame * 10)) * z) * (1 + frame * 0.25) + frame * 0.3 x,
      y * (1 + frame * 0.25) y, (-sin(radians(frame * 10)) * x + cos(radians(frame * 10)) * z) * (1 + frame * 0.25) - frame * 0.2 z,
      s0 + ln(1 + frame * 0.25) s0, cos(radians(frame * 5)) qw from cloud)"""


@query("q06_transformed_points", f"with {MOVED} select idx, scene, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z, round(s0, 5) as s0, round(qw, 5) as qw from moved")
def q06(t):
    out = pt.transform_points(cloud(t), cams(t), keys=["scene", "frame"], transform="transform")
    return out.select("idx", "scene", *r6("x", "y", "z", "s0", "qw", digits=5))


@query("q07_decomposed", "select s_suppkey as scene, k::int as frame, 1 + k * 0.25::double as scale, round(radians(k * 10), 6) as ry, round(k * 0.3, 6) as tx from supplier, (select unnest([0, 1, 2]) k)")
def q07(t):
    return pt.decompose(cams(t), "transform").select("scene", "frame", *r6("scale", "ry", "tx"))


@query("q09_surface_matches", """
    with p as (select l_suppkey scene, l_linenumber % 2 side, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) i, (l_partkey % 97) * 0.05::double x, (l_orderkey % 89) * 0.05::double y, l_quantity * 0.01 z from lineitem),
    d as (select a.scene, a.i i1, b.i i2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) d, (a.x + b.x) / 2 mx, (a.y + b.y) / 2 my, (a.z + b.z) / 2 mz from p a join p b on a.scene = b.scene and a.side = 0 and b.side = 1
      and abs(a.x - b.x) <= 0.1 and abs(a.y - b.y) <= 0.1 and abs(a.z - b.z) <= 0.1),
    n as (select *, row_number() over (partition by scene, i1 order by d, i2) r1, row_number() over (partition by scene, i2 order by d, i1) r2 from d where d <= 0.1),
    v as (select *, row_number() over (partition by scene, floor(mx / 0.06), floor(my / 0.06), floor(mz / 0.06) order by d, i1) rv from n where r1 = 1 and r2 = 1),
    k as (select *, row_number() over (partition by scene order by d, i1)::int match_rank, count(*) over (partition by scene) m from v where rv = 1)
    select scene, i1, i2, match_rank from k where m >= 12 and match_rank <= 1200""")
def q09(t):
    base = t.lineitem.select(F.col("l_suppkey").alias("scene"), (F.col("l_linenumber") % 2).alias("side"), F.concat_ws("-", *[
        F.col(n).cast("string") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]).alias("idx"),
        ((F.col("l_partkey") % 97) * 0.05).alias("x"), ((F.col("l_orderkey") % 89) * 0.05).alias("y"), (F.col("l_quantity") * 0.01).alias("z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0.5).alias("r"), F.lit(0.5).alias("g"), F.lit(0.5).alias("b"))
    return pt.reciprocal_matches(base.filter("side = 0"), base.filter("side = 1"), keys=["scene"], idx="idx", limit=0.1, cell=0.1) \
        .select("scene", "i1", "i2", "match_rank")


@query("q10_point_rmse", """
    with d as (select label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings)
    select label as pair, round(sqrt(avg(pow((x * cos(radians(23)) - y * sin(radians(23))) * 1.13 + 0.4 - x, 2) + pow((x * sin(radians(23)) + y * cos(radians(23))) * 1.13 - 0.2 - y, 2) + pow(z * 1.13 + 1.7 - z, 2))), 6) as rmse from d group by label""")
def q10(t):
    return pt.point_rmse(known_pairs(t), keys=["pair"]).select("pair", *r6("rmse"))


@query("q11_dense_acceptance", """
    select o_orderkey, o_orderkey % 40 >= 24 and o_custkey % 3 <> 0 and o_custkey % 50 <= 30 and o_custkey % 7 <= 5 and o_orderkey % 9 <> 0 as accepted from orders""")
def q11(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    df = t.orders.select("o_orderkey", (o % 40).alias("n"), (c % 3 != 0).alias("opt"), F.lit(0.02).alias("d0"), F.when(o % 9 == 0, 0.03).otherwise(0.019).alias("d1"),
                         F.lit(0.1).alias("s0"), F.when(c % 7 <= 5, 0.1019).otherwise(0.103).alias("s1"), ((c % 50) / 200).alias("move"), F.lit(1.0).alias("turn"))
    return pt.accept_dense(df, dense=("d0", "d1"), sparse=("s0", "s1"), moved_m="move", turned_deg="turn", constraints="n", optimised="opt").select("o_orderkey", "accepted")


@query("q12_grown_footprints", f"""
    with {CLOUD}, n as (select scene, frame, count(*) n from cloud group by all),
    a as (select cloud.*, n, list_sort([exp(s0), exp(s1), exp(s2)]) ax, z * 1.2 / 40 * sqrt(3072.0 / n) * 0.55 want from cloud join n using (scene, frame)),
    g as (select *, least(greatest(ax[2], want), ax[2] * 1.15) a1, least(greatest(ax[3], want), ax[3] * 1.15) a2 from a)
    select idx, scene, greatest(a1 / ax[2], a2 / ax[3]) > 1.00001 as affected, round((ax[1] + a1 + a2) * 1.000001, 4) as axes from g""")
def q12(t):
    c = cams(t).withColumn("scale", F.lit(1.2)).withColumn("pixels", F.lit(3072.0))
    out = pt.grow_footprints(cloud(t), c, keys=["scene", "frame"], depth="z", scale="scale", focal="f", pixels="pixels")
    return out.select("idx", "scene", "affected", F.round((F.exp("s0") + F.exp("s1") + F.exp("s2")) * 1.000001, 4).alias("axes"))


SHIFTED = CLOUD + """,
    world as (select scene, frame, idx, x + frame * 0.25 x, y, z from cloud),
    aim as (select w.scene, w.frame, w.idx, k.k tf, w.x - k.k * 0.25 x, w.y, w.z from world w, (select unnest([0, 1, 2]) k) k where k.k <> w.frame and w.z > 0.01),
    pix as (select *, round_even(x / z * 40 + 32, 0)::int u, round_even(y / z * 40 + 24, 0)::int v from aim),
    hit as (select pix.scene, pix.frame, idx, pix.z, p[3] ref, greatest(0.08, p[3] * 0.06) tol from pix join buf on buf.scene = pix.scene and buf.frame = pix.tf and buf.u = pix.u and buf.v = pix.v),
    votes as (select scene, frame, idx, count(*) observed, count(*) filter (abs(z - ref) <= tol) supported, count(*) filter (z < ref - tol) contradicted from hit group by all)"""


def votes(t):
    z, o = F.lit(0.0), F.lit(1.0)
    shifted = cams(t).withColumn("transform", F.array(o, z, z, F.col("frame") * 0.25, z, o, z, z, z, z, o, z, z, z, z, o))
    world = cloud(t).withColumn("x", F.col("x") + F.col("frame") * 0.25)
    return pt.cross_view_votes(world, shifted, buffer(t), scene="scene", frame="frame", idx="idx", transform="transform", focal="f", width="w", height="h")


@query("q13_cross_view_votes", f"""
    with {SHIFTED} select c.idx, c.scene, coalesce(observed, 0) as observed, coalesce(supported, 0) as supported, coalesce(observed >= 2 and supported = 0 and contradicted = observed, false) as removed
    from cloud c left join votes v on v.scene = c.scene and v.frame = c.frame and v.idx = c.idx""")
def q13(t):
    return votes(t).select("idx", "scene", "observed", "supported", "removed")


@query("q14_clamped_needles", f"""
    with {CLOUD}, a as (select *, list_sort([exp(s0), exp(s1), exp(s2)]) ax from cloud), q as (select scene, quantile_cont(ax[3], 0.995) tail from a group by scene)
    select idx, scene, ax[3] / ax[2] > 12 and ax[3] >= tail - 1e-12 as affected, round(case when ax[3] / ax[2] > 12 and ax[3] >= tail - 1e-12 then ax[2] * 12 else ax[3] end, 5) as longest from a join q using (scene)""")
def q14(t):
    out = pt.clamp_needles(cloud(t), keys=["scene"])
    return out.select("idx", "scene", "affected", F.round(F.greatest(F.exp("s0"), F.exp("s1"), F.exp("s2")), 5).alias("longest"))


@query("q14_exact_tail", """
    select l_returnflag, round(quantile_cont(l_extendedprice, 0.995), 4) as tail, round(median(l_extendedprice), 4) as middle from lineitem group by l_returnflag""")
def q14_tail(t):
    tails = pt.exact_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", pt.TAIL_QUANTILE, "tail")
    return tails.join(pt.exact_median(t.lineitem, ["l_returnflag"], "l_extendedprice", "middle"), "l_returnflag").select("l_returnflag", *r6("tail", "middle", digits=4))


@query("q15_colour_gains")
def q15(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    s = t.lineitem.select(F.col("l_suppkey").alias("scene"), (F.col("l_linenumber") % 3).alias("a"), (F.col("l_linenumber") % 3 + 1).alias("b"),
                          *[(q / 100 + 0.2 + i * 0.05).alias(f"{c}1") for i, c in enumerate("rgb")], *[((q / 100 + 0.2 + i * 0.05) * (d + 0.9)).alias(f"{c}2") for i, c in enumerate("rgb")])
    e = s.groupBy("scene", "a", "b").agg((F.avg("r1")).alias("conf"))
    g = pt.colour_gains(s, e, scene="scene", a="a", b="b", confidence="conf")
    return g.select("scene", "frame", *r6("gain_r", "gain_g", "gain_b", "before", "after"), "anchor")


@query("q16_scene_gate", f"""
    with {SHIFTED}, s as (select c.scene, count(*) n, count(*) filter (supported >= 1) k from cloud c left join votes v on v.scene = c.scene and v.frame = c.frame and v.idx = c.idx group by 1)
    select scene, round(k / n, 6) as supported_fraction, k / n >= 0.3 or scene % 40 >= 24 as accepted from s""")
def q16(t):
    rep = pt.cleanup_report(votes(t), scene="scene")
    return rep.select("scene", *r6("supported_fraction"), pt.scene_gate(F.col("supported_fraction"), F.col("scene") % 40).alias("accepted"))


@query("q17_merged_clouds", """
    select l_suppkey as scene, count(*) as points, case when l_suppkey % 3 = 0 then 0 else count(*) end as with_sh from lineitem group by 1""")
def q17(t):
    c = cloud(t).select("scene", "frame", "x", F.when((F.col("scene") % 3 != 0) | (F.col("frame") != 1), F.array(F.lit(0.5))).alias("sh"))
    out = pt.merge_clouds([c.filter(F.col("frame") == k) for k in range(3)], scene="scene", sh="sh")
    return out.groupBy("scene").agg(F.count(F.lit(1)).alias("points"), F.count("sh").alias("with_sh"))


@query("q18_pose_report", """
    select s_suppkey as scene, k::int as frame, round(k * 0.3, 5) as px, round(cos(radians(k * 5)), 5) as qw, round(sin(radians(k * 5)), 5) as qy, round(1 + k * 0.25, 5) as scale,
      case when s_acctbal > 3000 and k < 2 then 'measured_feature_and_sharp_metric' else 'joint_camera_calibrated_by_metric_core' end as placement from supplier, (select unnest([0, 1, 2]) k)""")
def q18(t):
    rich = t.supplier.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("scene"))
    metric = cams(t).filter("frame < 2").join(rich, "scene", "left_semi")
    return pt.pose_report(cams(t), metric, keys=["scene", "frame"], transform="transform").select("scene", "frame", *r6("px", "qw", "qy", "scale", digits=5), "placement")


@query("q19_calibrated_cameras", """
    with p as (select s_suppkey scene, a, 2.0 + (s_suppkey % 5) + case when a = 1 then 1 else 0 end f, case when a = 0 then 0.9 else 0.2 end w from supplier, (select unnest([0, 1]) a))
    select scene, k::int as frame, round(arg_max(f, w), 6) as metric_scale, round(arg_max(f, w) * k, 6) as tx, case k when 0 then 1.0 when 1 then 0.67 else 0.78 end::double as confidence_score
    from p, (select unnest([0, 1, 2]) k) group by scene, k""")
def q19(t):
    z, o, k = F.lit(0.0), F.lit(1.0), F.col("frame")
    cam = cams(t).select("scene", "frame", F.array(o, z, z, k * 1.0, z, o, z, z, z, z, o, z, z, z, z, o).alias("camera_to_world"), F.when(k == 2, 4.0).otherwise(1.0).alias("depth_confidence"))
    a = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    con = t.supplier.select(F.col("s_suppkey").alias("scene"), a.alias("a"))
    c, s = math.cos(math.radians(60)), math.sin(math.radians(60))
    f = F.lit(2.0) + F.col("scene") % 5 + F.when(F.col("a") == 1, 1).otherwise(0)
    bad = F.array(F.lit(c), F.lit(-s), z, F.lit(50.0), F.lit(s), F.lit(c), z, z, z, z, o, z, z, z, z, o)
    con = con.select("scene", F.when(F.col("a") == 2, 0).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == 2, 2).otherwise(F.col("a") + 1).alias("b"),
                     F.when(F.col("a") == 2, bad).otherwise(F.array(o, z, z, f, z, o, z, z, z, z, o, z, z, z, z, o)).alias("transform"), F.when(F.col("a") == 0, 0.9).otherwise(0.2).alias("confidence"))
    anchors = t.supplier.select(F.col("s_suppkey").alias("scene"), F.lit(0).alias("anchor"))
    out = pt.calibrate_cameras(cam, con, anchors, scene=["scene"], frame="frame")
    return out.select("scene", "frame", *r6("metric_scale"), F.round(F.col("transform")[3], 6).alias("tx"), *r6("confidence_score"))


@query("q20_weighted_median", """
    with c as (select l_partkey, l_discount, sum(l_quantity) w from lineitem group by all),
    k as (select *, sum(w) over (partition by l_partkey order by l_discount) cw, sum(w) over (partition by l_partkey) tw from c)
    select l_partkey, min(l_discount) as middle from k where cw >= tw / 2 group by l_partkey""")
def q20(t):
    return weighted_median(t.lineitem, ["l_partkey"], "l_discount", F.col("l_quantity"), "middle")


@query("q21_even_sample", """
    with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 pos, count(*) over (partition by user_id) n from events),
    g as (select distinct user_id, n, case when i = 9 then n - 1 else floor(i * ((n - 1) / 9.0::double)) end::bigint pos, i from (select distinct user_id, n from r), (select unnest(generate_series(0, 9)) i))
    select r.user_id, r.event_id, g.i as sample_pos from r join g on g.user_id = r.user_id and g.pos = r.pos""")
def q21(t):
    return even_sample(t.events, ["user_id"], [F.col("event_id")], 10, slice_by=F.floor(F.col("event_id") / 100_000)).select("user_id", "event_id", "sample_pos")


@query("q22_capture_envelope", """
    with c as (select s_nationkey scene, s_suppkey cam, (s_suppkey % 17) * 1.0::double x, (s_suppkey % 11) * 1.0::double y from supplier),
    sp as (select a.scene, a.cam, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) d from c a join c b on a.scene = b.scene and a.cam <> b.cam group by all),
    m as (select scene, greatest(2, 3 * list_sort(list(d))[len(list(d)) // 2 + 1]) radius from sp group by scene),
    q as (select c_nationkey scene, c_custkey, min(sqrt(pow(c_custkey % 40 - x, 2) + pow(c_custkey % 23 - y, 2))) d from customer join c on c.scene = c_nationkey group by all)
    select q.scene, c_custkey, round(d, 6) as nearest_distance, round(radius, 6) as measured_radius, d > radius as outside from q join m on m.scene = q.scene""")
def q22(t):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    cam = t.supplier.select(F.col("s_nationkey").alias("scene"), k.alias("cam"), (k % 17).cast("double").alias("px"), (k % 11).cast("double").alias("py"), F.lit(0.0).alias("pz"))
    qs = t.customer.select(F.col("c_nationkey").alias("scene"), "c_custkey", (c % 40).cast("double").alias("px"), (c % 23).cast("double").alias("py"), F.lit(0.0).alias("pz"))
    return pt.capture_envelope(cam, qs, scene="scene", camera="cam", query="c_custkey").select("scene", "c_custkey", *r6("nearest_distance", "measured_radius"), "outside")


@query("q24_scene_summary", """
    with f as (select l_orderkey scene, count(distinct l_linenumber) frames, count(distinct case when l_discount > 0.03 then l_linenumber end) connected, avg(l_tax) mtc, count(*) points from lineitem group by 1)
    select scene, frames, connected, round(mtc, 6) as mean_tree_confidence, points, case when connected < 2 then 'failed' when connected < frames then 'partial' else 'connected' end as status, connected >= greatest(2, ceil(frames / 2)) as representative from f""")
def q24(t):
    l = t.lineitem.withColumnRenamed("l_orderkey", "scene")
    frames = l.groupBy("scene", "l_linenumber").agg(F.bool_or(F.col("l_discount") > 0.03).alias("placed"))
    out = pt.scene_summary(frames, l.withColumn("confidence", F.col("l_tax")), l, scene="scene")
    return out.select("scene", "frames", "connected", *r6("mean_tree_confidence"), "points", "status", "representative")


@query("q08_refined_poses")
def q08(t):
    """Three cameras per supplier in a loop that does not quite close; lines are shared points."""
    z, o, k = F.lit(0.0), F.lit(1.0), F.col("s_suppkey")
    def shift(x):
        return F.array(o, z, z, x, z, o, z, z, z, z, o, z, z, z, z, o)

    pose = cams(t).select("scene", "frame", shift(F.col("frame") * 1.0).alias("pose"))
    i = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    e = t.supplier.select(k.alias("scene"), i.alias("i"))
    e = e.select("scene", F.when(F.col("i") == 1, 1).otherwise(0).alias("a"), F.when(F.col("i") == 0, 1).otherwise(2).alias("b"),
                 shift(F.when(F.col("i") == 2, F.lit(2.1) + F.col("scene") % 7 * 0.02).otherwise(F.lit(1.0))).alias("transform"), F.lit(0.9).alias("confidence"))
    c = cloud(t).select("scene", "idx", "x", "y", "z", (F.col("frame") % 3).alias("i"))
    p = c.select("scene", F.when(F.col("i") == 1, 1).otherwise(0).alias("a"), F.when(F.col("i") == 0, 1).otherwise(2).alias("b"), "idx",
                 (F.col("x") + F.when(F.col("i") == 2, 2.1).otherwise(1.03)).alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"),
                 F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    anchors = t.supplier.select(k.alias("scene"), F.lit(0).alias("anchor"))
    poses, report = refine_poses(pose, e, p, anchors, scene=["scene"], frame="frame")
    out = poses.join(report, "scene")
    return out.select("scene", "frame", F.round(F.col("pose")[3], 4).alias("px"), "optimised", *r6("point_before", "point_after", digits=4))
