"""Plan drawings from lines: an order line is a drawn segment or a printed token of a sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import drawings as dr
from proofgrid.operators.graph import meeting_distances
from proofgrid.operators.labels import site_sheets
from proofgrid.operators.ranking import top_k
from proofgrid.plans.address import pick
from proofgrid.plans.labels import tokens as order_tokens
from proofgrid.plans.registry import query
from proofgrid.plans.scenes import folded

W, H = 1000, 800
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
SEG = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)"


def seg_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in KEY])


def segments(t):
    """Axis-aligned strokes on the sheet of a supplier, short to long."""
    p, q = F.col("l_partkey"), F.col("l_quantity")
    flat = F.col("l_linenumber") % 2 == 0
    x, y, n = (p * 13 % 900).cast("double"), (F.col("l_orderkey") * 7 % 700).cast("double"), q * 4
    back = F.col("l_returnflag") == "R"
    return t.lineitem.select(
        F.col("l_suppkey").alias("sheet"), seg_id().alias("seg"), F.when(back & flat, x + n).otherwise(x).alias("x1"), y.alias("y1"),
        F.when(back & flat, x).when(flat, x + n).otherwise(x).alias("x2"), F.when(flat, y).otherwise(y + n).alias("y2"),
        F.lit(W).alias("w"), F.lit(H).alias("h"), F.lit(min(W, H)).alias("size"))


SEGMENTS = f"""
    raw as (select l_suppkey sheet, {SEG} seg, l_linenumber % 2 = 0 flat, (l_partkey * 13 % 900)::double x, (l_orderkey * 7 % 700)::double y, l_quantity * 4 n, l_returnflag = 'R' and l_linenumber % 2 = 0 back from lineitem),
    sg as (select sheet, seg, x x1, y y1, case when flat then x + n else x end x2, case when flat then y else y + n end y2, n, back from raw)"""


def tokens(t):
    """Parts as printed tokens of the sheet of their brand."""
    p = F.col("p_partkey")
    cx, cy = (p * 29 % 980).cast("double"), (p * 17 % 780).cast("double")
    return t.part.select(
        F.col("p_size").cast("bigint").alias("sheet"), p.alias("pos"), pick(["KITCHEN", "STAIRS UP", "UPPER LEVEL", "12 FT", "BED ROOM"], p % 5).alias("text"),
        (F.lit(0.8) + (p % 17) / 100).alias("score"), cx.alias("cx"), cy.alias("cy"), (cx - 20).alias("bx0"), (cy - 8).alias("by0"), (cx + 20).alias("bx1"), (cy + 8).alias("by1"))


TOKENS = """tk as (select p_size::bigint sheet, p_partkey pos, p_partkey % 5 k, 0.8 + (p_partkey % 17) / 100.0 score, (p_partkey * 29 % 980)::double cx, (p_partkey * 17 % 780)::double cy from part)"""


@query("f01_normal_segments", f"with {SEGMENTS} select sheet, seg, x1, y1, x2, y2 from sg where n >= 36")
def f01(t):
    return dr.normal_segments(segments(t), width="w", height="h").select("sheet", "seg", "x1", "y1", "x2", "y2")


@query("f02_merged_intervals", """
    with d as (select distinct l_suppkey, date_diff('day', date '1990-01-01', l_shipdate::date)::bigint s, date_diff('day', date '1990-01-01', l_shipdate::date)::bigint + l_linenumber e from lineitem),
    m as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) pe from d),
    i as (select *, sum(case when pe is null or s > pe + 2 then 1 else 0 end) over (partition by l_suppkey order by s, e rows unbounded preceding) island from m)
    select l_suppkey, min(s) as first_day, max(e) as last_day from i group by l_suppkey, island""")
def f02(t):
    day = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("bigint")
    d = t.lineitem.select("l_suppkey", day.alias("first_day"), (day + F.col("l_linenumber")).alias("last_day"))
    return dr.merge_intervals(d, keys=["l_suppkey"], start="first_day", end="last_day", gap=2).select("l_suppkey", "first_day", "last_day")


@query("f02_merged_lines", f"""
    with {SEGMENTS}, s as (select distinct sheet, floor((case when x1 = x2 then -x1 else y1 end) / 7.0) lane, x1 = x2 as upright, case when x1 = x2 then y1 else x1 end s, case when x1 = x2 then y2 else x2 end e, x1, y1 from sg where n >= 36),
    m as (select *, max(e) over (partition by sheet, upright, lane order by s, e rows between unbounded preceding and 1 preceding) pe from s),
    i as (select *, sum(case when pe is null or s > pe + 14 then 1 else 0 end) over (partition by sheet, upright, lane order by s, e rows unbounded preceding) island from m),
    g as (select sheet, upright, lane, island, min(s) s, max(e) e from i group by all)
    select sheet, upright, count(*) as walls, round(sum(e - s), 3) as total_length from g group by sheet, upright""")
def f02_lines(t):
    merged = dr.merge_collinear(dr.normal_segments(segments(t), width="w", height="h"), keys=["sheet"])
    return merged.groupBy("sheet", (F.col("sector") != 0).alias("upright")).agg(
        F.count(F.lit(1)).alias("walls"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total_length"))


@query("f03_stair_runs")
def f03(t):
    """Short treads stacked by line number on the sheet of an order."""
    y = F.col("l_linenumber") * 12.0
    s = t.lineitem.select(
        F.col("l_orderkey").alias("sheet"), seg_id().alias("seg"), F.lit(100.0).alias("x1"), y.alias("y1"), (F.lit(130.0) + F.col("l_quantity") / 5).alias("x2"), y.alias("y2"), F.lit(800).alias("size"))
    out = dr.stair_runs(s, keys=["sheet"], seg="seg", size="size")
    return out.select("sheet", "treads", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


BOUNDS = """
    bd as (select s_suppkey sheet, coalesce(greatest(0, min(least(x1, x2)) - 12), 40) l, coalesce(greatest(0, min(least(y1, y2)) - 12), 32) t, coalesce(least(1000, max(greatest(x1, x2)) + 12), 960) r, coalesce(least(800, max(greatest(y1, y2)) + 12), 768) b
      from supplier left join sg on sheet = s_suppkey group by 1)"""


def bounds(t):
    sheets = t.supplier.select(F.col("s_suppkey").alias("sheet"), F.lit(W).alias("w"), F.lit(H).alias("h"))
    return dr.drawing_bounds(segments(t), sheets, keys=["sheet"], width="w", height="h")


@query("f04_drawing_bounds", f'with {SEGMENTS}, {BOUNDS} select sheet, l as "left", t as top, r as "right", b as bottom from bd')
def f04(t):
    return bounds(t).select("sheet", "left", "top", "right", "bottom")


@query("f04_shared_bounds", f"""
    with {SEGMENTS}, {BOUNDS} select sheet % 10 as case_id, round(greatest(0, min(l / 1000) - 0.006), 6) as "left", round(greatest(0, min(t / 800) - 0.006), 6) as top, round(least(1, max(r / 1000) + 0.006), 6) as "right", round(least(1, max(b / 800) + 0.006), 6) as bottom from bd group by 1""")
def f04_shared(t):
    b = bounds(t).withColumn("case_id", F.col("sheet") % 10)
    out = dr.shared_bounds(b, case=["case_id"], width="w", height="h")
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")])


def box():
    return F.col("left"), F.col("top"), F.col("right"), F.col("bottom")


@query("f05_world_points", f"""
    with {SEGMENTS}, {BOUNDS}, m as (select *, 14.0::double / greatest(1, r - l, b - t) s from bd)
    select sg.sheet, seg, round_even((case when back then x2 else x1 end - (l + r) / 2) * s, 4) as wx, round_even((y1 - (t + b) / 2) * s, 4) as wy from sg join m on m.sheet = sg.sheet""")
def f05(t):
    j = segments(t).join(bounds(t).drop("w", "h"), "sheet")
    world = dr.world_polygon(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), box())[0]
    return j.select("sheet", "seg", world.alias("p")).select("sheet", "seg", F.col("p.x").alias("wx"), F.col("p.y").alias("wy"))


@query("f06_structural_segments", f"""
    with {SEGMENTS}, {TOKENS}, s as (select sg.*, (x1 + x2) / 2 mx, (y1 + y2) / 2 my from sg where n >= 36)
    select sheet, seg from s where not exists (select 1 from tk where tk.sheet = s.sheet and n < 304 and abs(mx - cx) <= 23 and abs(my - cy) <= 11)
      and not exists (select 1 from tk where tk.sheet = s.sheet and k = 1 and n < 144 and abs(mx - cx) <= 38 and abs(my - cy) <= 53)""")
def f06(t):
    return dr.structural_segments(segments(t), tokens(t), keys=["sheet"], seg="seg", size="size").select("sheet", "seg")


@query("f07_connected_segments", f"""
    with {SEGMENTS}, s as (select * from sg),
    p as (select a.sheet, a.seg, least(
        sqrt(pow(a.x1 - greatest(b.x1, least(b.x2, a.x1)), 2) + pow(a.y1 - greatest(b.y1, least(b.y2, a.y1)), 2)), sqrt(pow(a.x2 - greatest(b.x1, least(b.x2, a.x2)), 2) + pow(a.y2 - greatest(b.y1, least(b.y2, a.y2)), 2)),
        sqrt(pow(b.x1 - greatest(a.x1, least(a.x2, b.x1)), 2) + pow(b.y1 - greatest(a.y1, least(a.y2, b.y1)), 2)), sqrt(pow(b.x2 - greatest(a.x1, least(a.x2, b.x2)), 2) + pow(b.y2 - greatest(a.y1, least(a.y2, b.y2)), 2))) d
      from s a join s b on a.sheet = b.sheet and a.seg <> b.seg)
    select sheet, seg from s where n >= 300 or exists (select 1 from p where p.sheet = s.sheet and p.seg = s.seg and d <= 20)""")
def f07(t):
    return dr.connected_segments(segments(t), keys=["sheet"], seg="seg", width="w", height="h").select("sheet", "seg")


@query("f08_wall_records", f"""
    with {SEGMENTS}, {BOUNDS}, m as (select *, 14.0::double / greatest(1, r - l, b - t) s from bd)
    select sg.sheet, seg, round((x1 - (l + r) / 2) * s, 3) as sx, 2.7 as height_m, n * s / 80 + 0.42 + 0.34 * least(1, 0.3 / 0.6) <= 0.82 as below_cap from sg join m on m.sheet = sg.sheet where n * s >= 0.45""")
def f08(t):
    walls = dr.wall_records(segments(t).drop("w", "h").join(bounds(t), "sheet"), box=box(), support=F.lit(0.3))
    scale = dr.metres_per_pixel(*box())
    left = F.least("x1", "x2")
    return walls.select("sheet", "seg", F.round((left - (F.col("left") + F.col("right")) / 2) * scale, 3).alias("sx"), "height_m", (F.col("confidence") <= 0.82).alias("below_cap"))


def zones(t):
    """Customers as rectangular zones of the sheet of their balance."""
    k = F.col("c_custkey")
    x, y = (k * 31 % 900).cast("double"), (k * 19 % 700).cast("double")
    w, h = (k % 7 * 20 + 20).cast("double"), (k % 5 * 20 + 20).cast("double")
    return t.customer.select((k % 50 + 1).alias("sheet"), k.alias("zone"), x.alias("zl"), y.alias("zt"), (x + w).alias("zr"), (y + h).alias("zb"), (w * h).alias("area"))


ZONES = """zn as (select c_custkey % 50 + 1 sheet, c_custkey as zone, (c_custkey * 31 % 900)::double zl, (c_custkey * 19 % 700)::double zt, (c_custkey % 7 * 20 + 20)::double w, (c_custkey % 5 * 20 + 20)::double h from customer)"""


@query("f09_labelled_zones", f"""
    with {ZONES}, {TOKENS}, rk as (select *, row_number() over (partition by sheet order by zone) rn, row_number() over (partition by sheet order by w * h desc, zone)::int zone_rank from zn),
    b as (select zn.sheet, zn.zone, arg_max((k, score), (score, -pos)) best from zn join tk on tk.sheet = zn.sheet and k in (0, 4) and cx between zl and zl + w and cy between zt and zt + h group by all)
    select rk.sheet, rk.zone, zone_rank, coalesce(case best[1] when 0 then 'KITCHEN' when 4 then 'BED ROOM' end, 'Unlabeled space ' || rn) as label from rk left join b on b.sheet = rk.sheet and b.zone = rk.zone where zone_rank <= 30""")
def f09(t):
    out = dr.label_zones(zones(t), tokens(t), keys=["sheet"], zone="zone", box=("zl", "zt", "zr", "zb"), area="area",
                         slice_by=F.floor(F.col("zone") / 10_000))
    return out.select("sheet", "zone", "zone_rank", "label")


@query("f10_admitted_zones", f"with {ZONES} select sheet, zone from zn where zl > 20 and w * h between 720000 * 0.012 and 720000 * 0.7")
def f10(t):
    return dr.admitted_zones(zones(t), touches=F.col("zl") <= 20, area="area", drawing_area=F.lit(720000.0)).select("sheet", "zone")


@query("f11_plan_labels_features", f"""
    with {TOKENS} select 'label' as kind, sheet, pos, round((cx - 500) * 0.014, 4) as x, round((cy - 400) * 0.014, 4) as y from tk where k in (0, 4)
    union all select 'stairs', sheet, pos, round((cx - 20 - 28 - 500) * 0.014, 4), round((cy - 8 - 19.2 - 400) * 0.014, 4) from tk where k = 1""")
def f11(t):
    sheet = (F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(800.0))
    labels = dr.plan_labels(tokens(t), box=sheet).select(F.lit("label").alias("kind"), "sheet", "pos", F.col("wx").alias("x"), F.col("wy").alias("y"))
    stairs = dr.plan_features(tokens(t), box=sheet).select(F.lit("stairs").alias("kind"), "sheet", "pos", F.col("fx0").alias("x"), F.col("fy0").alias("y"))
    return labels.unionByName(stairs)


@query("f12_space_graph", f"""
    with l as (select l_suppkey sheet, l_orderkey, l_linenumber a, l_partkey from lineitem),
    d as (select x.sheet, x.a, y.a as b, min(x.l_orderkey % 1000) as steps, x.a || '|' || y.a as pos from l x join l y on x.sheet = y.sheet and x.l_partkey = y.l_partkey and x.a < y.a group by all),
    {folded("d", "e.steps, e.a, e.b", "sheet")},
    n as (select sheet, count(distinct a) as nodes from l group by sheet), k as (select sheet, count(*) as edges from forest group by sheet)
    select f.sheet, f.a, f.b, f.steps, false as verified, edges = nodes - 1 as connected from forest f join n on n.sheet = f.sheet join k on k.sheet = f.sheet""")
def f12(t):
    """Spaces of a supplier are line numbers; steps between neighbours come from the ordered parts."""
    l = t.lineitem.select(F.col("l_suppkey").alias("sheet"), "l_orderkey", F.col("l_linenumber").alias("a"), "l_partkey")
    nxt = l.select("sheet", F.col("l_partkey").alias("l_partkey"), F.col("a").alias("b"))
    d = l.join(nxt, ["sheet", "l_partkey"]).filter("a < b").groupBy("sheet", "a", "b").agg(F.min(F.col("l_orderkey") % 1000).alias("steps"))
    forest, state = dr.space_graph(d, l.select("sheet", "a").distinct(), keys=["sheet"], a="a", b="b", steps="steps")
    return forest.join(state, "sheet").select("sheet", "a", "b", "steps", "verified", "connected")


@query("f12_label_paths", f"""
    with recursive c as (select distinct l_suppkey % 10 as sheet, l_partkey % 40 as x, l_orderkey // 7 % 30 as y from lineitem where l_discount < 0.04),
    p as (select s_suppkey % 10 as sheet, s_suppkey as seed, s_suppkey * 3 % 40 as sx, s_suppkey * 5 % 30 as sy from supplier qualify row_number() over (partition by s_suppkey % 10 order by s_suppkey) <= 36),
    r as (select p.sheet, seed, c.x, c.y, greatest(abs(c.x - sx), abs(c.y - sy)) as ring, pow(c.x - sx, 2) + pow(c.y - sy, 2) as d2 from p join c on c.sheet = p.sheet),
    seeds as (select sheet, seed, arg_min(x, (ring, d2, x, y)) as x, arg_min(y, (ring, d2, x, y)) as y from r where ring <= 24 group by all),
    walk(sheet, seed, x, y, steps) using key (sheet, seed, x, y) as (select sheet, seed, x, y, 0 from seeds
      union select w.sheet, w.seed, c.x, c.y, min(w.steps) + 1 from walk w join c on c.sheet = w.sheet and abs(c.x - w.x) + abs(c.y - w.y) = 1
        left join recurring.walk o on o.sheet = w.sheet and o.seed = w.seed and o.x = c.x and o.y = c.y where o.steps is null group by w.sheet, w.seed, c.x, c.y),
    d as (select w.sheet, w.seed as a, s.seed as b, min(w.steps) as steps, w.seed || '|' || s.seed as pos from walk w join seeds s on s.sheet = w.sheet and s.x = w.x and s.y = w.y and w.seed < s.seed group by all),
    {folded("d", "e.steps, e.a, e.b", "sheet")},
    n as (select sheet, count(*) as nodes from seeds group by sheet), k as (select sheet, count(*) as edges from forest group by sheet)
    select f.sheet, f.a, f.b, f.steps, edges = nodes - 1 as connected from forest f join n on n.sheet = f.sheet join k on k.sheet = f.sheet""")
def f12_paths(t):
    """Labels snapped to passable cells, their distances by wavefronts, and the shortest forest over them."""
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    cells = t.lineitem.filter("l_discount < 0.04").select((F.col("l_suppkey") % 10).alias("sheet"), (part % 40).alias("x"), (F.floor(order / 7) % 30).alias("y")).distinct()
    k = F.col("s_suppkey")
    labels = top_k(t.supplier.select((k % 10).alias("sheet"), k.alias("seed"), (k * 3 % 40).alias("x"), (k * 5 % 30).alias("y")),
                   ["sheet"], [F.col("seed")], dr.MAX_SPACES).drop("rank")
    seeds = dr.snap_seeds(labels, cells, keys=["sheet"], seed="seed", x="x", y="y")
    steps = meeting_distances(cells, seeds, group=["sheet"], seed="seed", x="x", y="y")
    forest, state = dr.space_graph(steps, seeds, keys=["sheet"], a="a", b="b", steps="steps")
    return forest.join(state, "sheet").select("sheet", "a", "b", "steps", "connected")


def components(t):
    """Order lines as drawn components of the sheet of their order."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    left, top = n * 120.0, (p % 4) * 150.0
    return t.lineitem.select(F.col("l_orderkey").alias("sheet"), seg_id().alias("comp"), left.alias("left"), top.alias("top"), (left + F.col("l_quantity") * 8).alias("right"),
                             (top + 60 + F.col("l_quantity") * 4).alias("bottom"), (F.col("l_extendedprice") / 4).alias("ink"), F.lit(W).alias("w"), F.lit(H).alias("h"))


COMPONENTS = f"""cp as (select l_orderkey sheet, {SEG} comp, l_linenumber * 120.0::double l, (l_partkey % 4) * 150.0::double t, l_quantity * 8 w, 60 + l_quantity * 4 h, l_extendedprice / 4 ink from lineitem),
    ac as (select * from (select *, row_number() over (partition by sheet order by ink desc, comp)::int component_rank from cp where w * h >= 20000 and w >= 120 and h >= 120 and ink / (w * h) >= 0.08 and not (w > 850 and h > 680)) where component_rank <= 8)"""


@query("f13_panels", f"""
    with {COMPONENTS}, an as (select o_orderkey sheet, i, (o_custkey * 7 % 900 + i * 40)::double x, (o_custkey * 3 % 700)::double y from orders, (select unnest([1, 2]) i)),
    k as (select sheet, count(*) n from ac group by 1), d as (select an.sheet, i, comp, component_rank r, sqrt(pow(greatest(l - x, 0, x - l - w), 2) + pow(greatest(t - y, 0, y - t - h), 2)) d from an join ac using (sheet) join k using (sheet) where n >= 2),
    one as (select sheet, arg_min(comp, (d, r)) c1 from d where i = 1 group by 1), two as (select d.sheet, c1, arg_min(comp, (d, r)) c2 from d join one on one.sheet = d.sheet where i = 2 and comp <> c1 group by all)
    select sheet, 1 as anchor, c1 as comp from two union all select sheet, 2, c2 from two""")
def f13(t):
    admitted = dr.admitted_components(components(t), sheet=["sheet"], width="w", height="h", order=[F.col("comp")])
    i = F.explode(F.array(F.lit(1), F.lit(2)))
    anchors = t.orders.select(F.col("o_orderkey").alias("sheet"), i.alias("anchor"), "o_custkey").select(
        "sheet", "anchor", (F.col("o_custkey") * 7 % 900 + F.col("anchor") * 40).cast("double").alias("cx"), (F.col("o_custkey") * 3 % 700).cast("double").alias("cy"))
    return dr.split_panels(anchors, admitted, sheet=["sheet"], anchor="anchor", box_id="comp").select("sheet", "anchor", "comp")


@query("f14_tokens_in_crops", f"""
    with {ZONES}, {TOKENS} select zn.sheet, zone, pos, cx - zl as cx, cy - 8 - zt as by0 from zn join tk on tk.sheet = zn.sheet and cx between zl and zl + w and cy between zt and zt + h where k <> 2""")
def f14(t):
    crops = zones(t).select("sheet", "zone", F.col("zl").alias("left"), F.col("zt").alias("top"), F.col("zr").alias("right"), F.col("zb").alias("bottom"))
    return dr.tokens_in_crop(tokens(t), crops, keys=["sheet"], crop="zone").select("sheet", "zone", "pos", "cx", "by0")


@query("f15_admitted_components", f"with {COMPONENTS} select sheet, comp, component_rank from ac")
def f15(t):
    out = dr.admitted_components(components(t), sheet=["sheet"], width="w", height="h", order=[F.col("comp")])
    return out.select("sheet", "comp", "component_rank")


@query("f16_topology_status", """
    select p_size as sheet, case when count(*) filter (p_partkey % 3 = 0) > 0 and count(*) filter (p_partkey % 2 = 0) / count(*) >= 0.55 then 'candidate' else 'source_plan_only' end as status from part group by 1""")
def f16(t):
    p = F.col("p_partkey")
    g = t.part.groupBy(F.col("p_size").alias("sheet")).agg(F.count_if(p % 3 == 0).alias("z"), F.count_if(p % 2 == 0).alias("e"), F.count(F.lit(1)).alias("n"))
    return g.select("sheet", dr.topology_status(F.col("z"), F.col("e"), F.col("n")).alias("status"))


@query("f17_stacked_floors", """
    with f as (select distinct o_custkey, (o_orderkey % 9 - 2)::int n from orders)
    select o_custkey, n, row_number() over (partition by o_custkey order by n) - 1 as floor_index, round((n - min(n) over (partition by o_custkey)) * 3.05, 3) as elevation_m, round((max(n) over (partition by o_custkey) - min(n) over (partition by o_custkey)) * 3.05 + 3.05, 3) as roof_m from f""")
def f17(t):
    f = t.orders.select("o_custkey", (F.col("o_orderkey") % 9 - 2).cast("int").alias("n")).distinct()
    return dr.stack_floors(f, case=["o_custkey"], number="n", order="n")


@query("f18_reference_sheets", """
    with s as (select l_orderkey, bool_or(l_partkey % 8 = 6) and not bool_or(l_partkey % 8 in (2, 3, 7)) site from lineitem group by 1)
    select 'reference' as part, count(*) as sheets from orders join s on l_orderkey = o_orderkey where site union all select 'floor', count(*) from orders left join s on l_orderkey = o_orderkey where not coalesce(site, false)""")
def f18(t):
    site = site_sheets(order_tokens(t), sheet="l_orderkey", text="text", position="l_linenumber")
    floors, refs = dr.split_references(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), site, keys=["l_orderkey"])
    return refs.agg(F.count(F.lit(1)).alias("sheets")).select(F.lit("reference").alias("part"), "sheets").unionByName(
        floors.agg(F.count(F.lit(1)).alias("sheets")).select(F.lit("floor").alias("part"), "sheets"))


@query("f19_snapped_seeds", """
    with c as (select distinct l_suppkey g, l_partkey % 100 x, l_orderkey % 80 y from lineitem where l_discount < 0.03), s as (select s_suppkey g, s_suppkey * 3 % 120 x, s_suppkey * 5 % 90 y from supplier),
    d as (select s.g, c.x, c.y, greatest(abs(c.x - s.x), abs(c.y - s.y)) ring, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) d2 from s join c on c.g = s.g)
    select g, arg_min(x, (ring, d2, x, y)) as x, arg_min(y, (ring, d2, x, y)) as y from d where ring <= 24 group by g""")
def f19(t):
    cells = t.lineitem.filter("l_discount < 0.03").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_orderkey") % 80).alias("y")).distinct()
    k = F.col("s_suppkey")
    seeds = t.supplier.select(k.alias("g"), k.alias("seed"), (k * 3 % 120).alias("x"), (k * 5 % 90).alias("y"))
    return dr.snap_seeds(seeds, cells, keys=["g"], seed="seed", x="x", y="y").select("g", "x", "y")
