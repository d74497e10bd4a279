"""Catalogue and status rules on orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import catalog as cat
from proofgrid.plans.address import pick
from proofgrid.plans.registry import query

ROOMS = ["bedroom", "bathroom", "kitchen", "exterior", "unknown"]


def art(t):
    """Orders as artifacts of their customer."""
    return t.orders.select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "floorplan").when(F.col("o_orderpriority") == "1-URGENT", "single_image").otherwise("multi_image").alias("mode"),
        (F.col("o_orderkey") % 6 == 0).alias("is_fallback"))


ART = """art as (select o_custkey, o_orderkey, case o_orderstatus when 'F' then 'ready' when 'P' then 'failed' else 'running' end status,
      case o_orderpriority when '5-LOW' then 'floorplan' when '1-URGENT' then 'single_image' else 'multi_image' end as mode, o_orderkey % 6 = 0 as is_fallback from orders)"""


@query("c01_scene_of_nodes", """
    with ready as (select o_orderkey from orders where o_orderstatus = 'F'), reg as (select distinct l_orderkey scene, l_partkey src from lineitem where l_linenumber <= 5 and l_orderkey in (select o_orderkey from ready)),
    n as (select p_partkey node, p_partkey * 7 % 15000 direct, p_partkey src from part),
    sh as (select node, min(scene) shared from n join reg using (src) group by 1)
    select n.node, coalesce(r.o_orderkey, shared) as scene_id from n left join ready r on r.o_orderkey = n.direct left join sh on sh.node = n.node""")
def c01(t):
    scenes = t.orders.filter("o_orderstatus = 'F'").select(F.lit(1).alias("c"), F.col("o_orderkey").alias("scene"), F.col("o_orderkey").alias("pos"))
    reg = t.lineitem.filter("l_linenumber <= 5").select(F.lit(1).alias("c"), F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("source_id")).distinct()
    nodes = t.part.select(F.lit(1).alias("c"), F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7 % 15000).alias("direct"), F.array("p_partkey").alias("src"))
    return cat.scene_of_nodes(nodes, scenes, reg, case="c", node="node", direct="direct", source="src", scene="scene", pos="pos").select("node", "scene_id")


LABELS = """lab as (select p_brand c, p_size % 3 as floor, p_partkey label, case p_partkey % 60 when 0 then 'bedroom' when 1 then 'kitchen' when 2 then 'bathroom' end room from part),
    nod as (select distinct p_brand c, p_partkey scene, case p_partkey % 80 when 4 then 'bedroom' when 5 then 'kitchen' else 'hallway' end room from part),
    k as (select c, room, count(*) n, arg_min(scene, (-(scene % 9), scene)) first from nod group by all),
    s as (select c, floor, room, count(*) st from lab where room is not null group by all)"""


@query("c02_plan_rooms", f"""
    with {LABELS} select lab.c, lab.floor, lab.label, lab.room, coalesce(st, 1) as same_type, coalesce(n, 0) as candidates,
      case when lab.room is null then 'no_room_type' when n is null then 'no_scene' when st > 1 then 'label_repeats' when n > 1 then 'several_scenes' else 'unique_match' end as detail,
      case when lab.room is not null and n = 1 and st = 1 then first end as scene_id
    from lab left join s on s.c = lab.c and s.floor = lab.floor and s.room = lab.room left join k on k.c = lab.c and k.room = lab.room""")
def c02(t):
    p = F.col("p_partkey")
    labels = t.part.select(F.col("p_brand").alias("c"), (F.col("p_size") % 3).alias("floor"), p.alias("label"), F.when(p % 60 < 3, pick(["bedroom", "kitchen", "bathroom"], p % 60)).alias("room"))
    nodes = t.part.select(F.col("p_brand").alias("c"), p.alias("scene_id"), F.when(p % 80 == 4, "bedroom").when(p % 80 == 5, "kitchen").otherwise("hallway").alias("room"), F.lit("room").alias("kind"))
    views = nodes.select("c", "scene_id", (F.col("scene_id") % 9).alias("views"))
    return cat.resolve_plan_rooms(labels, nodes, views, case="c", label="label", room="room").drop("available")


@query("c03_same_type_labels", """
    with l as (select p_brand, p_partkey, case when p_partkey % 4 < 3 then p_type end room from part)
    select p_brand, p_partkey, case when room is null then 1 else count(*) over (partition by p_brand, room) end::bigint as same_type from l""")
def c03(t):
    labels = t.part.select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 4 < 3, F.col("p_type")).alias("room"))
    return cat.same_type_counts(labels, keys=["p_brand"], room="room").select("p_brand", "p_partkey", "same_type")


@query("c04_scene_labels", f"""
    with {ART}, ph as (select o_custkey, l_orderkey, case l_partkey % 5 when 0 then 'bedroom' when 1 then 'bathroom' when 2 then 'kitchen' when 3 then 'exterior' else 'unknown' end room, l_returnflag <> 'R' as ext, l_linenumber from lineitem join orders on o_orderkey = l_orderkey),
    f as (select l_orderkey, count(*) views, bool_and(ext and room not in ('bedroom', 'bathroom', 'kitchen')) all_ext, min(l_linenumber) ord from ph group by 1),
    v as (select l_orderkey, room, count(*) n from ph where room not in ('exterior', 'unknown') group by all), mx as (select l_orderkey, max(n) m from v group by 1),
    w as (select v.l_orderkey, case when count(*) = 1 then min(room) end room from v join mx on mx.l_orderkey = v.l_orderkey and m = n group by 1),
    b as (select art.*, coalesce(views, 1) views, coalesce(ord, 9e15) ord, case when mode = 'floorplan' then 'House map' when all_ext then 'Exterior' when room is not null then upper(room[1]) || room[2:] when is_fallback or mode = 'single_image' then 'Unclassified view' else 'Observed scene' end base
      from art left join f on f.l_orderkey = o_orderkey left join w on w.l_orderkey = o_orderkey),
    r as (select *, row_number() over (partition by o_custkey, base, mode = 'floorplan' order by ord, o_orderkey) rn, count(*) over (partition by o_custkey, base, mode = 'floorplan') total from b)
    select o_custkey, o_orderkey, base, case when mode = 'floorplan' then base || ' · ' || views else base || case when total > 1 then ' ' || rn else '' end || ' · ' || views || case when views = 1 then ' view' else ' views' end end as label from r""")
def c04(t):
    photos = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "o_orderkey", pick(ROOMS, F.col("l_partkey") % 5).alias("room_type"), F.when(F.col("l_returnflag") == "R", "interior").otherwise("exterior").alias("scene_type"), F.col("l_linenumber").alias("capture_order"))
    return cat.scene_labels(art(t), photos, case="o_custkey", scene="o_orderkey", created="o_orderkey")


@query("c05_unavailable_captures", """
    select p_brand, p_type as room_type, count(*) as photos, upper(p_type[1]) || lower(p_type[2:]) as label from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49) group by p_brand, p_type""")
def c05(t):
    photos = t.part.select("p_brand", F.col("p_partkey").alias("l_partkey"), "p_type")
    reg = t.lineitem.filter("l_quantity > 49").select("l_partkey").join(photos.select("p_brand", "l_partkey"), "l_partkey")
    return cat.unavailable_captures(photos, reg, keys=["p_brand"], photo="l_partkey", room="p_type")


@query("c06_ordered_scenes", """
    with n as (select p_brand, p_partkey, p_partkey // 2 scene, case p_partkey % 6 when 0 then 'exterior' else 'room' end kind, case p_partkey % 5 when 0 then 'Attic' when 1 then 'Basement' when 2 then 'Ground floor' when 3 then 'Upper floor' else 'Unknown floor' end fl, p_type from part),
    o as (select * from (select *, row_number() over (partition by p_brand, scene order by p_partkey) rn from n) where rn = 1)
    select p_brand, p_partkey, row_number() over (partition by p_brand order by case when kind = 'exterior' then 0 else case fl when 'Basement' then 1 when 'Ground floor' then 2 when 'Upper floor' then 3 when 'Attic' then 4 else 5 end end, p_type, lpad(p_partkey::varchar, 20, '0'), p_partkey)::int as place from o""")
def c06(t):
    p = F.col("p_partkey")
    n = t.part.select("p_brand", "p_partkey", F.floor(p / 2).alias("scene"), F.when(p % 6 == 0, "exterior").otherwise("room").alias("kind"),
                      pick(["Attic", "Basement", "Ground floor", "Upper floor", "Unknown floor"], p % 5).alias("floor_label"), F.col("p_type").alias("room_type"), F.concat(F.lit("Room "), p.cast("string")).alias("label"))
    return cat.ordered_scenes(n, case="p_brand", node="p_partkey", scene="scene").select("p_brand", "p_partkey", "place")


@query("c08_dashboard", """
    select count(*) filter (o_orderstatus = 'P') as active, count(*) filter (o_orderstatus = 'F') as ready, count(*) filter (o_totalprice > 100000) as mapped from orders where o_orderpriority <> '5-LOW'""")
def c08(t):
    status = F.when(F.col("o_orderpriority") == "5-LOW", "archived").when(F.col("o_orderstatus") == "P", "collecting").when(F.col("o_orderstatus") == "F", "briefing_ready").otherwise("limited_evidence")
    return cat.dashboard(t.orders.select(status.alias("status"), (F.col("o_totalprice") > 100000).alias("has_profile")))


@query("c09_progress", f"""
    with {ART}, s as (select c_custkey, pos, case (c_custkey + pos) % 4 when 0 then 'complete' when 1 then 'running' when 2 then 'failed' else 'pending' end st from customer, (select unnest([0, 1, 2]) pos)),
    g as (select c_custkey, count(*) filter (st in ('complete', 'failed')) done, count(*) filter (pos < 2 and st = 'complete') pre, bool_or(st = 'running') run from s group by 1),
    a as (select o_custkey, count(*) filter (status = 'running') pend, count(*) filter (status = 'ready') ready from art group by 1)
    select c_custkey, (case when coalesce(pend, 0) > 0 then least(99, floor((pre + ready / greatest(1, ready + pend)) / 3 * 100 + 0.5)) else least(100, floor((done + case when run then 0.45 else 0 end) / 3 * 100 + 0.5)) end)::int as progress
    from g left join a on o_custkey = c_custkey""")
def c09(t):
    pos = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    s = t.customer.select("c_custkey", pos.alias("position"))
    s = s.withColumn("status", pick(["complete", "running", "failed", "pending"], (F.col("c_custkey") + F.col("position")) % 4))
    return cat.preparation_progress(s, art(t).withColumnRenamed("o_custkey", "c_custkey"), case="c_custkey")


@query("c11_ready_coverage", f"""
    with {ART}, i as (select l_orderkey, bool_or(l_returnflag = 'R' and l_quantity > 40) ins from lineitem group by 1)
    select o_orderkey, case when mode = 'floorplan' or coalesce(ins, false) then 'interior' else 'exterior' end as side,
      case when mode = 'floorplan' then 0.64 when coalesce(ins, false) then case when mode = 'multi_image' and not is_fallback then 0.56 else 0.42 end when mode = 'multi_image' and not is_fallback then 0.62 else 0.58 end as score
    from art left join i on l_orderkey = o_orderkey""")
def c11(t):
    ev = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "scene:interior").otherwise("other")).alias("tags"))
    return cat.ready_coverage(art(t), ev, artifact="o_orderkey")


@query("c11_exterior_candidates", """
    select l_orderkey, count(*) filter (l_returnflag = 'A' and l_linenumber <> 3) as candidates, case when count(*) filter (l_returnflag = 'A' and l_linenumber <> 3) > 0 then 0.24 else 0.0 end as score from lineitem group by 1""")
def c11_exterior(t):
    ev = t.lineitem.select("l_orderkey", F.lit("image").alias("kind"), F.when(F.col("l_returnflag") == "A", "exterior").otherwise("interior").alias("scene_type"),
                           F.when(F.col("l_linenumber") == 3, "contradictory").otherwise("unknown").alias("address_match"))
    return cat.exterior_candidates(ev, case="l_orderkey")


@query("c12_ready_confidence", f"""
    with {ART} select o_orderkey, round(case when mode = 'floorplan' then 0.64 when is_fallback then 0.52 when mode = 'multi_image' then least(0.68, 0.35 + (o_orderkey % 13) / 12.0 * 0.33) else 0.58 end, 6) as score,
      round(0.45 + (o_orderkey % 4) / 4.0 * 0.2 * 1.15, 4) as manifest from art""")
def c12(t):
    return art(t).select("o_orderkey", F.round(cat.ready_confidence(F.col("mode"), F.col("is_fallback"), (F.col("o_orderkey") % 13) / 12.0), 6).alias("score"),
                         F.round(F.lit(0.45) + (F.col("o_orderkey") % 4) / 4.0 * 0.2 * 1.15, 4).alias("manifest"))


@query("c13_reconciled_statuses", f"""
    with {ART}, r as (select distinct o_custkey from art where status = 'ready'), f as (select l_suppkey c, bool_and(l_discount < 0.1 or l_linenumber > 3) auto from lineitem group by 1)
    select c_custkey, case when c_custkey % 2 = 0 and c_custkey in (select o_custkey from r) and coalesce(auto, true) then 'briefing_ready' when c_custkey % 2 = 0 then 'review_required' else 'collecting' end as status from customer left join f on c = c_custkey""")
def c13(t):
    cases = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "review_required").otherwise("collecting").alias("status"))
    auto = (F.col("l_discount") < 0.1) | (F.col("l_linenumber") > 3)
    found = t.lineitem.select(F.col("l_suppkey").alias("c_custkey"), F.when(auto, cat.GAP_CATEGORY).otherwise("hazard").alias("category"), F.lit(cat.GAP_LABEL).alias("label"))
    return cat.reconcile_statuses(cases, art(t).withColumnRenamed("o_custkey", "c_custkey"), found, case="c_custkey")


@query("c14_workflow_summary", """
    select l_orderkey, count(*) filter (l_returnflag = 'A' and l_linenumber > 2) as scenes, count(*) filter (l_returnflag = 'A' and l_linenumber <= 2) as plan_layers, count(*) filter (l_returnflag = 'R') as failed_groups,
      case when count(*) filter (l_returnflag = 'R') > 0 then 'limited' else 'complete' end as stage_status from lineitem group by 1 having count(*) filter (l_returnflag = 'N') = 0 and count(*) filter (l_returnflag = 'A') > 0""")
def c14(t):
    a = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "A", "ready").when(F.col("l_returnflag") == "R", "failed").otherwise("running").alias("status"),
                          F.when(F.col("l_linenumber") <= 2, "floorplan").otherwise("multi_image").alias("mode"))
    return cat.workflow_summary(a, case="l_orderkey")


@query("c15_final_status", f"""
    with {ART}, f as (select o_custkey, arg_min(status, o_orderkey) st from art where status in ('ready', 'running') group by 1)
    select c_custkey, case when st = 'ready' then 'briefing_ready' when st is not null then 'reconstructing' else 'limited_evidence' end as final_status from customer left join f on o_custkey = c_custkey""")
def c15(t):
    return cat.final_status(t.customer.select("c_custkey"), art(t).withColumnRenamed("o_custkey", "c_custkey"), case="c_custkey", order=[F.col("o_orderkey")])


@query("c16_applied_reviews", """
    with r as (select o_custkey, o_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) rv from lineitem join orders on o_orderkey = l_orderkey where l_discount > 0.05 group by all)
    select o.o_custkey, o.o_orderkey, case rv when 'A' then 'confirmed' when 'R' then 'rejected' when 'N' then 'pending' else 'pending' end as review from orders o left join r on r.o_custkey = o.o_custkey and r.o_orderkey = o.o_orderkey""")
def c16(t):
    items = t.orders.select("o_custkey", "o_orderkey", F.lit("pending").alias("review"))
    log = t.lineitem.filter("l_discount > 0.05").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "o_orderkey", F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("review"), F.lit("").alias("note"), "l_linenumber", "l_partkey", "l_suppkey")
    return cat.apply_reviews(items, log, case="o_custkey", item="o_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey"]).select("o_custkey", "o_orderkey", "review")


@query("c18_patched_cases", """
    with p as (select o_custkey, arg_max(o_orderpriority, o_orderkey) filter (o_orderstatus = 'F') pr, arg_max(o_orderstatus, o_orderkey) filter (o_orderstatus <> 'O') st from orders group by 1)
    select c_custkey, coalesce(pr, c_mktsegment) as incident, coalesce(st, 'new') as role, case when c_custkey % 3 = 0 then 'archived' when c_custkey % 3 = 1 then 'limited_evidence' else 'collecting' end as status from customer left join p on o_custkey = c_custkey""")
def c18(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("incident"), F.lit("new").alias("role"),
                             cat.toggle_archive(F.when(k % 3 == 1, "archived").otherwise("collecting"), k % 3 == 0).alias("status"))
    log = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("incident"),
                          F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("role"))
    return cat.apply_patches(rows, log, key="c_custkey", fields=["incident", "role"], order=["o_orderkey"])
