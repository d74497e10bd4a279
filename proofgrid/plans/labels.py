"""Label cleaning: events carry JSON answers, parts carry printed names."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import labels as lab
from proofgrid.plans.address import pick
from proofgrid.plans.registry import query


@query("l01_json_answers", """
    select event_id, (props->>'k')::int as k, case when event_id % 5 <> 4 then (props->>'k')::int end as k_between from events""")
def l01(t):
    e, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(e == 0, p).when(e == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))) \
        .when(e == 2, F.concat(F.lit("Here it is: "), p, F.lit(" hope that helps"))) \
        .when(e == 3, F.concat(F.lit("note } and "), p)).otherwise(F.concat(F.lit("{ never closed \"}\" "), p, F.lit(" }} {x")))
    raw = F.when(e == 4, F.concat(F.lit("answer "), p, F.lit(" then {x}"))).otherwise(raw)
    out = lab.json_text(t.events.select("event_id", raw.alias("raw")), "raw")
    return out.select("event_id", F.from_json("json", "k int")["k"].alias("k"),
                      F.from_json(lab.json_between_braces(F.col("raw")), "k int")["k"].alias("k_between"))


@query("l02_prose_answers", """
    select event_id, case event_type when 'view' then 'interior' when 'click' then 'exterior' when 'error' then 'non_property' when 'signup' then 'interior' else 'unknown' end as scene_type,
      case event_type when 'view' then 'living_room' when 'signup' then 'bathroom' else 'unknown' end as room_type,
      'unknown' as relevance, 'upper' as floor_hint,
      case when event_id % 2 = 0 then '' else event_id || ' Oak' end as observed_address, case when event_id % 100 <= 1 then event_id % 100 else round((event_id % 100) / 100.0, 6) end as confidence_score,
      'stair_up,door' as connections, 'a view' as summary from events""")
def l02(t):
    k = F.col("event_type")
    scene = F.when(k == "view", "Interior").when(k == "click", "Exterior").when(k == "error", "non property").otherwise("not sure")
    room = F.when(k == "view", "Living room").when(k == "signup", "a Bathroom").otherwise("?")
    text = F.concat(F.lit("**Scene type**: "), scene, F.lit("\nRoom type = "), room, F.lit("\nFloor hint: Upper\nObserved address: "),
                    F.when(F.col("event_id") % 2 == 0, "Unknown").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(" Oak"))),
                    F.lit("\nConnections: Door, stair up\nSummary: a view\nConfidence score: "), (F.col("event_id") % 100).cast("string"))
    e = t.events.select("event_id", lab.parse_prose(text).alias("a"))
    return e.select("event_id", "a.scene_type", "a.room_type", "a.relevance", "a.floor_hint", "a.observed_address",
                    F.round("a.confidence_score", 6).alias("confidence_score"), F.array_join("a.connections", ",").alias("connections"), "a.summary")


@query("l03_typed_analyses", """
    select event_id, (props->>'k')::int - 5 as floor_number, case when event_id % 3 = 0 then 0.5 else 0.25 end as confidence_score
    from events where event_type <> 'error' and event_id % 7 <> 0""")
def l03(t):
    k = F.get_json_object("props", "$.k").cast("int") - 5
    json = F.to_json(F.struct(
        F.when(F.col("event_type") == "error", "balloon").otherwise("interior").alias("sceneType"), F.lit("kitchen").alias("roomType"),
        F.lit("upper").alias("floorHint"), k.alias("floorNumber"), F.lit("likely").alias("propertyRelevance"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise("a kitchen").alias("summary"),
        F.when(F.col("event_id") % 3 != 0, 0.25).alias("confidenceScore")))
    out = t.events.select("event_id", lab.coerce_analysis(json).alias("a")).filter("a is not null")
    return out.select("event_id", "a.floor_number", "a.confidence_score")


SUMMARIES = ["a washer and dryer beside a utility sink", "A kitchen with a stove, sink and refrigerator", "plain wall",
             "hallway with a door", "living room, sofa", "the staircase"]


@query("l04_scene_repair", """
    with p as (select p_partkey, p_partkey % 6 s, (p_partkey // 6) % 4 k from part)
    select p_partkey, case k when 0 then case when s = 0 then 'utility' else 'kitchen' end when 1 then case s when 1 then 'kitchen' when 3 then 'corridor' when 4 then 'living_room' when 5 then 'stair' else 'unknown' end
        when 2 then 'exterior' else 'unknown' end as room_type,
      case k when 0 then 'interior' when 1 then case when s in (1, 3, 4, 5) then 'interior' else 'unknown' end when 2 then 'exterior' else 'floor_plan' end as scene_type,
      case when k = 1 and s in (1, 3, 4, 5) then 'likely' else 'unlikely' end as relevance from p""")
def l04(t):
    k = F.floor(F.col("p_partkey") / 6) % 4
    r = lab.repair_scene(pick(["exterior", "unknown", "interior", "floor_plan"], k), pick(["kitchen", "unknown", "exterior", "unknown"], k),
                         F.lit("unlikely"), pick(SUMMARIES, F.col("p_partkey") % 6))
    return t.part.select("p_partkey", r.alias("r")).select("p_partkey", "r.room_type", "r.scene_type", "r.relevance")


@query("l05_inferred_rooms", """
    select p_partkey, case p_partkey % 6 when 1 then 'kitchen' when 3 then 'corridor' when 4 then 'living_room' when 5 then 'stair' end as room from part""")
def l05(t):
    return t.part.select("p_partkey", lab.infer_room(F.lower(pick(SUMMARIES, F.col("p_partkey") % 6))).alias("room"))


@query("l06_verified_floors", """
    select p_partkey, case when p_partkey % 4 = p_size % 4 and p_partkey % 4 < 3 then case p_partkey % 4 when 0 then 'basement' when 1 then 'upper' else 'attic' end else 'unknown' end as floor_hint from part""")
def l06(t):
    hint = pick(["basement", "upper", "attic", "unknown"], F.col("p_partkey") % 4)
    text = pick(["Foundation wall", "Going upstairs", "under the eaves", "a room"], F.col("p_size") % 4)
    return t.part.select("p_partkey", lab.verified_floor(hint, text).alias("floor_hint"))


@query("l07_placeholder_addresses", """
    select p_partkey, case when p_partkey % 4 < 3 then '' else p_name end as address from part""")
def l07(t):
    text = F.when(F.col("p_partkey") % 4 < 3, pick([" N/A ", "Unknown", "not visible"], F.col("p_partkey") % 4)).otherwise(
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    return t.part.select("p_partkey", lab.placeholder_blank(text).alias("address"))


@query("l08_rewritten_tags", """
    select l_orderkey, l_linenumber, l_partkey, 'keep|vlm-analyzed|scene:interior|room:' || lower(l_returnflag) || '|floor:upper|' || case when l_linenumber = 2 then 'floor-number:2|' else '' end ||
      'property-relevance:' || case when l_linestatus = 'O' then 'unlikely' else 'likely' end || '|address-match:possible|connection:door' || case when l_linestatus = 'O' then '|reconstruction-excluded' else '' end as tags
    from lineitem""")
def l08(t):
    tags = F.array(F.lit("keep"), F.lit("room:old"), F.lit("reconstruction-excluded"), F.lit("keep"))
    a = {"scene_type": F.lit("interior"), "room_type": F.lower("l_returnflag"), "floor_hint": F.lit("upper"),
         "floor_number": F.when(F.col("l_linenumber") == 2, 2), "address_match": F.lit("possible"),
         "relevance": F.when(F.col("l_linestatus") == "O", "unlikely").otherwise("likely"), "connections": F.array(F.lit("door"))}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(lab.analysed_tags(tags, a), "|").alias("tags"))


@query("l09_pending_images", """
    with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int pick from events where event_type <> 'error' and event_id % 3 <> 0)
    select user_id, event_id, pick from r where pick <= 50""")
def l09(t):
    done = t.events.filter("event_id % 3 = 0")
    return lab.pending_images(t.events, done, case="user_id", key="event_id", order=[F.col("ts"), F.col("event_id")],
                              eligible=F.col("event_type") != "error", limit=50).select("user_id", "event_id", "pick")


@query("l09_analysis_stats", """
    select user_id, count(*) filter (event_type <> 'error') as analysed, count(*) filter (event_type = 'view') as rejected, count(*) filter (event_type = 'error') as warnings from events group by user_id""")
def l09_stats(t):
    k = F.col("event_type")
    return lab.analysis_stats(t.events, case="user_id", ok=k != "error", rejected=lab.rejected_view(
        F.when(k == "view", "non_property").otherwise("interior"), F.lit("likely"), F.lit("possible")))


@query("l10_plan_label_rooms", """
    select p_partkey, case p_partkey % 7 when 0 then 'bathroom' when 1 then 'bedroom' when 2 then 'living_room' when 3 then 'closet' when 4 then 'utility' when 5 then 'corridor' end as room from part""")
def l10(t):
    label = pick(["Primary Bath", "Primary Suite", "GREAT-ROOM", "W.I.C? wic", "Mech.", "Entry / hall", "Deck"], F.col("p_partkey") % 7)
    return t.part.select("p_partkey", lab.plan_label_room(F.concat(label, F.lit(" #2"))).alias("room"))


TOKENS = ["KITCHEN", "12' 6\"", "2ND FLOOR PLAN", "UPPER LEVEL", "3.5", "BEDROOM", "SITE PLAN", "MAIN FLOOR"]


def tokens(t):
    """Lines as text tokens of the sheet of their order."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick(TOKENS, F.col("l_partkey") % 8).alias("text"),
                             (F.lit(1.0) - F.col("l_discount") * 3).alias("score"))


TOK = """tok as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0 - l_discount * 3 score, l_partkey % 8 k from lineitem)"""


@query("l11_printed_labels", f"""
    with {TOK}, r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int label_pos from tok where score >= 0.78 and k not in (1, 2, 4))
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, label_pos from r where label_pos <= 60""")
def l11(t):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return lab.printed_labels(tokens(t), sheet="l_orderkey", text="text", score="score", order=order, limit=60) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label_pos")


@query("l11_sheet_floors", f"with {TOK} select distinct l_orderkey, 2 as floor_number from tok where score >= 0.78 and k = 2")
def l11_floors(t):
    return lab.sheet_floor(tokens(t), sheet="l_orderkey", text="text", score="score", pos=F.col("l_linenumber"))


@query("l12_level_anchors", f"""
    with {TOK} select k::int as token, case k when 3 then 'Upper level' when 7 then 'Main level' when 2 then 'Upper level' end as floor_label, count(*) as tokens,
      k in (0, 5) as room_label from tok group by k""")
def l12(t):
    tok = tokens(t).withColumn("token", (F.col("l_partkey") % 8).cast("int"))
    return tok.select("token", lab.level_anchor(F.col("text"))["floor_label"].alias("floor_label"), lab.is_room_label(F.col("text")).alias("room_label")) \
        .groupBy("token", "floor_label", "room_label").agg(F.count(F.lit(1)).alias("tokens"))


@query("l12_site_sheets", f"""
    with {TOK} select l_orderkey, bool_or(k = 6) and not bool_or(k in (2, 3, 7)) as site_reference from tok group by l_orderkey""")
def l12_sites(t):
    return lab.site_sheets(tokens(t), sheet="l_orderkey", text="text", position="l_linenumber")


@query("l13_detections", """
    with d as (select *, greatest(0, least(640, (l_quantity * 10 - 40) / 0.5)) l, greatest(0, least(640, (l_quantity * 10 + l_linenumber * 30 - 40) / 0.5)) r,
        greatest(0, least(480, (l_linenumber * 20) / 0.5)) tp, greatest(0, least(480, (l_linenumber * 50) / 0.5)) bt from lineitem where 1 - l_discount * 8 >= 0.5),
    k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) pick from d where r - l >= 1 and bt - tp >= 1)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l / 640, 4) as x, round((r - l) / 640, 4) as width, round((bt - tp) / 480, 4) as height,
      case l_returnflag when 'A' then 'occupant' when 'R' then 'heat / gas appliance' else 'observed object' end as tactical_label from k where pick <= 30""")
def l13(t):
    q, n = F.col("l_quantity") * 10, F.col("l_linenumber")
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", q.alias("x1"), (n * 20.0).alias("y1"), (q + n * 30).alias("x2"),
                          (n * 50.0).alias("y2"), (F.lit(1) - F.col("l_discount") * 8).alias("score"),
                          F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "R", "oven").otherwise("chair").alias("label"))
    out = lab.filter_detections(d, frame="l_orderkey", order=[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")],
                                box=("x1", "y1", "x2", "y2"), score="score", label="label", ratio=F.lit(0.5), pad_x=F.lit(40), pad_y=F.lit(0),
                                width=F.lit(640), height=F.lit(480), threshold=0.5, limit=30)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 4).alias(c) for c in ("x", "width", "height")], "tactical_label")


@query("l14_cited_findings", """
    with c as (select l_orderkey, list_sort(list(distinct l_suppkey)) ids from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 2000) group by 1)
    select o_orderkey, array_to_string(ids, ',') as sources, case when o_orderstatus = 'F' then 0.42 else 0.28 end as confidence_score from orders join c on l_orderkey = o_orderkey""")
def l14(t):
    cites = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("cited"))
    found = t.orders.join(cites, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit(1).alias("case_id"), "o_orderkey", "cited", "o_orderstatus")
    ev = t.supplier.filter("s_acctbal > 2000").select(F.lit(1).alias("case_id"), "s_suppkey")
    out = lab.cited_findings(found, ev, case="case_id", finding="o_orderkey", cited="cited", evidence_id="s_suppkey", with_image=F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", F.array_join("source_ids", ",").alias("sources"), "confidence_score")


@query("l14_review_flags", """
    select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') then 'review_required' else lower(c_mktsegment) end as status from customer""")
def l14_flags(t):
    cases = t.customer.select("c_custkey", F.lower("c_mktsegment").alias("status"))
    added = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lab.flag_for_review(cases, added, case="c_custkey", status="status")


@query("l15_interior_gaps", "select o_custkey, 'intelligence_gap' as category, count(*) as source_count from orders group by o_custkey")
def l15(t):
    gap, _ = lab.interior_gap(t.orders, case="o_custkey", key="o_orderkey")
    return gap.select("o_custkey", "category", "source_count")


@query("l17_first_usable_image", """
    select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) <= 100) group by o_custkey""")
def l17(t):
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("bytes"))
    return lab.first_usable_image(t.orders, files, case="o_custkey", path="o_orderkey", order=[F.col("o_orderkey")], size="bytes",
                                  max_bytes=100).select("o_custkey", "o_orderkey")
