"""Capture planning on ``events``: a user is a case, an event is a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import capture as cap
from proofgrid.plans.registry import query


def frames(t):
    """Events as captured frames with tags and a scene analysis."""
    kind = F.col("event_type")
    scene = (F.when(kind.isin("view", "purchase"), "interior").when(kind.isin("click", "error"), "exterior"))
    room = (F.when(kind == "view", "bedroom").when(kind == "click", "kitchen")
            .when(kind == "error", "living_room").when(kind == "purchase", "unknown"))
    tags = F.array_compact(F.array(
        F.when(kind == "view", "operator-upload"), F.when(kind == "click", "address-text-match"),
        F.when(F.col("value") > 20, "property-photo"), F.when(F.col("event_id") % 7 == 0, "overlap-set:a"),
        F.when(F.col("value") < 1, cap.EXCLUDED_TAG), F.when(kind == "error", "property-proximity-unverified")))
    return t.events.select(
        "user_id", "event_id", "value", scene.alias("scene"), room.alias("room"), tags.alias("tags"),
        F.when(kind != "purchase", F.concat(F.lit("/assets/"), F.col("event_id"))).alias("local_url"),
        F.lit("image/jpeg").alias("mime"),
        F.when(F.col("event_id") % 3 == 0, "likely").otherwise("possible").alias("relevance"),
        F.when(F.col("event_id") % 5 == 0, "supported").when(F.col("event_id") % 11 == 0, "contradictory")
        .otherwise("unknown").alias("address_match"),
    )


FRAMES = """
    frames as (
      select user_id, event_id, value,
        case when event_type in ('view','purchase') then 'interior' when event_type in ('click','error') then 'exterior' end scene,
        case event_type when 'view' then 'bedroom' when 'click' then 'kitchen' when 'error' then 'living_room'
             when 'purchase' then 'unknown' end room,
        event_type, event_type <> 'purchase' has_local, value < 1 excluded,
        case when event_type = 'view' then 20 else 0 end + case when value > 20 then 10 else 0 end
        + case when event_id % 3 = 0 then 8 else 0 end + case when event_id % 5 = 0 then 12 else 0 end
        + case when event_type = 'click' then 10 else 0 end
        + case when event_id % 5 <> 0 and event_id % 11 = 0 then -50 else 0 end
        + case when event_id % 7 = 0 then 3 else 0 end + case when event_type = 'error' then -8 else 0 end priority,
        event_type in ('view','click') or event_id % 5 = 0 evidence_ok,
        case when event_type = 'click' then 'room:kitchen' when event_type = 'view' then 'room:bedroom'
             when event_type = 'error' then 'exterior' when event_type = 'purchase' then 'interior_other'
             else 'unknown' end zone
      from events)"""


@query("p01_eligible_frames", f"""
    with {FRAMES} select user_id, event_id, has_local and not excluded and evidence_ok as reconstructable
    from frames where has_local and not excluded""")
def p01(t):
    f = frames(t)
    eligible = cap.capture_eligible(f.local_url, f.mime, f.tags)
    return f.filter(eligible).select(
        "user_id", "event_id",
        cap.reconstruction_eligible(f.local_url, f.mime, f.tags, f.address_match).alias("reconstructable"))


@query("p02_priority_top12", f"""
    with {FRAMES}, live as (select distinct user_id from events where event_type = 'error' and value > 250),
    ok as (select user_id, event_id, priority, row_number() over (partition by user_id order by priority desc, event_id) as rank
           from frames where has_local and not excluded and evidence_ok and user_id not in (select user_id from live))
    select user_id, event_id, priority::int as priority, rank::int as rank from ok where rank <= 12""")
def p02(t):
    f = frames(t)
    f = f.filter(cap.reconstruction_eligible(f.local_url, f.mime, f.tags, f.address_match))
    f = f.select("user_id", "event_id",
                 cap.evidence_priority(f.tags, f.relevance, f.address_match).alias("priority"))
    live = t.events.filter("event_type = 'error' and value > 250")
    return cap.queue_top(f, live, key="user_id", score="priority", order=[F.col("event_id")])


@query("p03_capture_zones", f"""
    with {FRAMES} select zone, count(*) as frames, min(event_id) as first_frame from frames group by zone""")
def p03(t):
    f = frames(t).withColumn("zone", cap.capture_zone(F.col("scene"), F.col("room")))
    return f.groupBy("zone").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_frame"))


ZONED = FRAMES + """,
    z as (select user_id, zone, count(*) n, count(scene) a, min(event_id) first from frames group by all),
    c as (select user_id, sum(a) >= ceil(sum(n) * 0.75) and count(*) > 1 as split, min(first) first from z group by 1),
    g as (select f.user_id, f.event_id, case when split then f.zone end group_key,
                 case when split then z.first else c.first end group_first
          from frames f join z using (user_id, zone) join c on c.user_id = f.user_id)"""


def grouped(t):
    f = frames(t).withColumn("zone", cap.capture_zone(F.col("scene"), F.col("room")))
    return cap.semantic_groups(f, case="user_id", order="event_id", zone="zone", analysed=F.col("scene").isNotNull())


@query("p04_zone_groups", f"with {ZONED} select user_id, event_id, group_key, group_first from g")
def p04(t):
    return grouped(t).select("user_id", "event_id", "group_key", "group_first")


@query("p05_capture_batches", f"""
    with {ZONED},
    r as (select *, row_number() over (partition by user_id, group_key order by event_id) - 1 as r from g),
    s as (select user_id, group_key, min(group_first) gf, count(*) n,
                 case when count(*) <= 12 then 1 else ceil((count(*) - 12) / 9.0) + 1 end b from g group by all),
    o as (select *, coalesce(sum(b) over (partition by user_id order by gf, group_key
                    rows between unbounded preceding and 1 preceding), 0) base from s)
    select r.user_id, r.group_key, (o.base + k.k)::bigint as batch_index, (r.r - k.k * 9)::bigint as pos, r.event_id,
           k.k > 0 and r.r - k.k * 9 < 3 as is_bridge
    from r join o on r.user_id = o.user_id and r.group_key is not distinct from o.group_key
    join (select unnest(generate_series(0, 5000)) k) k on k.k < o.b and r.r >= k.k * 9 and r.r < k.k * 9 + 12""")
def p05(t):
    return cap.plan_batches(grouped(t), case="user_id", frame="event_id", order=[F.col("event_id")],
                            group="group_key", group_first="group_first",
                            slice_by=F.floor(F.col("event_id") / 100_000))


@query("p06_evidence_split", f"""
    with {FRAMES} select user_id, count(*) filter (excluded) as excluded_rows,
      count(*) filter (not excluded and value > 50) as plan_rows,
      count(*) filter (not excluded and value <= 50) as photo_rows from frames group by user_id""")
def p06(t):
    f = frames(t)
    kind = F.when(F.col("value") > 50, "blueprint").otherwise("image")
    f = f.withColumn("split", cap.evidence_split(f.tags, f.scene, kind))
    return f.groupBy("user_id").agg(*[
        F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("excluded", "plan", "photo")])


@query("p07_plan_order", """
    with p as (select o_custkey, o_orderkey, case when o_orderstatus = 'F' then (o_orderkey % 14)::int end floor_no from orders),
    r as (select *, row_number() over (partition by o_custkey order by floor_no is null, floor_no, o_orderkey) plan_pos from p),
    k as (select *, coalesce(floor_no, plan_pos) floor_used from r where plan_pos <= 12)
    select o_custkey, o_orderkey, plan_pos::int as plan_pos, floor_used::int as floor_used,
      floor_used between 1 and 12 and count(*) over (partition by o_custkey, floor_used) = 1 as floor_ok from k""")
def p07(t):
    plans = t.orders.select("o_custkey", "o_orderkey", F.when(
        F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 14).cast("int")).alias("floor_no"))
    return cap.order_plans(plans, case="o_custkey", floor="floor_no", order=[F.col("o_orderkey")]) \
        .select("o_custkey", "o_orderkey", "plan_pos", "floor_used", "floor_ok")


@query("p08_coverage_floors", """
    select user_id, count(*) as frames, 2::bigint as minimum_frames,
      greatest(2, ceil(count(*) / 2.0))::bigint as representative_frames from events group by user_id""")
def p08(t):
    n = F.col("frames")
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames")).select(
        "user_id", n, cap.minimum_connected(n).alias("minimum_frames"),
        cap.representative_connected(n).alias("representative_frames"))


@query("p09_plan_totals", f"""
    with {FRAMES} select user_id, count(*) as total_frames, count(*) filter (has_local and not excluded) as eligible_frames,
      count(*) filter (not has_local or excluded) as excluded_frames from frames group by user_id""")
def p09(t):
    f = frames(t)
    return cap.plan_totals(f, case="user_id", eligible=cap.capture_eligible(f.local_url, f.mime, f.tags))


@query("p10_job_modes", """
    select l_orderkey, count(*) as frames, case when count(*) = 1 and max(l_returnflag) = 'R' then 'panorama'
      when count(*) = 1 then 'single' else 'multi' end as mode from lineitem group by l_orderkey""")
def p10(t):
    projection = F.when(F.col("l_returnflag") == "R", "equirectangular-360").otherwise("perspective")
    return cap.job_mode(t.lineitem, batch=["l_orderkey"], projection=projection)
