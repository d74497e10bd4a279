"""Building and street-photo ranking on a key-derived lattice of constant density."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import geo
from proofgrid.plans.registry import query

HALF = 0.0002


def points(t):
    """Customers as address points."""
    k = F.col("c_custkey")
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", (F.lit(40.0) + (k % 100) * 0.001 + (k % 3) * 0.00017).alias("lat"),
        (F.lit(-74.0) + F.floor(k / 100) * 0.00008).alias("lon"),
        F.concat((k % 7 + 1).cast("string"), F.lit(" "), F.lower("n_name"), F.lit(" St, 1000"), (k % 2).cast("string")).alias("address"))


def buildings(t):
    """Suppliers as square footprints."""
    k = F.col("s_suppkey")
    b = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", (F.lit(40.0) + (k % 100) * 0.001).alias("blat"), (F.lit(-74.0) + F.floor(k / 100) * 0.0012).alias("blon"),
        (k % 7 + 1).cast("string").alias("house"), F.concat(F.initcap("n_name"), F.lit(" Street")).alias("street"),
        F.concat(F.lit("1000"), (k % 2).cast("string")).alias("post"),
        F.create_map(F.lit("building:levels"), (k % 5).cast("string"), F.lit("building"),
                     F.when(k % 2 == 0, "yes").otherwise("office"), F.lit("material"), F.lit("brick"),
                     F.lit("start_date"), F.concat(F.lit("c. "), (k % 300 + 1700).cast("string"))).alias("tags"))
    def corner(dy, dx):
        return F.struct((F.col("blat") + dy * HALF).alias("lat"), (F.col("blon") + dx * HALF).alias("lon"))
    return b.select(
        "*", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)).alias("ring"),
        (F.col("blat") - HALF).alias("lat0"), (F.col("blat") + HALF).alias("lat1"),
        (F.col("blon") - HALF).alias("lon0"), (F.col("blon") + HALF).alias("lon1"))


NEAR = """
    p as (select c_custkey, 40.0 + (c_custkey % 100) * 0.001 + (c_custkey % 3) * 0.00017 as lat, -74.0 + (c_custkey // 100) * 0.00008 as lon,
            c_custkey % 7 + 1 as house, lower(n_name) as street, c_custkey % 2 as post
          from customer join nation on c_nationkey = n_nationkey),
    b as (select s_suppkey, 40.0 + (s_suppkey % 100) * 0.001 as blat, -74.0 + (s_suppkey // 100) * 0.0012 as blon,
            s_suppkey % 7 + 1 as bhouse, lower(n_name) as bstreet, s_suppkey % 2 as bpost
          from supplier join nation on s_nationkey = n_nationkey),
    d as (select *, sqrt(pow(greatest(abs(lat - blat) - 0.0002, 0) * 111320, 2)
                  + pow(greatest(abs(lon - blon) - 0.0002, 0) * 111320 * cos(radians(lat)), 2)) as dist
          from p join b on abs(lat - blat) < 0.003 and abs(lon - blon) < 0.003),
    near as (select *, dist = 0 as inside, greatest(0, 500 - dist * 8) + case when dist = 0 then 800 else 0 end
        + case when house = bhouse then 1800 else -800 end + case when street = bstreet then 1800 else -1800 end
        + case when post = bpost then 500 else -500 end as score from d where dist <= 130)"""


def near(t):
    pairs = geo.grid_pairs(points(t), buildings(t), lat="lat", lon="lon", bounds=("lat0", "lat1", "lon0", "lon1"),
                           reach_m=geo.BUILDING_RADIUS_M)
    pairs = geo.with_footprint_distance(pairs, lat="lat", lon="lon", ring="ring", reach_m=geo.BUILDING_RADIUS_M, out="dist")
    inside = F.col("dist") == 0
    return pairs.withColumn("score", geo.building_score(F.col("dist"), inside, F.col("address"), F.col("house"),
                                                        F.col("street"), F.col("post")))


@query("g01_point_in_footprint", f"with {NEAR} select c_custkey, s_suppkey from near where inside")
def g01(t):
    pairs = geo.grid_pairs(points(t), buildings(t), lat="lat", lon="lon", bounds=("lat0", "lat1", "lon0", "lon1"),
                           reach_m=20.0, cell_m=130.0)
    return pairs.filter(geo.inside_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select("c_custkey", "s_suppkey")


@query("g02_segment_distance", """
    select s_suppkey, round(sqrt(pow((0.001 - 0.0002) * 111320, 2)), 3) as metres from supplier""")
def g02(t):
    b = buildings(t)
    return b.select("s_suppkey", F.round(geo.segment_distance_m(
        F.col("blat") + 0.001, F.col("blon"), F.col("ring")[2], F.col("ring")[3]), 3).alias("metres"))


@query("g03_footprint_distance", f"""
    with {NEAR} select c_custkey, min(round(dist, 3)) as nearest_m from near group by c_custkey""")
def g03(t):
    return near(t).groupBy("c_custkey").agg(F.min(F.round("dist", 3)).alias("nearest_m"))


@query("g04_radius_candidates", f"with {NEAR} select c_custkey, s_suppkey, round(dist, 3) as dist from near")
def g04(t):
    return near(t).select("c_custkey", "s_suppkey", F.round("dist", 3).alias("dist"))


@query("g05_building_scores", f"with {NEAR} select c_custkey, s_suppkey, round(score, 3) as score from near")
def g05(t):
    return near(t).select("c_custkey", "s_suppkey", F.round("score", 3).alias("score"))


@query("g06_best_building", f"""
    with {NEAR}, r as (select *, row_number() over (partition by c_custkey order by round(score, 6) desc, s_suppkey) rn from near)
    select c_custkey, s_suppkey, case when s_suppkey % 5 > 0 then (s_suppkey % 5)::int end as levels,
      case when s_suppkey % 2 = 1 then 'office' end as building_type, 'brick' as construction,
      (s_suppkey % 300 + 1700)::int as year_built, 5::bigint as ring_points from r where rn = 1""")
def g06(t):
    scored = near(t).withColumn("score", F.round("score", 6))
    best = geo.best_building(scored, request="c_custkey", score="score", pos="s_suppkey", tags="tags")
    return best.select("c_custkey", "s_suppkey", "levels", "building_type", "construction", "year_built",
                       F.size(geo.closed_ring(F.col("ring"))).cast("bigint").alias("ring_points"))


# --- street photos: events of a user are a drive; each user has a target address

def photos(t):
    k = F.col("event_id")
    lat = F.lit(40.0) + (F.col("user_id") % 90) * 0.01 + (k % 40) * 0.00008
    lon = F.lit(-74.0) + (k % 7) * 0.0003
    return t.events.select(
        "event_id", "user_id", k.alias("idx"), lat.alias("lat"), lon.alias("lon"),
        F.when(k % 9 != 0, F.col("value") % 360).alias("heading"), F.col("ts"),
        (F.lit(40.0) + (F.col("user_id") % 90) * 0.01 + 0.0015).alias("tlat"), F.lit(-74.0 + 0.0009).alias("tlon"),
        F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("status"))


def scored_photos(t):
    p = photos(t).filter(geo.photo_usable(F.col("event_id"), F.col("user_id"), F.col("idx"), F.lit("u"), F.col("lat"),
                                          F.col("lon"), F.col("status"), F.lit("public")))
    return geo.photo_score(p, lat="lat", lon="lon", heading="heading", shot=F.col("ts"), target_lat="tlat",
                           target_lon="tlon", now=F.lit("2026-01-01 00:00:00").cast("timestamp"))


PHOTOS = """
    ph as (select event_id, user_id, ts, 40.0 + (user_id % 90) * 0.01 + (event_id % 40) * 0.00008 as lat, -74.0 + (event_id % 7) * 0.0003 as lon,
        case when event_id % 9 <> 0 then value % 360 end heading, 40.0 + (user_id % 90) * 0.01 + 0.0015 tlat, -74.0 + 0.0009 tlon
      from events where event_type <> 'error'),
    g as (select *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) as h,
        degrees(atan2(sin(radians(tlon - lon)) * cos(radians(tlat)), cos(radians(lat)) * sin(radians(tlat)) - sin(radians(lat)) * cos(radians(tlat)) * cos(radians(tlon - lon)))) + 360 as b0 from ph),
    m as (select *, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) distance_m,
        coalesce(abs((heading - (b0 % 360) + 540) % 360 - 180), 90) heading_gap from g),
    sp as (select *, greatest(0, 1 - abs(distance_m - 35) / 220) * 0.55 + greatest(0, 1 - heading_gap / 135) * 0.3
        + greatest(0, 1 - (epoch(timestamp '2026-01-01') - epoch(ts)) / (365.25 * 86400) / 15) * 0.15 as score from m),
    an as (select * from (select *, row_number() over (partition by user_id order by score desc, event_id) rn from sp where distance_m <= 220) where rn = 1)"""

WINDOW = PHOTOS + """,
    win as (select sp.*, an.event_id as anchor_index from an join sp on sp.user_id = an.user_id and abs(sp.event_id - an.event_id) <= 8),
    pref as (select *, row_number() over (partition by user_id order by case event_id - anchor_index when 0 then 1 when -2 then 2 when 2 then 3
        when -4 then 4 when 4 then 5 when -1 then 6 when 1 then 7 when -3 then 8 when 3 then 9 end) pr
      from win where heading_gap <= 110 and distance_m <= 220 and abs(event_id - anchor_index) <= 4),
    sel as (select user_id, event_id, distance_m, heading_gap from pref where pr <= 3
      union all select user_id, event_id, distance_m, heading_gap from an where user_id not in (select user_id from pref))"""


@query("g07_distance_bearing", f"""
    with {PHOTOS} select event_id, round(distance_m, 3) as distance_m, round(heading_gap, 3) as heading_gap from sp""")
def g07(t):
    return scored_photos(t).select("event_id", F.round("distance_m", 3).alias("distance_m"),
                                   F.round("heading_gap", 3).alias("heading_gap"))


@query("g08_photo_scores", f"with {PHOTOS} select event_id, round(score, 6) as score from sp")
def g08(t):
    return scored_photos(t).select("event_id", F.round("score", 6).alias("score"))


def anchors(t):
    return geo.pick_anchor(scored_photos(t), case="user_id", order=[F.col("event_id")])


@query("g09_anchor_photos", f"with {PHOTOS} select user_id, event_id from an")
def g09(t):
    return anchors(t).select("user_id", "event_id")


def window(t):
    shots = scored_photos(t).withColumn("drive", F.col("user_id"))
    a = anchors(t).withColumn("drive", F.col("user_id"))
    return geo.sequence_window(a, shots.drop("user_id"), case="user_id", sequence="drive", index="idx")


@query("g10_sequence_window", f"with {WINDOW} select user_id, event_id, anchor_index from win")
def g10(t):
    return window(t).select("user_id", "event_id", "anchor_index")


def chosen(t):
    a = anchors(t).withColumn("drive", F.col("user_id"))
    return geo.preferred_frames(window(t), a, case="user_id", index="idx", pos="event_id")


@query("g11_preferred_frames", f"with {WINDOW} select user_id, event_id from sel")
def g11(t):
    return chosen(t).select("user_id", "event_id")


@query("g12_proximity_confidence", f"""
    with {WINDOW} select user_id, event_id, case when heading_gap <= 65 then 0.48 else 0.36 end as confidence,
      'street-sequence:' || user_id as sequence_tag from sel""")
def g12(t):
    tags = geo.proximity_tags(F.col("user_id").cast("string"), F.col("idx"))
    return chosen(t).select("user_id", "event_id", geo.proximity_confidence(F.col("heading_gap")).alias("confidence"),
                            F.element_at(tags, 6).alias("sequence_tag"))


@query("g13_street_results", f"""
    with {WINDOW} select user_id, event_id, row_number() over (partition by user_id order by event_id)::int as item,
      count(*) over (partition by user_id) as items, floor(distance_m + 0.5)::bigint as distance_label,
      floor(distance_m * 10 + 0.5) / 10 as distance_m, floor(heading_gap * 10 + 0.5) / 10 as heading_gap from sel""")
def g13(t):
    return geo.shape_results(chosen(t), case="user_id", index="idx").select(
        "user_id", "event_id", "item", "items", "distance_label", "distance_m", "heading_gap")
