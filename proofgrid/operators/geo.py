"""Footprint and street-photo ranking around address points.

Radius joins are grid equi-joins: the extended side is copied to every cell its
reach covers, the point side sits in exactly one cell, so each pair is produced
once and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.numeric import METRES_PER_DEGREE, angle_gap_deg, bearing_deg, half_up, haversine_m
from proofgrid.functions.text import let
from proofgrid.operators.address import normal_address
from proofgrid.operators.ranking import first_by, top_k, with_group_stats

# Radii, weights and preferred offsets of the ranking rules.
BUILDING_RADIUS_M = 130.0
PHOTO_RADIUS_M = 220.0
SEQUENCE_REACH = 8
MAX_HEADING_GAP = 110.0
UNKNOWN_HEADING_GAP = 90.0
PREFERRED_OFFSETS = [0, -2, 2, -4, 4, -1, 1, -3, 3]
FRAMES_PER_CASE = 3
RECENCY_YEARS = 15.0
SECONDS_PER_YEAR = 365.25 * 24 * 3600


def inside_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray cast against a ring of (lat, lon) structs; needs three vertices."""
    n = F.size(ring)
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1)).alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / rise + a["lon"]
        return straddles & (lon < at)

    return F.when(n >= 3, F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1) \
        .otherwise(F.lit(False))


def segment_distance_m(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment in a local equirectangular plane."""
    sy = F.lit(METRES_PER_DEGREE)
    sx = sy * F.cos(F.radians(lat))
    ax, ay = (a["lon"] - lon) * sx, (a["lat"] - lat) * sy
    dx, dy = (b["lon"] - lon) * sx - ax, (b["lat"] - lat) * sy - ay
    length2 = dx * dx + dy * dy
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(length2, F.lit(0.0))))
    along = F.when(length2 > 0, along).otherwise(F.lit(0.0))
    return F.hypot(ax + along * dx, ay + along * dy)


def footprint_distance_m(lat: Column, lon: Column, ring: Column, centre: Column | None = None) -> Column:
    """0 inside, else the nearest closed edge, else the centre, else infinity."""
    def nearest(r):
        n = F.size(r)
        edges = F.arrays_zip(r.alias("a"), F.concat(F.slice(r, 2, n), F.slice(r, 1, 1)).alias("b"))
        return F.array_min(F.transform(edges, lambda e: segment_distance_m(lat, lon, e["a"], e["b"])))

    fallback = F.lit(float("inf")) if centre is None else F.coalesce(
        segment_distance_m(lat, lon, centre, centre), F.lit(float("inf")))
    return F.when(inside_ring(lat, lon, ring), F.lit(0.0)).when(F.size(ring) >= 2, nearest(ring)).otherwise(fallback)


def box_distance_m(lat: Column, lon: Column, bounds: tuple[Column, Column, Column, Column]) -> Column:
    """Metres to an area's bounding box: never more than to the area itself."""
    lat0, lat1, lon0, lon1 = bounds
    dy = F.greatest(lat0 - lat, lat - lat1, F.lit(0.0)) * METRES_PER_DEGREE
    dx = F.greatest(lon0 - lon, lon - lon1, F.lit(0.0)) * METRES_PER_DEGREE * F.cos(F.radians(lat))
    return F.hypot(dx, dy)


def grid_pairs(points: DataFrame, areas: DataFrame, *, lat: str, lon: str, bounds: tuple[str, str, str, str],
               reach_m: float, cell_m: float | None = None) -> DataFrame:
    """Candidate pairs of points and areas whose reach covers the point's cell.

    ``bounds`` names the area columns min lat, max lat, min lon, max lon.  The
    caller applies the exact distance filter; only pairs whose bounding box is
    already out of reach are dropped here.
    """
    cell = (cell_m or reach_m) / METRES_PER_DEGREE
    lat0, lat1, lon0, lon1 = (F.col(c) for c in bounds)
    dlat = F.lit(reach_m / METRES_PER_DEGREE)
    widest = F.least(F.greatest(F.abs(lat0), F.abs(lat1)) + dlat, F.lit(89.9))
    dlon = dlat / F.cos(F.radians(widest))

    def cells(low, high):
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    reached = areas.withColumn("__cy", F.explode(cells(lat0 - dlat, lat1 + dlat))) \
        .withColumn("__cx", F.explode(cells(lon0 - dlon, lon1 + dlon)))
    placed = points.withColumn("__cy", F.floor(F.col(lat) / cell)).withColumn("__cx", F.floor(F.col(lon) / cell))
    close = box_distance_m(F.col(lat), F.col(lon), (lat0, lat1, lon0, lon1)) <= reach_m
    return placed.join(reached, ["__cy", "__cx"]).filter(close).drop("__cy", "__cx")


def with_footprint_distance(pairs: DataFrame, *, lat: str, lon: str, ring: str, reach_m: float,
                            out: str = "distance_m") -> DataFrame:
    """Exact distance of each candidate pair, computed once, and the radius filter."""
    # an explode of one value keeps the filter from repeating the costly expression
    value = F.array(footprint_distance_m(F.col(lat), F.col(lon), F.col(ring)))
    return pairs.withColumn(out, F.explode(value)).filter(F.col(out) <= reach_m)


def building_score(distance: Column, inside: Column, address: Column, house: Column, street: Column,
                   postcode: Column) -> Column:
    """Closeness plus or minus agreement of house number, street and postcode."""
    def vote(known, equal, plus, minus):
        return F.when(known & equal, plus).when(known, -minus).otherwise(0)

    def agreement(p):
        house = F.regexp_extract(p["want"], r"^([0-9]+[a-z]?)\b", 1)
        post = F.regexp_extract(p["want"], r"\b([0-9]{5})(?: [0-9]{4})?\b", 1)
        return (
            vote((house != "") & (p["house"] != ""), house == p["house"], 1800, 800)
            + vote(p["street"] != "", p["want"].contains(p["street"]), 1800, 1800)
            + vote((post != "") & (p["post"] != ""), post == p["post"], 500, 500))

    plain = F.struct(normal_address(address).alias("want"), normal_address(house).alias("house"),
                     normal_address(street).alias("street"), normal_address(postcode).alias("post"))
    score = F.greatest(F.lit(0.0), F.lit(500.0) - distance * 8) + F.when(inside, 800).otherwise(0) \
        + let(plain, agreement)
    return F.when(distance == float("inf"), F.lit(float("-inf"))).otherwise(score)


def best_building(df: DataFrame, *, request: str, score: str, pos: str, tags: str) -> DataFrame:
    """Top building per request with its parsed attributes."""
    best = first_by(df, [request], [F.col(score).desc(), F.col(pos)])

    def tag(name):
        return F.try_element_at(F.col(tags), F.lit(name))

    levels = F.regexp_extract(F.coalesce(tag("building:levels"), F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
    year = F.regexp_extract(F.coalesce(tag("start_date"), F.lit("")), r"((?:16|17|18|19|20|21)\d{2})", 1)
    return best.select(
        "*", F.when(levels > 0, levels).alias("levels"),
        F.when(tag("building") != "yes", tag("building")).alias("building_type"),
        F.coalesce(tag("building:material"), tag("material")).alias("construction"),
        year.try_cast("int").alias("year_built"))


def closed_ring(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end; NULL under three vertices."""
    first, last = F.get(ring, 0), F.element_at(ring, -1)
    return F.when(F.size(ring) >= 3, F.when(first == last, ring).otherwise(F.concat(ring, F.array(first))))


def photo_score(df: DataFrame, *, lat: str, lon: str, heading: str, shot: Column, target_lat: str, target_lon: str,
                now: Column) -> DataFrame:
    """Distance, heading gap and score of photos against their target point."""
    a, b, c, d = F.col(lat), F.col(lon), F.col(target_lat), F.col(target_lon)
    age = (now.cast("timestamp").cast("double") - shot.cast("timestamp").cast("double")) / SECONDS_PER_YEAR
    recency = F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - age / RECENCY_YEARS), F.lit(0.0))
    out = df.withColumn("distance_m", haversine_m(a, b, c, d)).withColumn(
        "heading_gap", F.coalesce(angle_gap_deg(F.col(heading), bearing_deg(a, b, c, d)),
                                  F.lit(UNKNOWN_HEADING_GAP)))
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("distance_m") - 35.0) / 220.0)
    facing = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("heading_gap") / 135.0)
    return out.withColumn("score", near * 0.55 + facing * 0.3 + recency * 0.15)


def photo_usable(photo_id: Column, sequence: Column, index: Column, url: Column, lat: Column, lon: Column,
                 status: Column, visibility: Column) -> Column:
    """Complete, public and not deleted."""
    def filled(c):
        return F.coalesce(c.cast("string"), F.lit("")) != ""

    return (filled(photo_id) & filled(sequence) & filled(url) & index.isNotNull() & lat.isNotNull() & lon.isNotNull()
            & ~F.coalesce(status == "deleted", F.lit(False))
            & (~filled(visibility) | F.coalesce(visibility == "public", F.lit(False))))


def pick_anchor(df: DataFrame, *, case: str, order: list[Column]) -> DataFrame:
    """Best-scored photo within reach of each case."""
    return first_by(df.filter(F.col("distance_m") <= PHOTO_RADIUS_M), [case], [F.col("score").desc(), *order])


def sequence_window(anchors: DataFrame, photos: DataFrame, *, case: str, sequence: str, index: str) -> DataFrame:
    """Photos of the anchor's sequence at most eight positions away.

    A range join by index buckets, so a long sequence is spread over many keys.
    """
    width = 2 * SEQUENCE_REACH + 1
    at = F.col("__anchor_index")
    wanted = anchors.select(case, F.col(sequence), F.col(index).alias("__anchor_index")).withColumn(
        "__bucket", F.explode(F.array_distinct(F.array(
            F.floor((at - SEQUENCE_REACH) / width), F.floor((at + SEQUENCE_REACH) / width)))))
    placed = photos.withColumn("__bucket", F.floor(F.col(index) / width))
    near = F.abs(F.col(index) - at) <= SEQUENCE_REACH
    return wanted.join(placed, [sequence, "__bucket"]).filter(near).drop("__bucket") \
        .withColumnRenamed("__anchor_index", "anchor_index")


def preferred_frames(candidates: DataFrame, anchors: DataFrame, *, case: str, index: str, pos: str) -> DataFrame:
    """Up to three frames by preferred offset from the anchor, else the anchor itself."""
    usable = candidates.filter((F.col("heading_gap") <= MAX_HEADING_GAP) & (F.col("distance_m") <= PHOTO_RADIUS_M))
    # one photo per index: the last one listed
    latest = first_by(usable, [case, index], [F.col(pos).desc()])
    offset = (F.col(index) - F.col("anchor_index")).cast("int")
    ranked = latest.withColumn("__pref", F.array_position(F.array(*[F.lit(o) for o in PREFERRED_OFFSETS]), offset)) \
        .filter(F.col("__pref") > 0)
    chosen = top_k(ranked, [case], [F.col("__pref")], FRAMES_PER_CASE, "__r").drop("__r", "__pref")
    alone = anchors.join(chosen.select(case).distinct(), case, "left_anti")
    alone = alone.withColumn("anchor_index", F.col(index))
    return chosen.unionByName(alone.select(*chosen.columns))


def proximity_confidence(heading_gap: Column) -> Column:
    """.48 when the camera faces the address, else .36."""
    return F.when(heading_gap <= 65, F.lit(0.48)).otherwise(F.lit(0.36))


def proximity_tags(sequence: Column, index: Column) -> Column:
    return F.array(F.lit("automated-discovery"), F.lit("open-license"), F.lit("street-level"), F.lit("exterior"),
                   F.lit("property-proximity-unverified"), F.concat(F.lit("street-sequence:"), sequence),
                   F.concat(F.lit("street-index:"), index.cast("string")),
                   F.concat(F.lit("overlap-set:street-"), sequence))


def parse_observed(text: Column) -> Column:
    """Timestamp of 'yyyy-mm-dd hh:mm:ss[Z]'; NULL when it does not parse."""
    iso = F.concat(F.regexp_replace(F.regexp_replace(text, "Z$", ""), " ", "T"), F.lit("Z"))
    return F.try_to_timestamp(iso)


def shape_results(df: DataFrame, *, case: str, index: str) -> DataFrame:
    """i/n numbering by index and rounded measurements (at most three rows per case)."""
    numbered = top_k(df, [case], [F.col(index)], FRAMES_PER_CASE, "item")
    numbered = with_group_stats(numbered, [case], items=F.count(F.lit(1)))
    return numbered.withColumn("distance_label", half_up(F.col("distance_m")).cast("bigint")) \
        .withColumn("distance_m", half_up(F.col("distance_m"), 1)) \
        .withColumn("heading_gap", half_up(F.col("heading_gap"), 1))
