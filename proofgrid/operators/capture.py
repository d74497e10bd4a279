"""Capture eligibility, ordering and overlapping batch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.ranking import join_back, number_rows, top_k, with_group_stats

# Limits and word lists of the planning rules.
MAX_BATCH = 12
BRIDGE = 3
EXCLUDED_TAG = "reconstruction-excluded"
FLOOR_PLAN_TAG = "plan-candidate"
INDOOR_ROOMS = ["bedroom", "bathroom", "kitchen", "dining_room", "office", "garage", "basement", "attic",
                "corridor", "closet", "stair", "utility"]
LIVE_STATUSES = ["queued", "running", "ready"]


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def capture_eligible(local_url: Column, mime: Column, tags: Column) -> Column:
    """A local image that no rule has excluded."""
    return (
        (F.coalesce(local_url, F.lit("")) != "")
        & F.coalesce(mime.startswith("image/"), F.lit(False))
        & ~has_tag(tags, EXCLUDED_TAG)
    )


def reconstruction_eligible(local_url: Column, mime: Column, tags: Column, address_match: Column) -> Column:
    """Also needs an upload tag, a text or listing match, or a supported address."""
    evidence = F.arrays_overlap(
        tags, F.array(*[F.lit(t) for t in ("operator-upload", "address-text-match", "listing-address-match")])
    )
    supported = F.coalesce(address_match == "supported", F.lit(False))
    return capture_eligible(local_url, mime, tags) & (F.coalesce(evidence, F.lit(False)) | supported)


def evidence_priority(tags: Column, relevance: Column, address_match: Column) -> Column:
    """Additive priority of one evidence row."""
    def points(cond, n):
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    overlap = F.exists(tags, lambda t: t.startswith("overlap-set:"))
    return (
        points(has_tag(tags, "operator-upload"), 20) + points(has_tag(tags, "property-photo"), 10)
        + points(relevance == "likely", 8) + points(address_match == "supported", 12)
        + points(has_tag(tags, "address-text-match"), 10) + points(address_match == "contradictory", -50)
        + points(overlap, 3) + points(has_tag(tags, "property-proximity-unverified"), -8)
    )


def queue_top(df: DataFrame, live: DataFrame, *, key: str, score: str, order: list[Column],
              limit: int = MAX_BATCH) -> DataFrame:
    """Best rows per case, for cases that have no live artifact yet."""
    waiting = df.join(live.select(key).distinct(), key, "left_anti")
    return top_k(waiting, [key], [F.col(score).desc(), *order], limit)


def capture_zone(scene_type: Column, room_type: Column) -> Column:
    """The zone a frame belongs to; a concrete indoor room beats a weak exterior label."""
    room = F.coalesce(room_type, F.lit(""))
    scene = F.coalesce(scene_type, F.lit(""))
    return (
        F.when((room == "exterior") | ((scene == "exterior") & ~room.isin(INDOOR_ROOMS)), F.lit("exterior"))
        .when(~room.isin("", "unknown"), F.concat(F.lit("room:"), room))
        .when(scene == "interior", F.lit("interior_other"))
        .otherwise(F.lit("unknown"))
    )


def semantic_groups(df: DataFrame, *, case: str, order: str, zone: str, analysed: Column,
                    share: float = 0.75, out: str = "group_key", first: str = "group_first") -> DataFrame:
    """Split a case by zone when enough frames are analysed and zones differ.

    ``out`` names the group (NULL for an undivided case) and ``first`` holds its
    smallest capture order, which orders the groups of a case.  All case and
    zone figures come from one map-side combined aggregate per zone.
    """
    zones = df.groupBy(case, zone).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(analysed).alias("__a"), F.min(order).alias("__first")
    )
    cases = zones.groupBy(case).agg(
        F.sum("__n").alias("__tn"), F.sum("__a").alias("__ta"), F.count(F.lit(1)).alias("__zones"),
        F.min("__first").alias("__case_first"),
    )
    split = (F.col("__ta") >= F.ceil(F.col("__tn") * share)) & (F.col("__zones") > 1)
    facts = join_back(zones, cases, [case]).select(
        case, zone, F.when(split, F.col(zone)).alias(out),
        F.when(split, F.col("__first")).otherwise(F.col("__case_first")).alias(first),
    )
    return join_back(df, facts, [case, zone])


def plan_batches(df: DataFrame, *, case: str, frame: str, order: list[Column], group: str | None = None,
                 group_first: str | None = None, max_batch: int = MAX_BATCH, bridge: int = BRIDGE,
                 slice_by: Column | None = None) -> DataFrame:
    """Overlapping batches of an ordered walk, in closed form.

    A frame at position r is in every batch b with b*stride <= r < b*stride+max;
    bridge frames are the ones shared with the previous batch of the group.
    Batch numbers run on across the groups of a case.
    """
    if max_batch < 2:
        raise ValueError("a batch must hold at least two frames")
    if not 1 <= bridge < max_batch:
        raise ValueError("bridge must be between 1 and max_batch - 1")
    stride = max_batch - bridge
    keys = [case] if group is None else [case, group]
    ranked = number_rows(df, keys, order, "__rn", slice_by)
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *([F.min(group_first).alias("__gf")] if group_first else []),
    )
    batches = F.when(F.col("__n") <= max_batch, F.lit(1)).otherwise(
        F.ceil((F.col("__n") - max_batch) / stride) + 1).cast("bigint")
    sizes = sizes.withColumn("__batches", batches)
    if group is None:
        sizes = sizes.withColumn("__base", F.lit(0).cast("bigint"))
    else:
        by = [F.col("__gf")] if group_first else []
        sizes = _exclusive_sum(sizes, case, [*by, F.col(group)])
    placed = join_back(ranked, sizes.select(*keys, "__batches", "__base"), keys)
    r = F.col("__rn") - 1
    low = F.greatest(F.lit(0), F.ceil((r - (max_batch - 1)) / stride)).cast("bigint")
    high = F.least(F.floor(r / stride), F.col("__batches") - 1).cast("bigint")
    out = placed.withColumn("__b", F.explode(F.sequence(low, high))).withColumn("__pos", r - F.col("__b") * stride)
    return out.select(
        case, *( [group] if group else []), (F.col("__base") + F.col("__b")).alias("batch_index"),
        F.col("__pos").alias("pos"), F.col(frame),
        ((F.col("__b") > 0) & (F.col("__pos") < bridge)).alias("is_bridge"),
    )


def _exclusive_sum(sizes: DataFrame, case: str, order: list[Column]) -> DataFrame:
    from pyspark.sql import Window
    # one row per zone of a case: bounded by the number of zone names
    w = Window.partitionBy(case).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__base", F.coalesce(F.sum("__batches").over(w), F.lit(0)).cast("bigint"))


def evidence_split(tags: Column, scene_type: Column, kind: Column) -> Column:
    """P06: 'excluded', 'plan' or 'photo'; the exclusion tag dominates."""
    plan = (F.coalesce(scene_type == "floor_plan", F.lit(False)) | F.coalesce(kind == "blueprint", F.lit(False))
            | has_tag(tags, FLOOR_PLAN_TAG))
    return (F.when(has_tag(tags, EXCLUDED_TAG), F.lit("excluded")).when(plan, F.lit("plan"))
            .otherwise(F.lit("photo")))


def order_plans(df: DataFrame, *, case: str, floor: str, order: list[Column], limit: int = MAX_BATCH) -> DataFrame:
    """Numbered plans first by number, then the rest by capture order.

    A missing number becomes the position.  The first ``limit`` plans form the
    job, as the feature defines; numbers must be unique and within 1..limit.
    """
    ranked = top_k(df, [case], [F.col(floor).isNull(), F.col(floor), *order], limit, "plan_pos")
    ranked = ranked.withColumn("floor_used", F.coalesce(F.col(floor), F.col("plan_pos")))
    counts = ranked.groupBy(case, "floor_used").agg(F.count(F.lit(1)).alias("__c"))
    ok = F.col("floor_used").between(1, limit) & (F.col("__c") == 1)
    return join_back(ranked, counts, [case, "floor_used"]).withColumn("floor_ok", ok).drop("__c")


def minimum_connected(n: Column) -> Column:
    """A registered core needs two frames, whatever the set size."""
    return F.lit(2).cast("bigint") + n * 0


def representative_connected(n: Column) -> Column:
    """Half the set, at least two, counts as representative."""
    return F.greatest(F.lit(2).cast("bigint"), F.ceil(n / 2))


def plan_totals(df: DataFrame, *, case: str, eligible: Column) -> DataFrame:
    """Totals per plan."""
    return df.groupBy(case).agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if(eligible).alias("eligible_frames"),
        F.count_if(~F.coalesce(eligible, F.lit(False))).alias("excluded_frames"),
    )


def job_mode(members: DataFrame, *, batch: list[str], projection: Column) -> DataFrame:
    """P10: one non-perspective photo -> panorama, a batch of one -> single, else multi."""
    facts = members.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(projection != "perspective").alias("__wide"))
    mode = (F.when((F.col("frames") == 1) & (F.col("__wide") == 1), F.lit("panorama"))
            .when(F.col("frames") == 1, F.lit("single")).otherwise(F.lit("multi")))
    return facts.withColumn("mode", mode).drop("__wide")
