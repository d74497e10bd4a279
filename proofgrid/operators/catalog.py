"""Scene catalogue, room availability, case status and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.numeric import half_up
from proofgrid.functions.text import natural_key
from proofgrid.operators.capture import INDOOR_ROOMS
from proofgrid.operators.ranking import first_by, join_back, number_rows
from proofgrid.operators.scenes import vote_strict

# Statuses, ranks and coverage scores.
LIVE = ["queued", "running", "ready"]
TERMINAL_STAGE = ["complete", "limited", "skipped", "failed"]
DONE_STAGE = ["complete", "limited", "skipped"]
FLOOR_RANK = {"Basement": 1, "Ground floor": 2, "Upper floor": 3, "Attic": 4}
GAP_CATEGORY, GAP_LABEL = "intelligence_gap", "Interior layout unknown"
EXTERIOR_CANDIDATE_SCORE = 0.24


def room_title(room: Column) -> Column:
    return F.when(room == "unknown", "Unclassified space").otherwise(F.initcap(F.translate(room, "_", " ")))


def scene_of_nodes(nodes: DataFrame, scenes: DataFrame, registered: DataFrame, *, case: str, node: str, direct: str,
                   source: str, scene: str, pos: str) -> DataFrame:
    """The ready scene of each node: its own, else the first sharing a registered source.

    ``scenes`` are the ready photographic scenes with their list position;
    ``registered`` is (case, scene, source); ``nodes`` carry an array of
    source ids.
    """
    ready = scenes.select(case, F.col(scene).alias("__s"), F.col(pos).alias("__p"))
    own = nodes.select(case, node, F.col(direct).alias("__s")).join(ready, [case, "__s"]).select(case, node, F.col("__s").alias("__own"))
    flat = nodes.select(case, node, F.explode(F.array_distinct(source)).alias("__id"))
    linked = flat.join(registered.select(case, F.col(scene).alias("__s"), F.col("source_id").alias("__id")), [case, "__id"]) \
        .join(ready, [case, "__s"])
    shared = linked.groupBy(case, node).agg(F.min_by("__s", "__p").alias("__shared"))
    out = join_back(join_back(nodes, own, [case, node]), shared, [case, node])
    return out.withColumn("scene_id", F.coalesce("__own", "__shared")).drop("__own", "__shared")


def resolve_plan_rooms(labels: DataFrame, nodes: DataFrame, views: DataFrame, *, case: str, label: str, room: str) -> DataFrame:
    """Each plan label with its candidate scenes and whether it is unambiguous.

    ``labels``: case, floor, label id, room type (NULL when no rule fits).
    ``nodes``: case, scene_id, room type, kind.  ``views``: case, scene_id,
    registered view count.
    """
    scenes = nodes.filter((F.col("kind") != "exterior") & F.col("scene_id").isNotNull()).select(case, room, "scene_id").distinct() \
        .join(views, [case, "scene_id"], "left")
    best = scenes.groupBy(case, room).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min_by("scene_id", F.struct(-F.coalesce("views", F.lit(0)), F.col("scene_id"))).alias("first_scene"))
    same = labels.filter(F.col(room).isNotNull()).groupBy(case, "floor", room).agg(F.count(F.lit(1)).alias("same_type"))
    out = join_back(join_back(labels, same, [case, "floor", room]), best, [case, room])
    n, k = F.coalesce("candidates", F.lit(0)), F.coalesce("same_type", F.lit(1))
    detail = (F.when(F.col(room).isNull(), "no_room_type").when(n == 0, "no_scene").when(k > 1, "label_repeats")
              .when(n > 1, "several_scenes").otherwise("unique_match"))
    return out.select(case, "floor", label, room, k.cast("bigint").alias("same_type"), n.cast("bigint").alias("candidates"),
                      detail.alias("detail"), (detail == "unique_match").alias("available"),
                      F.when(detail == "unique_match", F.col("first_scene")).alias("scene_id"))


def scene_labels(scenes: DataFrame, photos: DataFrame, *, case: str, scene: str, created: str) -> DataFrame:
    """Readable scene names, numbered where a base repeats inside a case.

    ``scenes``: mode, is_fallback; ``photos``: case, scene, room_type,
    scene_type, capture_order of every registered view.
    """
    outside = F.coalesce((F.col("scene_type") == "exterior") & ~F.coalesce(F.col("room_type").isin(INDOOR_ROOMS), F.lit(False)), F.lit(False))
    keys = [case, scene]
    facts = photos.groupBy(*keys).agg(F.count(F.lit(1)).alias("views"), F.bool_and(outside).alias("__out"),
                                      F.min(F.coalesce("capture_order", F.lit(2**53))).alias("__order"))
    voted = vote_strict(photos.withColumn("__room", F.when(~F.col("room_type").isin("unknown", "exterior"), F.col("room_type"))),
                        keys=keys, value="__room", out="__room")
    s = join_back(join_back(scenes, facts, keys), voted, keys).withColumn("views", F.greatest(F.lit(1), F.coalesce("views", F.lit(1))))
    plan = F.col("mode") == "floorplan"
    base = (F.when(plan, "House map").when(F.col("__out"), "Exterior").when(F.col("__room").isNotNull(), room_title(F.col("__room")))
            .when(F.col("is_fallback") | (F.col("mode") == "single_image"), "Unclassified view").otherwise("Observed scene"))
    s = s.withColumn("base", base).withColumn("__plan", plan)
    totals = s.filter(~F.col("__plan")).groupBy(case, "base").agg(F.count(F.lit(1)).alias("__total"))
    s = s.withColumn("__order", F.coalesce("__order", F.lit(2**53)))
    ranked = number_rows(s, [case, "base", "__plan"], [F.col("__order"), F.col(created), F.col(scene)], "__rn", F.col("__order"))
    out = join_back(ranked, totals, [case, "base"])
    text = F.concat(F.col("base"), F.when(F.col("__total") > 1, F.concat(F.lit(" "), F.col("__rn").cast("string"))).otherwise(""),
                    F.lit(" · "), F.col("views").cast("string"), F.when(F.col("views") == 1, " view").otherwise(" views"))
    plan_text = F.concat(F.col("base"), F.lit(" · "), F.col("views").cast("string"))
    return out.select(*keys, "base", F.when(F.col("__plan"), plan_text).otherwise(text).alias("label"))


def unavailable_captures(photos: DataFrame, registered: DataFrame, *, keys: list[str], photo: str, room: str) -> DataFrame:
    """Photographs in no scene, counted by room."""
    left = photos.join(registered.select(*keys, photo).distinct(), [*keys, photo], "left_anti")
    room_key = F.coalesce(F.col(room), F.lit("unknown"))
    return left.groupBy(*keys, room_key.alias("room_type")).agg(F.count(F.lit(1)).alias("photos")) \
        .withColumn("label", room_title(F.col("room_type")))


def ordered_scenes(nodes: DataFrame, *, case: str, node: str, scene: str) -> DataFrame:
    """One node per scene, ordered by floor, room type and natural label."""
    one = first_by(nodes.filter(F.col(scene).isNotNull()), [case, scene], [F.col(node)])
    rank = F.when(F.col("kind") == "exterior", 0)
    for name, r in FLOOR_RANK.items():
        rank = rank.when(F.col("floor_label") == name, r)
    one = one.withColumn("__f", rank.otherwise(5)).withColumn("__t", F.coalesce("room_type", "kind")) \
        .withColumn("__k", natural_key(F.col("label")))
    return number_rows(one, [case], [F.col("__f"), F.col("__t"), F.col("__k"), F.col(node)], "place",
                       F.struct("__f", "__t", F.substring("__k", 1, 28))).drop("__f", "__t", "__k")


def dashboard(cases: DataFrame) -> DataFrame:
    """Counts over all cases that are not archived."""
    return cases.filter("status <> 'archived'").agg(
        F.count_if(F.col("status").isin("collecting", "reconstructing")).alias("active"),
        F.count_if(F.col("status") == "briefing_ready").alias("ready"), F.count_if("has_profile").alias("mapped"))


def preparation_progress(stages: DataFrame, artifacts: DataFrame, *, case: str) -> DataFrame:
    """Percentage of three preparation stages; ``stages`` has position 0..2 and status."""
    st = F.col("status")
    s = stages.groupBy(case).agg(
        F.count_if(st.isin(TERMINAL_STAGE)).alias("__done"), F.count_if((F.col("position") < 2) & st.isin(DONE_STAGE)).alias("__pre"),
        F.coalesce(F.bool_or(st == "running"), F.lit(False)).alias("__run"))
    a = artifacts.groupBy(case).agg(F.count_if(st.isin("queued", "running")).alias("__pend"), F.count_if(st == "ready").alias("__ready"))
    out = join_back(s, a, [case]).na.fill(0, ["__pend", "__ready"])
    share = F.col("__ready") / F.greatest(F.lit(1), F.col("__ready") + F.col("__pend"))
    pending = F.least(F.lit(99.0), half_up((F.col("__pre") + share) / 3 * 100))
    settled = F.least(F.lit(100.0), half_up((F.col("__done") + F.when(F.col("__run"), 0.45).otherwise(0.0)) / 3 * 100))
    return out.select(case, F.when(F.col("__pend") > 0, pending).otherwise(settled).cast("int").alias("progress"))


def ready_coverage(artifacts: DataFrame, evidence: DataFrame, *, artifact: str) -> DataFrame:
    """C11: which side of the building a ready artifact covers, and how surely.

    ``artifacts``: mode, is_fallback; ``evidence``: (artifact, tags) rows.
    """
    inside = evidence.groupBy(artifact).agg(F.bool_or(
        F.arrays_overlap("tags", F.array(F.lit("interior"), F.lit("scene:interior")))).alias("__in"))
    out = join_back(artifacts, inside, [artifact])
    plan, joint = F.col("mode") == "floorplan", (F.col("mode") == "multi_image") & ~F.col("is_fallback")
    interior = plan | F.coalesce("__in", F.lit(False))
    score = F.when(interior, F.when(plan, 0.64).when(joint, 0.56).otherwise(0.42)).otherwise(F.when(joint, 0.62).otherwise(0.58))
    return out.select(artifact, F.when(interior, "interior").otherwise("exterior").alias("side"), score.alias("score"))


def exterior_candidates(evidence: DataFrame, *, case: str) -> DataFrame:
    """C11: coverage from discovered exterior images alone."""
    good = (F.col("kind") == "image") & (F.col("scene_type") == "exterior") & (F.col("address_match") != "contradictory")
    n = evidence.groupBy(case).agg(F.count_if(good).alias("candidates"))
    return n.withColumn("score", F.when(F.col("candidates") > 0, EXTERIOR_CANDIDATE_SCORE).otherwise(0.0))


def ready_confidence(mode: Column, fallback: Column, registration: Column) -> Column:
    """Confidence of a finished artifact."""
    return (F.when(mode == "floorplan", 0.64).when(fallback, 0.52)
            .when(mode == "multi_image", F.least(F.lit(0.68), F.lit(0.35) + F.coalesce(registration, F.lit(0.0)) * 0.33)).otherwise(0.58))


def manifest_confidence(registration: Column) -> Column:
    """Confidence written in a joint artifact's manifest."""
    return F.bround(F.lit(0.45) + registration * 0.23, 2)


def reconcile_statuses(cases: DataFrame, artifacts: DataFrame, findings: DataFrame, *, case: str) -> DataFrame:
    """A case waiting for review is ready when it has a scene and nothing but the automatic gap."""
    ready = artifacts.filter("status = 'ready'").select(case).distinct().withColumn("__ready", F.lit(True))
    auto = F.coalesce((F.col("category") == GAP_CATEGORY) & (F.col("label") == GAP_LABEL), F.lit(False))
    only = findings.groupBy(case).agg(F.bool_and(auto).alias("__auto"))
    out = cases.join(ready, case, "left").join(only, case, "left")
    promote = (F.col("status") == "review_required") & F.col("__ready").isNotNull() & F.coalesce("__auto", F.lit(True))
    return out.withColumn("status", F.when(promote, "briefing_ready").otherwise(F.col("status"))).drop("__ready", "__auto")


def workflow_summary(artifacts: DataFrame, *, case: str) -> DataFrame:
    """C14: settled cases with their scene, plan and failed counts."""
    st = F.col("status")
    agg = artifacts.groupBy(case).agg(
        F.count_if(st.isin("queued", "running")).alias("__pend"),
        F.count_if((st == "ready") & (F.col("mode") != "floorplan")).alias("scenes"),
        F.count_if((st == "ready") & (F.col("mode") == "floorplan")).alias("plan_layers"), F.count_if(st == "failed").alias("failed_groups"))
    agg = agg.filter((F.col("__pend") == 0) & (F.col("scenes") + F.col("plan_layers") > 0))
    return agg.withColumn("stage_status", F.when(F.col("failed_groups") > 0, "limited").otherwise("complete")).drop("__pend")


def final_status(cases: DataFrame, artifacts: DataFrame, *, case: str, order: list[Column]) -> DataFrame:
    """Status of a prepared case from its first live artifact."""
    live = first_by(artifacts.filter(F.col("status").isin(LIVE)), [case], order).select(case, F.col("status").alias("__st"))
    return cases.join(live, case, "left").withColumn("final_status", F.when(F.col("__st") == "ready", "briefing_ready")
                                                     .when(F.col("__st").isNotNull(), "reconstructing").otherwise("limited_evidence")).drop("__st")


def apply_reviews(items: DataFrame, reviews: DataFrame, *, case: str, item: str, order: list[str]) -> DataFrame:
    """The latest review of each item of the same case; others stay as they are."""
    last = reviews.groupBy(case, item).agg(F.max_by(F.struct("review", "note"), F.struct(*order)).alias("__r"),
                                           F.max(F.struct(*order)).alias("__at"))
    out = items.join(last, [case, item], "left")
    return out.withColumn("review", F.coalesce("__r.review", "review")).withColumn("review_note", F.col("__r.note")) \
        .withColumn("reviewed_at", F.col(f"__at.{order[0]}")).drop("__r", "__at")


def apply_patches(rows: DataFrame, patches: DataFrame, *, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Per field the last patch that supplies it; a missing field keeps the current value."""
    seq = F.struct(*order)
    last = patches.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), seq)).alias(f"__{f}") for f in fields])
    out = rows.join(last, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"__{f}", f))
    return out.drop(*[f"__{f}" for f in fields])


def toggle_archive(status: Column, archive: Column) -> Column:
    """Archiving, and bringing a case back as limited evidence."""
    return F.when(archive, "archived").when((status == "archived") & ~archive, "limited_evidence").otherwise(status)


def same_type_counts(labels: DataFrame, *, keys: list[str], room: str) -> DataFrame:
    """How many labels of a floor have the same room type; unknown types count one."""
    n = labels.filter(F.col(room).isNotNull()).groupBy(*keys, room).agg(F.count(F.lit(1)).alias("__n"))
    return join_back(labels, n, [*keys, room]).withColumn("same_type", F.coalesce("__n", F.lit(1)).cast("bigint")).drop("__n")
