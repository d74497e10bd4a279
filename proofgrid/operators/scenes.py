"""Frame matching, coverage groups, room graphs and scene selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.numeric import add, dist3, dot, half_up, rotate_up
from proofgrid.operators.cells import near_rows
from proofgrid.operators.graph import component_labels, connected_components, forest_of_trees, spanning_forest
from proofgrid.operators.ranking import exact_median, first_by, join_back, number_rows, top_k, with_group_stats
from proofgrid.session import stored

# Match gates, nomination limits and room-graph constants.
RATIO_TEST = 0.72
MIN_MUTUAL = 18
MIN_INLIERS, MIN_INLIER_RATIO = 15, 0.22
PLANAR_LIMIT = 0.72
SPREAD_RATIO, SPREAD_CELLS, SPREAD_HULL = 0.45, 8, 0.20
LEARNED_RAW, LEARNED_INLIERS, LEARNED_RATIO, LEARNED_PLANAR = 20, 18, 0.45, 0.58
LEARNED_SPREAD_RATIO, LEARNED_SPREAD_CELLS = 0.68, 7
MIN_PLANAR_POINTS = 8
SESSION_GAP_SECONDS = 120
STOREY_METRES, STOREY_SPLIT_METRES = 2.8, 2.0
CHAIN_METRES = 3.0
ROOM_LINK_METRES = 12.0
LINK_WORDS = ["door", "corridor", "stair_up", "stair_down"]
WEAK_SUPPORT, COMPOSITE_SUPPORT, COMPOSITE_FRAMES = 0.15, 0.3, 3
FLOOR_NAMES = {"basement": ("Basement", -1), "ground": ("Ground floor", 0), "upper": ("Upper floor", None),
               "attic": ("Attic", None)}
BLOCK_ROWS = 2048


# --- M01 to M05: pair evidence

def mutual_matches(descriptors: DataFrame, *, pair: list[str], side: str, feature: str, vector: str,
                   ratio: float = RATIO_TEST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mutual nearest neighbours that pass the ratio test in both directions.

    ``side`` is 'a' or 'b'.  Both sides of a pair are cut into hashed blocks of
    about ``block_rows`` rows; each block pair is one dense distance block that
    yields two neighbours per row, and the block results are merged.  A pair of
    ordinary frames is a single block; a huge one is spread over many tasks.
    """
    counts = descriptors.groupBy(*pair, side).agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.groupBy(*pair).agg(
        *[F.coalesce(F.max(F.when(F.col(side) == s, F.ceil(F.col("n") / block_rows))), F.lit(0)).cast("int")
          .alias(f"__b{s}") for s in "ab"]).filter("__ba > 0 and __bb > 0")
    rows = join_back(descriptors.select(*pair, side, feature, vector), blocks, pair, "inner")
    is_a = F.col(side) == "a"
    own = F.when(is_a, F.pmod(F.xxhash64(feature), "__ba")).otherwise(F.pmod(F.xxhash64(feature), "__bb"))
    other = F.explode(F.sequence(F.lit(0), F.when(is_a, F.col("__bb")).otherwise(F.col("__ba")) - 1))
    placed = rows.withColumn("__own", own.cast("int")).withColumn("__other", other).select(
        *pair, side, feature, vector, F.when(is_a, F.col("__own")).otherwise(F.col("__other")).alias("__qa"),
        F.when(is_a, F.col("__other")).otherwise(F.col("__own")).alias("__qb"))
    fields = [descriptors.schema[p] for p in pair]
    ftype = descriptors.schema[feature].dataType
    schema = T.StructType([*fields, T.StructField("side", T.StringType()), T.StructField("feature", ftype),
                           T.StructField("near", ftype), T.StructField("dist", T.DoubleType())])

    def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {s: pdf[pdf[side] == s] for s in "ab"}
        if parts["a"].empty or parts["b"].empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        xs = {s: np.stack(p[vector].to_numpy()).astype(np.float64) for s, p in parts.items()}
        d = np.sqrt(np.maximum(
            (xs["a"] ** 2).sum(1)[:, None] + (xs["b"] ** 2).sum(1)[None, :] - 2.0 * xs["a"] @ xs["b"].T, 0.0))
        out = []
        for s, o, m in (("a", "b", d), ("b", "a", d.T)):
            ids, near = parts[s][feature].to_numpy(), parts[o][feature].to_numpy()
            k = min(2, m.shape[1])
            best = np.argpartition(m, k - 1, axis=1)[:, :k]
            out.append(pd.DataFrame({
                "side": s, "feature": np.repeat(ids, k), "near": near[best].ravel(),
                "dist": np.take_along_axis(m, best, axis=1).ravel()}))
        res = pd.concat(out)
        for p in reversed(pair):
            res.insert(0, p, pdf[p].iloc[0])
        return res

    found = placed.groupBy(*pair, "__qa", "__qb").applyInPandas(neighbours, schema)
    two = top_k(found, [*pair, "side", "feature"], [F.col("dist"), F.col("near")], 2, "__r")
    tested = two.groupBy(*pair, "side", "feature").agg(
        F.min_by("near", "__r").alias("near"), F.min(F.when(F.col("__r") == 1, F.col("dist"))).alias("d1"),
        F.min(F.when(F.col("__r") == 2, F.col("dist"))).alias("d2")).filter(F.col("d1") < ratio * F.col("d2"))
    forward = tested.filter("side = 'a'").select(*pair, F.col("feature").alias("fa"), F.col("near").alias("fb"), "d1")
    reverse = tested.filter("side = 'b'").select(*pair, F.col("near").alias("fa"), F.col("feature").alias("fb"))
    return forward.join(reverse, [*pair, "fa", "fb"]).select(*pair, "fa", "fb", F.col("d1").alias("distance"))


def distributed(ratio: Column, cells: Column, hull: Column, min_ratio: float, min_cells: int) -> Column:
    return (ratio >= min_ratio) & (cells >= min_cells) & (hull >= SPREAD_HULL)


def feature_gate(mutual: Column, inliers: Column, planar: Column, cells: Column, hull: Column) -> Column:
    """Acceptance, confidence and reason of a feature-matched pair."""
    ratio = inliers / mutual
    spread = distributed(ratio, cells, hull, SPREAD_RATIO, SPREAD_CELLS)
    reason = (F.when(mutual < MIN_MUTUAL, "too_few_mutual_matches")
              .when((inliers < MIN_INLIERS) | (ratio < MIN_INLIER_RATIO), "weak_geometry")
              .when((planar >= PLANAR_LIMIT) & ~spread, "one_plane_dominates"))
    score = F.least(F.lit(1.0), inliers / 80.0) * 0.55 + F.least(F.lit(1.0), ratio / 0.65) * 0.45
    return F.struct(reason.isNull().alias("accepted"), F.when(reason.isNull(), score).alias("confidence"),
                    reason.alias("reason"))


def learned_gate(raw: Column, inliers: Column, ratio: Column, mean_confidence: Column, planar: Column, cells: Column,
                 hull: Column) -> Column:
    """The same for a learned matcher."""
    spread = distributed(ratio, cells, hull, LEARNED_SPREAD_RATIO, LEARNED_SPREAD_CELLS)
    ok = ((raw >= LEARNED_RAW) & (inliers >= LEARNED_INLIERS) & (ratio >= LEARNED_RATIO)
          & ((planar < LEARNED_PLANAR) | spread))
    score = (F.least(F.lit(1.0), inliers / 80.0) * 0.55 + F.least(F.lit(1.0), ratio / 0.8) * 0.35
             + F.least(F.lit(1.0), mean_confidence / 0.5) * 0.10)
    return F.struct(ok.alias("accepted"), F.when(ok, score).alias("confidence"),
                    F.when(~ok, "learned_gate_failed").alias("reason"))


def accept_pairs(feature: DataFrame, learned: DataFrame, *, pair: list[str]) -> DataFrame:
    """Learned results count only for pairs the feature gate has not accepted."""
    first = feature.filter("accepted").select(*pair, "confidence", F.lit("feature").alias("method"))
    rest = learned.join(first.select(*pair), pair, "left_anti").filter("accepted")
    return first.unionByName(rest.select(*pair, "confidence", F.lit("learned").alias("method")))


def cell_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Cell 0..15 of a 4x4 grid, clipped to the image."""
    def index(v, size):
        return F.least(F.lit(3), F.greatest(F.lit(0), (F.try_divide(v, F.when(size > 0, size)) * 4).cast("int")))

    return index(y, height) * 4 + index(x, width)


def hull_ring(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, monotone chain."""
    pts = np.unique(np.column_stack([np.asarray(x, float), np.asarray(y, float)]), axis=0)
    if len(pts) < 3:
        return pts

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    nx, ny = np.roll(ring[:, 0], -1), np.roll(ring[:, 1], -1)
    return float(abs((ring[:, 0] * ny - ring[:, 1] * nx).sum()) / 2)


def map_runs(df: DataFrame, by: list[str], kernel, schema: T.StructType, keys: list[str]) -> DataFrame:
    """``kernel`` on the numbers of every group of ``by``, for very many groups of bounded size.

    Groups lie side by side in sorted partitions and are read batch by batch, so a group costs a slice of a batch and
    no call of its own; the last group of a batch waits for the next one.  ``kernel`` takes a matrix of the columns
    not in ``by`` and returns one of the columns of ``schema`` not in ``keys``.
    """
    rest, numbers = [f.name for f in schema if f.name not in keys], [c for c in df.columns if c not in by]

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            starts = _run_starts(held[by])
            if len(starts) > 1:
                yield of(held.iloc[:starts[-1]], starts[:-1])
                held = held.iloc[starts[-1]:].reset_index(drop=True)
        if held is not None and len(held):
            yield of(held, _run_starts(held[by]))

    def of(rows, starts):
        values = rows[numbers].to_numpy(float)
        out = [kernel(part) for part in np.split(values, starts[1:])]
        first = rows[keys].iloc[np.repeat(starts, [len(o) for o in out])].reset_index(drop=True)
        return pd.concat([first, pd.DataFrame(np.concatenate(out), columns=rest)], axis=1)

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def _run_starts(named: pd.DataFrame) -> np.ndarray:
    """Where a row differs from the one before; nulls are equal."""
    before = named.shift()
    differs = ((named != before) & ~(named.isna() & before.isna())).any(axis=1).to_numpy()
    return np.flatnonzero(differs | (np.arange(len(named)) == 0))


def match_spread(points: DataFrame, *, keys: list[str], x: str, y: str, width: str, height: str) -> DataFrame:
    """Occupied cells and hull coverage of each side of a pair.

    Inside a thin column of the image only the lowest and the highest point of
    each distinct x can be a hull vertex; rows are cut down to those by an
    aggregate, so the kernel sees at most two rows per distinct x.
    """
    w, h = F.col(width), F.col(height)
    facts = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(cell_of(F.col(x), F.col(y), w, h)).alias("cells"),
        F.max(F.when((w > 0) & (h > 0), w * h)).alias("image_area"))
    ends = points.groupBy(*keys, F.col(x).cast("double").alias("u")).agg(
        F.min(F.col(y).cast("double")).alias("lo"), F.max(F.col(y).cast("double")).alias("hi"))
    # a first hull per hashed part, of about 4 096 columns, keeps the second one small for a huge pair; fewer than
    # three points, or one column, span no area
    n_points = F.sum(F.when(F.col("lo") < F.col("hi"), 2).otherwise(1))
    sizes = ends.groupBy(*keys).agg(F.ceil(F.count("u") / 4096).alias("__parts"), F.count("u").alias("__u"), n_points.alias("__p"))
    parts = join_back(ends, sizes, keys).filter((F.col("__u") > 1) & (F.col("__p") > 2)).select(
        *keys, F.pmod(F.xxhash64("u"), F.col("__parts")).cast("int").alias("part"), "u", "lo", "hi")
    key_fields = [points.schema[k] for k in keys]
    partial = T.StructType([*key_fields, T.StructField("u", T.DoubleType()), T.StructField("v", T.DoubleType())])
    final = T.StructType([*key_fields, T.StructField("hull", T.DoubleType())])

    def corners(rows: np.ndarray) -> np.ndarray:
        return hull_ring(np.repeat(rows[:, 0], 2), rows[:, 1:].ravel())

    def area(rows: np.ndarray) -> np.ndarray:
        return np.array([[ring_area(hull_ring(rows[:, 0], rows[:, 1]))]])

    hulls = map_runs(map_runs(parts, [*keys, "part"], corners, partial, keys), keys, area, final, keys)
    few = (F.col("n") < 3) | ~F.coalesce(F.col("image_area") > 0, F.lit(False))
    return join_back(facts, hulls, keys).select(
        *keys, F.when(few, 0).otherwise(F.col("cells")).cast("bigint").alias("cells"),
        F.when(few, 0.0).otherwise(F.try_divide(F.coalesce("hull", F.lit(0.0)), "image_area")).alias("hull_coverage"))


def pair_spread(matches: DataFrame, *, keys: list[str], a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> DataFrame:
    """Spread of both sides of a pair and the smaller of each figure.

    ``a`` and ``b`` name x, y, width and height of a match in either image.  Each match becomes a row per side, so both
    hulls come from one pass over the matches.
    """
    names = ("x", "y", "width", "height")
    rows = matches.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
        for side, columns in (("a", a), ("b", b))])))
    sides = match_spread(rows, keys=[*keys, "side"], x="x", y="y", width="width", height="height")
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    return sides.groupBy(*keys).agg(
        F.min("cells").alias("min_cells"), F.min("hull_coverage").alias("min_hull"), of("cells", "a").alias("cells_a"),
        of("cells", "b").alias("cells_b"), of("hull_coverage", "a").alias("hull_a"), of("hull_coverage", "b").alias("hull_b"))


def planar_dominance(matches: DataFrame, *, pair: list[str], planar: str) -> DataFrame:
    """Share of inliers one plane explains; 0 under eight points."""
    n = F.count(F.lit(1))
    return matches.groupBy(*pair).agg(
        F.when(n >= MIN_PLANAR_POINTS, F.avg(F.col(planar).cast("double"))).otherwise(0.0).alias("planar_dominance"))


def rejected_pairs(attempted: DataFrame, accepted: DataFrame, *, pair: list[str], reasons: list[str]) -> DataFrame:
    """Attempted pairs that no gate accepted, with their joined reasons."""
    return attempted.join(accepted.select(*pair).distinct(), pair, "left_anti").select(
        *pair, F.concat_ws("; ", *reasons).alias("reason"))


# --- M06, M07, M10: components and coverage

def component_stats(edges: DataFrame, vertices: DataFrame, *, group: list[str], a: str, b: str,
                    weight: str) -> tuple[DataFrame, DataFrame]:
    """(group..., vertex, component), and size and summed edge weight of each component."""
    edges = stored(edges.select(*group, F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("weight")), "edges")
    found = component_labels(edges.select(*group, "a", "b"), group)
    labels = stored(vertices.distinct().join(found, [*group, "vertex"], "left").withColumn(
        "component", F.coalesce("component", "vertex")), "labels")
    inside = edges.join(labels.withColumnRenamed("vertex", "a"), [*group, "a"]).groupBy(*group, "component").agg(
        F.sum("weight").alias("weight"))
    sizes = labels.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("size"))
    facts = join_back(sizes, inside, [*group, "component"]).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return labels, facts


def strongest_component(edges: DataFrame, vertices: DataFrame, *, group: list[str], a: str, b: str,
                        weight: str) -> DataFrame:
    """Members of the largest component; ties by summed confidence, then smallest member."""
    labels, facts = component_stats(edges, vertices, group=group, a=a, b=b, weight=weight)
    best = stored(first_by(facts, group, [F.col("size").desc(), F.round("weight", 9).desc(), F.col("component")]), "best")
    return labels.join(best, [*group, "component"])


def coverage_groups(edges: DataFrame, candidates: DataFrame, *, group: list[str], a: str, b: str, weight: str,
                    verified: bool = False) -> DataFrame:
    """Candidate frames by component, ordered by size, confidence and first frame.

    Edges count only between candidates; singletons stay unless ``verified``.
    """
    candidates = stored(candidates, "candidates")
    inside = edges
    for end in (a, b):
        inside = inside.join(candidates.withColumnRenamed("vertex", end), [*group, end], "left_semi")
    labels, facts = component_stats(inside, candidates, group=group, a=a, b=b, weight=weight)
    if verified:
        facts = facts.filter("size >= 2")
    ranked = number_rows(stored(facts, "facts"), group, [F.col("size").desc(), F.round("weight", 9).desc(), F.col("component")],
                         "group_rank", slice_by=-F.col("size"))
    return join_back(labels, ranked, [*group, "component"], "inner")


def remaining_inputs(groups: DataFrame, artifacts: DataFrame, poses: DataFrame, *, case: str, artifact: str,
                     evidence: str) -> DataFrame:
    """Group members not yet represented by a live or ready artifact.

    Queued and running artifacts represent all inputs, ready multi-image ones
    their posed frames, other ready ones their single input; failed and plan
    artifacts nothing.
    """
    live = artifacts.filter((F.col("mode") != "floorplan") & F.col("status").isin("queued", "running")) \
        .select(case, F.explode("evidence_ids").alias(evidence))
    ready = artifacts.filter((F.col("mode") != "floorplan") & (F.col("status") == "ready"))
    posed = ready.filter("mode = 'multi_image'").join(poses, artifact).select(ready[case], poses[evidence])
    single = ready.filter("mode <> 'multi_image'").select(case, F.get("evidence_ids", 0).alias(evidence))
    return groups.join(live.unionByName(posed).unionByName(single).distinct(), [case, evidence], "left_anti")


# --- M08: nomination

def nominate_frames(frames: DataFrame, core: DataFrame, *, scene: list[str], frame: str, embedding: str, device: str,
                    seconds: str) -> DataFrame:
    """Frames that belong to a scene by place affinity or capture continuity.

    Mean similarity to the core is one product with the summed core vector, so
    frames are not paired with core frames; only the core itself, at most one
    batch of frames, is paired for its median; its capture times per device are
    one short array.  Frames without a device have no nearest capture.
    """
    members = frames.join(core.select(*scene, frame), [*scene, frame], "left_semi")
    others = frames.join(core.select(*scene, frame), [*scene, frame], "left_anti")
    left = members.select(*scene, F.col(frame).alias("__fa"), F.col(embedding).alias("__ea"))
    right = members.select(*scene, F.col(frame).alias("__fb"), F.col(embedding).alias("__eb"))
    pairs = left.join(right, scene).filter("__fa < __fb").select(*scene, dot(F.col("__ea"), F.col("__eb")).alias("__s"))
    medians = exact_median(pairs, scene, "__s", "core_median")
    summed = members.select(*scene, F.posexplode(embedding).alias("__i", "__v")).groupBy(*scene, "__i").agg(
        F.sum(F.col("__v").cast("double")).alias("__v"))
    sums = summed.groupBy(*scene).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias("__sum"))
    counts = members.groupBy(*scene).agg(F.count(F.lit(1)).alias("__core"))
    named = F.length(F.trim(F.col(device))) > 0
    taken = members.filter(named).groupBy(*scene, F.col(device).alias("__d")).agg(F.collect_list(seconds).alias("__cs"))
    gaps = others.filter(named).select(*scene, frame, F.col(device).alias("__d"), F.col(seconds).alias("__os")) \
        .join(taken, [*scene, "__d"]).groupBy(*scene, frame).agg(F.min(F.array_min(F.transform(
            "__cs", lambda c: F.abs(F.col("__os") - c)))).alias("nearest_seconds"))
    facts = join_back(join_back(join_back(others, sums, scene), counts, scene), medians, scene)
    facts = join_back(facts, gaps, [*scene, frame]).withColumn(
        "affinity", dot(F.col("__sum"), F.col(embedding)) / F.col("__core"))
    visual = F.coalesce(F.col("affinity") >= F.greatest(F.lit(0.22), F.col("core_median") * 0.85), F.lit(False))
    session = F.coalesce(F.col("nearest_seconds") <= SESSION_GAP_SECONDS, F.lit(False))
    return facts.select(
        *scene, frame, "affinity", "nearest_seconds", session.alias("session_match"), (session | visual).alias("accepted"),
        F.greatest(F.lit(0.12), F.col("core_median") * 0.65).alias("reported_threshold"))


# --- M09: forest, anchor

def connection_tree(edges: DataFrame, *, group: list[str], a: str, b: str, confidence: str,
                    pos: str) -> tuple[DataFrame, DataFrame]:
    """Tree edges of the strongest tree per scene, and its anchor frame.

    Best edges first, ties in input order; the tree is chosen by size, summed
    tree confidence and smallest member; the anchor has the highest summed tree
    confidence, ties to the lowest frame.
    """
    marked = forest_of_trees(edges, group=group, a=a, b=b, order=[-F.col(confidence), F.col(pos)], edge_id=pos)
    trees = marked.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("__e"), F.sum(confidence).alias("__w"))
    best = stored(first_by(trees, group, [F.col("__e").desc(), F.round("__w", 9).desc(), F.col("component")]), "best")
    tree = stored(marked.join(best.select(*group, "component"), [*group, "component"], "left_semi"), "tree")
    ends = tree.select(*group, F.col(a).alias("anchor"), F.col(confidence).alias("__c")) \
        .unionByName(tree.select(*group, F.col(b).alias("anchor"), F.col(confidence).alias("__c")))
    strength = ends.groupBy(*group, "anchor").agg(F.round(F.sum("__c"), 9).alias("strength"))
    return tree, first_by(strength, group, [F.col("strength").desc(), F.col("anchor")])


# --- M11 to M13: which evidence and which scenes count

def connected_ids(ids: Column, fallback_id: Column, registered: Column, connected: Column, count: Column) -> Column:
    """Fallback source, else the first id, else the reported indices, else the first k."""
    listed = F.array_compact(F.transform(F.filter(connected, lambda i: i >= 0), lambda i: F.get(ids, i)))
    return (F.when(fallback_id.isNotNull(), F.array(fallback_id)).when(~registered, F.slice(ids, 1, 1))
            .when(F.coalesce(F.size(connected), F.lit(0)) > 0, listed).otherwise(F.slice(ids, F.lit(1), count)))


def displayable(mode: Column, support: Column, frames: Column) -> Column:
    """Weak composites are hidden; unknown support passes."""
    weak = (support < WEAK_SUPPORT) | ((F.coalesce(frames, F.lit(0)) >= COMPOSITE_FRAMES) & (support < COMPOSITE_SUPPORT))
    return (mode != "multi_image") | support.isNull() | ~weak


def maximal_scenes(scenes: DataFrame, *, case: str, scene: str, ids: str, order: list[Column]) -> DataFrame:
    """Scenes not contained in an earlier scene of the order (size first).

    Containment is transitive, so being contained in any earlier scene decides.
    A superset holds the scene's rarest id, so only scenes sharing that id are
    compared.
    """
    key = F.struct((-F.size(ids)).alias("k0"), *[c.alias(f"k{i + 1}") for i, c in enumerate(order)])
    s = scenes.withColumn("__ids", F.array_distinct(ids)).withColumn("__key", key)
    flat = s.select(case, scene, F.explode("__ids").alias("__id"))
    use = flat.groupBy(case, "__id").agg(F.count(F.lit(1)).alias("__use"))
    rarest = flat.join(use, [case, "__id"]).groupBy(case, scene).agg(
        F.min(F.struct("__use", "__id"))["__id"].alias("__id"))
    mine = s.join(rarest, [case, scene]).select(case, "__id", scene, "__ids", "__key")
    theirs = flat.join(s.select(case, scene, F.col("__ids").alias("__big"), F.col("__key").alias("__bigkey")), [case, scene]) \
        .select(case, "__id", "__big", "__bigkey")
    dominated = mine.join(theirs, [case, "__id"]).filter(
        (F.col("__bigkey") < F.col("__key")) & (F.size(F.array_except("__ids", "__big")) == 0)).select(case, scene)
    return scenes.join(dominated.distinct(), [case, scene], "left_anti")


def novel_scenes(scenes: DataFrame, *, case: str, scene: str, ids: str, order: list[Column]) -> DataFrame:
    """Greedy scan that keeps a scene only if it adds an id.

    A skipped scene adds nothing to the covered set, so the covered set before
    a scene is the union of all earlier scenes: a scene is kept exactly when it
    is the first one to hold some id.
    """
    key = F.struct(*order)
    flat = scenes.select(case, scene, F.explode(ids).alias("__id"), key.alias("__key"))
    firsts = flat.groupBy(case, "__id").agg(F.min_by(scene, "__key").alias(scene))
    return scenes.join(firsts.select(case, scene).distinct(), [case, scene], "left_semi")


# --- M14 to M17: rooms and levels

def compatible(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Two views may show one space; unknown matches anything, NULL levels too."""
    def agree(x, y):
        return x.isin("unknown") | y.isin("unknown") | (x == y)

    room = agree(F.coalesce(a["room"], F.lit("unknown")), F.coalesce(b["room"], F.lit("unknown")))
    floor = agree(F.coalesce(a["floor"], F.lit("unknown")), F.coalesce(b["floor"], F.lit("unknown")))
    level = a["level"].isNull() | b["level"].isNull() | (a["level"] == b["level"])
    return room & floor & level


def room_groups(views: DataFrame, pairs: DataFrame, *, scene: list[str], view: str, order: list[Column],
                slice_by: Column | None = None) -> DataFrame:
    """Views grouped into observed spaces.

    Measured pairs connect compatible views.  A scene without any measured pair
    chains capture-order neighbours whose cameras are at most three metres
    apart.  ``views`` has room, floor, level, px, py, pz.
    """
    cols = ["room", "floor", "level", "px", "py", "pz"]
    def side(n):
        return views.select(*scene, F.col(view).alias(f"v{n}"), *[F.col(c).alias(f"{c}{n}") for c in cols])

    measured = pairs.select(*scene, "va", "vb").join(side("a"), [*scene, "va"]).join(side("b"), [*scene, "vb"])
    unmeasured = views.join(measured.select(*scene).distinct(), scene, "left_anti")
    numbered = number_rows(unmeasured, scene, order, "__rn", slice_by)
    prev = numbered.select(*scene, (F.col("__rn") + 1).alias("__rn"), F.col(view).alias("va"),
                           *[F.col(c).alias(f"{c}a") for c in cols])
    nxt = numbered.select(*scene, "__rn", F.col(view).alias("vb"), *[F.col(c).alias(f"{c}b") for c in cols])
    chain = prev.join(nxt, [*scene, "__rn"]).filter(
        dist3(*[F.col(f"{c}a") for c in cols[3:]], *[F.col(f"{c}b") for c in cols[3:]]) <= CHAIN_METRES)
    ok = compatible({c: F.col(f"{c}a") for c in cols[:3]}, {c: F.col(f"{c}b") for c in cols[:3]})
    edges = measured.select(*scene, "va", "vb", ok.alias("__ok")).unionByName(
        chain.select(*scene, "va", "vb", ok.alias("__ok"))).filter("__ok").select(*scene, "va", "vb")
    return connected_components(edges, group=scene, a="va", b="vb",
                                vertices=views.select(*scene, F.col(view).alias("vertex")))


def vote_first_seen(df: DataFrame, *, keys: list[str], value: str, pos: Column, out: str = "winner") -> DataFrame:
    """Most frequent value, ties to the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"), F.min(pos).alias("__p"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__p"))).alias(out))


def vote_smallest(df: DataFrame, *, keys: list[str], value: str, out: str = "winner") -> DataFrame:
    """Most frequent number, ties to the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col(value))).alias(out))


def vote_strict(df: DataFrame, *, keys: list[str], value: str, out: str = "winner") -> DataFrame:
    """Most frequent value; a tie has no winner."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    by_count = counts.groupBy(*keys, "__n").agg(F.count(F.lit(1)).alias("__ties"), F.min(value).alias("__v"))
    top = by_count.groupBy(*keys).agg(F.max(F.struct("__n", "__ties", "__v")).alias("__t"))
    return top.select(*keys, F.when(F.col("__t.__ties") == 1, F.col("__t.__v")).alias(out))


def observed_levels(poses: DataFrame, *, scene: list[str], pos: Column) -> DataFrame:
    """Storey of every camera along the mean up direction of its scene.

    The reference up vector is that of the first pose; the others are flipped
    to agree with it.  All scene figures are map-side combined aggregates.
    """
    q, p = [F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("px", "py", "pz")]
    finite = F.forall(F.array(*q, *p), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    up = poses.filter(finite).withColumn("__u", F.struct(*[c.alias(n) for c, n in zip(
        rotate_up(*q, axis=(0.0, -1.0, 0.0)), "xyz", strict=True)]))
    first = up.groupBy(*scene).agg(F.min_by("__u", pos).alias("__r"))
    both = join_back(up, first, scene)
    agree = add([F.col(f"__u.{n}") * F.col(f"__r.{n}") for n in "xyz"])
    sign = F.when(agree < 0, -1.0).otherwise(1.0)
    sums = both.groupBy(*scene).agg(*[F.sum(F.col(f"__u.{n}") * sign).alias(f"__s{n}") for n in "xyz"],
                                    F.first("__r").alias("__r"))
    length = F.sqrt(add([F.col(f"__s{n}") * F.col(f"__s{n}") for n in "xyz"]))
    axis = sums.select(*scene, *[F.when(length > 1e-6, F.col(f"__s{n}") / length).otherwise(F.col(f"__r.{n}"))
                                 .alias(f"__a{n}") for n in "xyz"])
    raised = join_back(up.drop("__u"), axis, scene).withColumn(
        "elevation", add([c * F.col(f"__a{n}") for c, n in zip(p, "xyz", strict=True)])).drop("__ax", "__ay", "__az")
    span = raised.groupBy(*scene).agg(F.min("elevation").alias("__lo"), F.max("elevation").alias("__hi"))
    level = F.when(F.col("__hi") - F.col("__lo") >= STOREY_SPLIT_METRES, F.greatest(
        F.lit(0.0), half_up((F.col("elevation") - F.col("__lo")) / STOREY_METRES))).otherwise(0.0)
    return join_back(raised, span, scene).withColumn("level", level.cast("int")).drop("__lo", "__hi")


def centroids(df: DataFrame, *, keys: list[str]) -> DataFrame:
    """Mean of the finite positions; NULL when there is none."""
    ok = add([F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), 0).otherwise(1)
              for c in ("px", "py", "pz")]) == 0
    return df.groupBy(*keys).agg(*[F.avg(F.when(ok, F.col(c))).alias(f"c{c[1]}") for c in ("px", "py", "pz")])


# --- M18 to M21: room graph

def traversal(links: Column) -> Column:
    return (F.when(F.array_contains(links, "stair_up"), "stair_up").when(F.array_contains(links, "stair_down"), "stair_down")
            .when(F.array_contains(links, "door"), "door").otherwise("walk"))


def near_pairs(points: DataFrame, *, keys: list[str], item: str, xyz: tuple[str, str, str], reach: float,
               carry: list[str] = ()) -> DataFrame:
    """Pairs of one group at most ``reach`` apart, through a cell grid."""
    x, y, z = xyz
    left, right = (points.select(*keys, F.col(item).alias(n), *[F.col(c).alias(f"{c}_{n}") for c in (*xyz, *carry)]) for n in "ab")
    d = dist3(F.col(f"{x}_a"), F.col(f"{y}_a"), F.col(f"{z}_a"), F.col(f"{x}_b"), F.col(f"{y}_b"), F.col(f"{z}_b"))
    near = near_rows(left, right, keys=keys, at=[f"{c}_a" for c in xyz], to=[f"{c}_b" for c in xyz], reach=reach)
    return near.filter("a < b").withColumn("distance", d).filter(F.col("distance") <= reach)


def local_room_edges(nodes: DataFrame, *, artifact: list[str], node: str, links: str, confidence: str) -> DataFrame:
    """Nearest-first forest between rooms of one artifact joined by a door, corridor or stair."""
    located = nodes.filter(F.col("px").isNotNull())
    pairs = near_pairs(located, keys=artifact, item=node, xyz=("px", "py", "pz"), reach=ROOM_LINK_METRES,
                       carry=[links, confidence])
    both = F.array_union(f"{links}_a", f"{links}_b")
    pairs = pairs.filter(F.arrays_overlap(both, F.array(*[F.lit(w) for w in LINK_WORDS]))).withColumn(
        "pair_id", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))
    forest = spanning_forest(pairs, group=artifact, a="a", b="b", order=[F.round("distance", 9), F.col("a"), F.col("b")],
                             edge_id="pair_id")
    return forest.select(*artifact, "a", "b", traversal(both).alias("traversal"),
                         F.greatest(F.lit(0.1), F.col("distance")).alias("distance_m"),
                         F.least(F.lit(0.72), F.col(f"{confidence}_a")).alias("confidence_score"))


def bridge_edges(sources: DataFrame, nodes: DataFrame, *, case: str, artifact: str, node: str, source: str,
                 links: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of different artifacts that share source frames: one verified edge per pair, and its citations.

    ``sources`` holds one row per (case, node, source).  A source frame is
    shared by the few batches it bridges, so the join on (case, source) stays
    linear in the number of rows.
    """
    flat = sources.select(case, F.col(node).alias("__n"), F.col(source).alias("source")).distinct() \
        .join(nodes.select(case, F.col(node).alias("__n"), F.col(artifact).alias("__art")), [case, "__n"])
    left = flat.select(case, "source", F.col("__n").alias("a"), F.col("__art").alias("__aa"))
    right = flat.select(case, "source", F.col("__n").alias("b"), F.col("__art").alias("__ab"))
    cited = left.join(right, [case, "source"]).filter("a < b and __aa <> __ab").select(case, "a", "b", "source")
    def end(n):
        return nodes.select(case, F.col(node).alias(n), F.col(links).alias(f"__l{n}"))

    edges = cited.groupBy(case, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    edges = edges.join(end("a"), [case, "a"]).join(end("b"), [case, "b"])
    return edges.select(case, "a", "b", "shared", traversal(F.array_union("__la", "__lb")).alias("traversal"),
                        F.lit(0.1).alias("distance_m"), F.lit(0.82).alias("confidence_score")), cited


def floor_presentation(hint: Column, observed: Column) -> Column:
    """Floor label and level of a node."""
    chain_label, chain_level = None, None
    for name, (label, level) in FLOOR_NAMES.items():
        value = F.lit(level).cast("int")
        chain_label = F.when(hint == name, label) if chain_label is None else chain_label.when(hint == name, label)
        chain_level = F.when(hint == name, value) if chain_level is None else chain_level.when(hint == name, value)
    return F.struct(chain_label.otherwise("Unknown floor").alias("floor_label"), chain_level.otherwise(observed).alias("level"))


def node_kind(room: Column, any_exterior: Column) -> Column:
    return (F.when(room.isin("stair", "corridor", "exterior"), room).when(any_exterior, "exterior").otherwise("room"))


def node_label(room: Column, floor_label: Column) -> Column:
    """M20: 'Living Room · Upper floor'."""
    name = F.when(room == "unknown", "Observed space").otherwise(F.initcap(F.translate(room, "_", " ")))
    shown = F.when(floor_label == "Unknown floor", "Floor not verified").otherwise(floor_label)
    return F.concat(name, F.lit(" · "), shown)


def room_nodes(views: DataFrame, groups: DataFrame, *, scene: list[str], view: str, pos: str) -> DataFrame:
    """One node per observed space with voted room, floor and level, and its centroid."""
    member = views.join(groups.withColumnRenamed("vertex", view), [*scene, view])
    keys = [*scene, "component"]
    known = member.withColumn("__room", F.when(F.col("room") != "unknown", F.col("room"))) \
        .withColumn("__floor", F.when(F.col("floor") != "unknown", F.col("floor")))
    room = vote_first_seen(known, keys=keys, value="__room", pos=F.col(pos), out="room_type")
    floor = vote_first_seen(known, keys=keys, value="__floor", pos=F.col(pos), out="floor_hint")
    level = vote_smallest(known, keys=keys, value="level", out="observed_level")
    facts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("views"),
                                     F.coalesce(F.bool_or(F.col("scene_type") == "exterior"), F.lit(False)).alias("__ext"))
    out = join_back(join_back(join_back(join_back(facts, room, keys), floor, keys), level, keys),
                    centroids(member, keys=keys), keys)
    out = out.withColumn("room_type", F.coalesce("room_type", F.lit("unknown"))) \
        .withColumn("floor_hint", F.coalesce("floor_hint", F.lit("unknown"))) \
        .withColumn("__f", floor_presentation(F.col("floor_hint"), F.col("observed_level")))
    return out.select(*keys, "views", "room_type", F.col("__f.floor_label").alias("floor_label"),
                      F.col("__f.level").alias("level"), node_kind(F.col("room_type"), F.col("__ext")).alias("kind"),
                      node_label(F.col("room_type"), F.col("__f.floor_label")).alias("label"), "cx", "cy", "cz")


def exterior_nodes(cases: DataFrame, *, case: str, has_profile: Column) -> DataFrame:
    """The known exterior location of every case that has a profile."""
    return cases.filter(has_profile).select(
        case, F.lit("Known exterior location").alias("label"), F.lit("exterior").alias("kind"),
        F.lit("Ground floor").alias("floor_label"), F.lit(0).alias("level"))
