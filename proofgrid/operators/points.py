"""Point clouds, cameras and robust statistics over many scenes.

Points are rows with flat numeric columns; a camera is one row with its 4x4
transform as an array.  Camera rows join to points on (scene, frame); a very
large scene is split by adaptive skew-join because its camera rows are few.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.linalg import decompose_sim3, umeyama3
from proofgrid.functions.numeric import (add, clamp, dist3, mat4_mul, mat4_point, quaternion_product,
                                         similarity_inverse, similarity_scale)
from proofgrid.functions.text import let
from proofgrid.operators.cells import near_rows
from proofgrid.session import cut_lineage, stored
from proofgrid.operators.ranking import (even_sample, exact_median, exact_quantile, first_by, join_back, number_rows, top_k,
                                         upper_median, weighted_median, with_group_stats)

# Tolerances, limits and weights of the registration steps.
MIN_DEPTH = 0.01
LIFT_RADIUS = 4
LIFT_CELL_BITS = 4  # depth cells of sixteen pixels
MIN_LIFTED = 12
MANY_MATCHES, INLIERS_MANY, INLIERS_FEW, INLIER_RATIO = 40, 18, 10, 0.25
SCALE_RANGE = (0.5, 2.0)
KEPT_INLIERS = 512
SCORED_AT_ONCE = 32  # transforms against a block of rows
SURFACE_SAMPLES, SURFACE_MATCHES = 30_000, 1_200
MIN_SURFACE_SAMPLES, MIN_SURFACE_MATCHES, MIN_DENSE = 24, 12, 24
NORMAL_AGREEMENT, COLOUR_DISTANCE = 0.6, 0.35
PIXEL_SIGMA, GROWTH_CAP = 0.55, 1.15
NEEDLE_RATIO, TAIL_QUANTILE = 12.0, 0.995
VIEW_TOLERANCE = (0.08, 0.06)
SUPPORT_GATE = 0.30
LUMINANCE = (0.2126, 0.7152, 0.0722)
RIDGE, STRENGTH, GAIN_BOUNDS, MIN_COLOUR_SAMPLES = 0.35, 0.65, (0.90, 1.10), 12
MAX_ROTATION_GAP_DEG, MIN_BASELINE = 18.0, 1e-6
DEEPEST = 26  # levels of a pyramid: more than a double can tell apart
LOOKED_UP = 16  # targets of a cell that are compared one by one


# --- Q01, Q02: projection and lifting

def project(x: Column, y: Column, z: Column, focal: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Pixel (half-even rounding) and whether the point is in front and inside."""
    u, v = F.rint(x / z * focal + width / 2), F.rint(y / z * focal + height / 2)
    ok = (z > MIN_DEPTH) & ~F.isnan(x) & ~F.isnan(y) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return u, v, F.coalesce(ok, F.lit(False))


def depth_buffer(points: DataFrame, *, keys: list[str], focal: str, width: str, height: str, idx: str) -> DataFrame:
    """Q01: the nearest point of every pixel; combines map-side."""
    u, v, ok = project(F.col("x"), F.col("y"), F.col("z"), F.col(focal), F.col(width), F.col(height))
    seen = points.filter(F.col("z") > MIN_DEPTH).withColumn("u", u).withColumn("v", v).filter(ok)
    return seen.groupBy(*keys, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")).agg(
        F.min_by(F.struct("x", "y", "z"), F.struct("z", idx)).alias("p")).select(*keys, "u", "v", "p.x", "p.y", "p.z")


def lift_pixels(pixels: DataFrame, depth: DataFrame, *, keys: list[str], pixel: list[str], px: str, py: str) -> DataFrame:
    """Q02: nearest depth in the smallest square ring (radius 0 to 4) that has any sample."""
    want = pixels.select(*keys, *pixel, F.rint(px).cast("int").alias("__u"), F.rint(py).cast("int").alias("__v"))
    placed = depth
    for c, at in (("u", "__u"), ("v", "__v")):  # a window reaches four cells at most
        low, high = (F.shiftright(F.col(at) + side * LIFT_RADIUS, LIFT_CELL_BITS) for side in (-1, 1))
        want = want.withColumn(f"__c{c}", F.explode(F.sequence(low, high)))
        placed = placed.withColumn(f"__c{c}", F.shiftright(F.col(c).cast("int"), LIFT_CELL_BITS))
    # never broadcast: Spark does not count what an explode adds
    hit = want.hint("merge").join(placed, [*keys, "__cu", "__cv"]).withColumn(
        "__ring", F.greatest(F.abs(F.col("u") - F.col("__u")), F.abs(F.col("v") - F.col("__v")))).filter(F.col("__ring") <= LIFT_RADIUS)
    return hit.groupBy(*keys, *pixel).agg(F.min_by(F.struct("x", "y", "z"), F.struct("__ring", "z", "u", "v")).alias("p")) \
        .select(*keys, *pixel, "p.x", "p.y", "p.z")


# --- Q03 to Q07: similarity transforms

def metric_gate(lifted: Column, inliers: Column, scale: Column, rmse: Column, median_depth: Column) -> Column:
    """Q03: acceptance, confidence and reason of a metric pair."""
    ratio = inliers / lifted
    depth = F.greatest(F.lit(0.08), median_depth * 0.05)
    need = F.when(lifted >= MANY_MATCHES, INLIERS_MANY).otherwise(INLIERS_FEW)
    reason = (F.when(lifted < MIN_LIFTED, "too_few_lifted")
              .when((inliers < need) | (ratio < INLIER_RATIO), "too_few_inliers")
              .when(~scale.between(*SCALE_RANGE), "scale_out_of_range").when(rmse > depth * 1.5, "error_too_high"))
    score = (F.least(F.lit(1.0), inliers / 80.0) * 0.35 + F.least(F.lit(1.0), ratio / 0.65) * 0.45
             + F.greatest(F.lit(0.0), F.lit(1.0) - rmse / (depth * 1.5)) * 0.20)
    return F.struct(reason.isNull().alias("accepted"), F.when(reason.isNull(), score).alias("confidence"), reason.alias("reason"))


def similarity_fits(pairs: DataFrame, *, keys: list[str], out: str = "transform") -> DataFrame:
    """Q05: transform taking (bx, by, bz) to (ax, ay, az) per pair.

    Only seventeen sums per pair leave the map side; the 3x3 solve runs on one
    row per pair.
    """
    s, t = [F.col(c) for c in ("bx", "by", "bz")], [F.col(c) for c in ("ax", "ay", "az")]
    moments = [F.count(F.lit(1)).cast("double"), *[F.sum(c) for c in s], *[F.sum(c) for c in t],
               F.sum(add([c * c for c in s])), *[F.sum(i * j) for i in t for j in s]]
    sums = pairs.groupBy(*keys).agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)])
    return sums.select(*keys, F.col("m0").cast("bigint").alias("n"),
                       umeyama3(F.array(*[F.col(f"m{i}") for i in range(len(moments))])).alias(out))


def with_residuals(pairs: DataFrame, fits: DataFrame, *, keys: list[str], transform: str = "transform") -> DataFrame:
    """Distance of every transformed source point to its target."""
    both = join_back(pairs, fits.select(*keys, transform), keys, "inner")
    x, y, z = mat4_point(F.col(transform), F.col("bx"), F.col("by"), F.col("bz"))
    return both.withColumn("residual", dist3(x, y, z, F.col("ax"), F.col("ay"), F.col("az"))).drop(transform)


def robust_similarity(pairs: DataFrame, *, keys: list[str], order: list[Column], iterations: int = 1200,
                      seed: int = 20260716, block_rows: int = 8192, slice_by: Column | None = None) -> DataFrame:
    """Q04: consensus similarity per pair: best of ``iterations`` seeded triples, refitted on its inliers.

    Triples are drawn by row position from a generator seeded with the pair
    key, so partitioning cannot change them.  Hypotheses are scored on blocks
    of rows and the block scores summed, so a pair of any size is spread.
    """
    rows = number_rows(pairs, keys, order, "__rn", slice_by)
    facts = join_back(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")),
                      exact_median(rows.withColumn("__az", F.col("az")), keys, "__az", "__mz"), keys)
    facts = facts.filter("__n >= 3").withColumn("__limit", F.greatest(F.lit(0.08), F.col("__mz") * 0.05)) \
        .withColumn("__seed", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**31)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(n: pd.Series, s: pd.Series) -> pd.Series:
        def triples(count, start):
            rng = np.random.default_rng(int(start))
            a, b, c = (rng.integers(0, int(count) - i, iterations) for i in range(3))
            b += b >= a  # b and c skip what is drawn already
            c += c >= np.minimum(a, b)
            c += c >= np.maximum(a, b)
            return np.stack([a, b, c], axis=1).ravel() + 1
        return pd.Series([triples(a, b) for a, b in zip(n, s, strict=True)])

    drawn = facts.select(*keys, F.posexplode(draw("__n", "__seed")).alias("__slot", "__rn"))
    corners = drawn.join(rows, [*keys, "__rn"]).withColumn("__h", F.floor(F.col("__slot") / 3).cast("int"))
    # at most ``iterations`` entries per pair; read twice below
    hypotheses = cut_lineage(similarity_fits(corners, keys=[*keys, "__h"]).filter("transform is not null").groupBy(*keys).agg(
        F.collect_list(F.struct("__h", "transform")).alias("__hyps")))
    placed = join_back(rows, facts.select(*keys, "__n", "__limit"), keys, "inner") \
        .withColumn("__blk", F.floor((F.col("__rn") - 1) / block_rows))
    held = join_back(hypotheses, facts.select(*keys, "__n"), keys, "inner").withColumn(
        "__blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / block_rows))))
    key_fields = [pairs.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("h", T.IntegerType()), T.StructField("c", T.LongType()),
                           T.StructField("e", T.DoubleType())])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        src, dst = left[["bx", "by", "bz"]].to_numpy(float), left[["ax", "ay", "az"]].to_numpy(float)
        limit = left["__limit"].iloc[0]
        hyps = right["__hyps"].iloc[0]
        every = np.array([h["transform"] for h in hyps], float).reshape(-1, 4, 4)
        count, error = [], []
        for at in range(0, len(every), SCORED_AT_ONCE):
            m = every[at:at + SCORED_AT_ONCE]
            err = np.linalg.norm(src @ m[:, :3, :3].transpose(0, 2, 1) + m[:, None, :3, 3] - dst, axis=2)
            good = err <= limit
            count.append(good.sum(axis=1))
            error.append(np.where(good, err, 0.0).sum(axis=1))
        res = pd.DataFrame({"h": [h["__h"] for h in hyps], "c": np.concatenate(count), "e": np.concatenate(error)})
        for k in reversed(keys):
            res.insert(0, k, left[k].iloc[0])
        return res

    blocks = placed.groupBy(*keys, "__blk").cogroup(held.select(*keys, "__blk", "__hyps").groupBy(*keys, "__blk")) \
        .applyInPandas(score, schema)
    totals = blocks.groupBy(*keys, "h").agg(F.sum("c").alias("c"), F.sum("e").alias("e")).filter("c >= 3")
    best = first_by(totals, keys, [F.col("c").desc(), F.round(F.col("e") / F.col("c"), 12), F.col("h")])
    chosen = best.join(hypotheses.select(*keys, F.explode("__hyps").alias("__x")), keys).filter("__x.__h = h") \
        .select(*keys, F.col("__x.transform").alias("transform"))
    inliers = with_residuals(placed, chosen, keys=keys).filter(F.col("residual") <= F.col("__limit"))
    inliers = inliers.select(*pairs.columns)
    fits = similarity_fits(inliers, keys=keys)
    rmse = with_residuals(inliers, fits, keys=keys).groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    out = join_back(join_back(fits, rmse, keys), facts.select(*keys, F.col("__n").alias("matches"), F.col("__mz").alias("median_depth")), keys)
    return out.withColumnRenamed("n", "inliers").withColumn("scale", similarity_scale(F.col("transform")))


def kept_inliers(inliers: DataFrame, *, keys: list[str], order: list[Column], limit: int = KEPT_INLIERS,
                 slice_by: Column | None = None) -> DataFrame:
    """Q03: at most 512 evenly spaced inliers per pair."""
    return even_sample(inliers, keys, order, limit, slice_by=slice_by)


def matrix_quaternion(m: Column, scale: Column) -> tuple[Column, Column, Column, Column]:
    """wxyz quaternion of the rotation of a similarity transform."""
    r = [[m[4 * i + j] / scale for j in range(3)] for i in range(3)]
    tr = r[0][0] + r[1][1] + r[2][2]
    cases = [
        (tr > 0, F.sqrt(tr + 1) * 2, lambda s: (s / 4, (r[2][1] - r[1][2]) / s, (r[0][2] - r[2][0]) / s, (r[1][0] - r[0][1]) / s)),
        ((r[0][0] > r[1][1]) & (r[0][0] > r[2][2]), F.sqrt(F.greatest(F.lit(0.0), r[0][0] - r[1][1] - r[2][2] + 1)) * 2,
         lambda s: ((r[2][1] - r[1][2]) / s, s / 4, (r[0][1] + r[1][0]) / s, (r[0][2] + r[2][0]) / s)),
        (r[1][1] > r[2][2], F.sqrt(F.greatest(F.lit(0.0), r[1][1] - r[0][0] - r[2][2] + 1)) * 2,
         lambda s: ((r[0][2] - r[2][0]) / s, (r[0][1] + r[1][0]) / s, s / 4, (r[1][2] + r[2][1]) / s)),
        (F.lit(True), F.sqrt(F.greatest(F.lit(0.0), r[2][2] - r[0][0] - r[1][1] + 1)) * 2,
         lambda s: ((r[1][0] - r[0][1]) / s, (r[0][2] + r[2][0]) / s, (r[1][2] + r[2][1]) / s, s / 4)),
    ]
    out = []
    for i in range(4):
        chain = None
        for cond, s, parts in cases:
            value = parts(s)[i]
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        out.append(chain)
    return tuple(out)


def transform_points(points: DataFrame, cameras: DataFrame, *, keys: list[str], transform: str) -> DataFrame:
    """Q06: positions, log-scales and rotations in the shared frame.

    The rotation quaternion is worked out once per camera, not per point.
    """
    m = F.col(transform)
    scale = similarity_scale(m)
    q = matrix_quaternion(m, F.greatest(scale, F.lit(1e-8)))
    cams = cameras.select(*keys, m.alias("__m"), F.log(F.greatest(scale, F.lit(1e-8))).alias("__ls"),
                          *[c.alias(f"__q{i}") for i, c in enumerate(q)])
    both = points.join(cams, keys)
    x, y, z = mat4_point(F.col("__m"), *[F.col(c).cast("double") for c in "xyz"])
    turned = quaternion_product(tuple(F.col(f"__q{i}") for i in range(4)), tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    new = {"x": x, "y": y, "z": z, **{c: F.col(c) + F.col("__ls") for c in ("s0", "s1", "s2")},
           **dict(zip(("qw", "qx", "qy", "qz"), turned, strict=True))}
    return both.select(*[new[c].cast(points.schema[c].dataType).alias(c) if c in new else F.col(c) for c in points.columns])


def decompose(df: DataFrame, transform: str) -> DataFrame:
    """Q07: scale, rotation vector and translation columns of each transform."""
    out = df.withColumn("__d", decompose_sim3(transform))
    names = ("scale", "rx", "ry", "rz", "tx", "ty", "tz")
    return out.select("*", *[F.col("__d")[i].alias(n) for i, n in enumerate(names)]).drop("__d")


def clipped_scale(log_scale: Column) -> Column:
    """Q07: scale of a parameter vector, its logarithm bounded by two."""
    return F.exp(clamp(log_scale, -2.0, 2.0))


# --- Q09 to Q11: surfaces

def surface_samples(points: DataFrame, *, keys: list[str], order: list[Column], limit: int = SURFACE_SAMPLES,
                    slice_by: Column | None = None) -> DataFrame:
    """Q09: at most 30 000 evenly spaced usable points per frame, with their thin-axis normal."""
    values = [F.col(c) for c in ("x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "r", "g", "b")]
    usable = points.filter(F.forall(F.array(*[v.cast("double") for v in values]),
                                    lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.col("z") > 0.02))
    picked = even_sample(usable, keys, order, limit, slice_by=slice_by)
    qw, qx, qy, qz = (F.col(c).cast("double") for c in ("qw", "qx", "qy", "qz"))
    axes = [
        (1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy + qw * qz), 2 * (qx * qz - qw * qy)),
        (2 * (qx * qy - qw * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz + qw * qx)),
        (2 * (qx * qz + qw * qy), 2 * (qy * qz - qw * qx), 1 - 2 * (qx * qx + qy * qy)),
    ]
    thin0 = (F.col("s0") <= F.col("s1")) & (F.col("s0") <= F.col("s2"))
    thin1 = F.col("s1") <= F.col("s2")
    return picked.select("*", *[F.when(thin0, axes[0][i]).when(thin1, axes[1][i]).otherwise(axes[2][i]).alias(n)
                                for i, n in enumerate(("nx", "ny", "nz"))])


def reciprocal_matches(a: DataFrame, b: DataFrame, *, keys: list[str], idx: str, limit: Column | float,
                       cell: float, max_matches: int = SURFACE_MATCHES) -> DataFrame:
    """Q09: mutual nearest surface points within a limit that agree in normal and colour.

    Nearest neighbours are looked for within ``cell``: a match beyond it would
    exceed the limit and be rejected anyway, so this is
    exact.  ``limit`` must not be above ``cell``.  Normal and colour gates come
    after the neighbours are fixed; one match per voxel, nearest first, at most
    1 200 per pair, and none for a pair with fewer than twelve.
    """
    cols = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b"]
    left, right = (df.select(*keys, F.col(idx).alias(f"i{tag}"), *[F.col(c).cast("double").alias(f"{c}{tag}") for c in cols])
                   for df, tag in ((a, "1"), (b, "2")))
    pairs = near_rows(left, right, keys=keys, at=["x1", "y1", "z1"], to=["x2", "y2", "z2"], reach=cell)
    pairs = pairs.withColumn("distance", dist3(F.col("x1"), F.col("y1"), F.col("z1"), F.col("x2"), F.col("y2"), F.col("z2")))
    pairs = stored(pairs.filter(F.col("distance") <= (limit if isinstance(limit, Column) else F.lit(limit))), "pairs")  # read twice
    near_b = first_by(pairs, [*keys, "i1"], [F.col("distance"), F.col("i2")])
    near_a = first_by(pairs.select(*keys, "i1", "i2", "distance"), [*keys, "i2"], [F.col("distance"), F.col("i1")])
    mutual = near_b.join(near_a.select(*keys, "i1", "i2"), [*keys, "i1", "i2"])
    facing = F.abs(add([F.col(f"{n}1") * F.col(f"{n}2") for n in ("nx", "ny", "nz")])) >= NORMAL_AGREEMENT
    alike = dist3(F.col("r1"), F.col("g1"), F.col("b1"), F.col("r2"), F.col("g2"), F.col("b2")) <= COLOUR_DISTANCE
    voxel = F.greatest(F.lit(0.025), (limit if isinstance(limit, Column) else F.lit(limit)) * 0.6)
    kept = mutual.filter(facing & alike).select(
        *keys, "i1", "i2", "distance", *[F.floor((F.col(f"{c}1") + F.col(f"{c}2")) * 0.5 / voxel).alias(f"__v{c}") for c in "xyz"])
    spread = first_by(kept, [*keys, "__vx", "__vy", "__vz"], [F.col("distance"), F.col("i1")])
    chosen = top_k(spread, keys, [F.col("distance"), F.col("i1")], max_matches, "match_rank")
    enough = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")).filter(F.col("__m") >= MIN_SURFACE_MATCHES)
    return chosen.join(enough.select(*keys), keys, "left_semi").select(*keys, "i1", "i2", "distance", "match_rank")


def surface_limit(rmse: Column) -> Column:
    """Q09: search limit of a pair from its registration error."""
    return clamp(F.greatest(F.lit(0.035), rmse * 2.5), 0.035, 0.1)


def point_rmse(df: DataFrame, *, keys: list[str]) -> DataFrame:
    """Q10: root mean squared 3D distance between a and b points; NULL when empty."""
    d = dist3(*[F.col(c) for c in ("ax", "ay", "az", "bx", "by", "bz")])
    return df.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def accept_dense(df: DataFrame, *, dense: tuple[str, str], sparse: tuple[str, str], moved_m: str, turned_deg: str,
                 constraints: str, optimised: str) -> DataFrame:
    """Q11: whether a dense refinement may replace the initial poses."""
    d0, d1, s0, s1 = (F.col(c) for c in (*dense, *sparse))
    ok = (
        (F.col(constraints) >= MIN_DENSE) & F.col(optimised) & d0.isNotNull() & d1.isNotNull() & (d1 <= d0 + 1e-8)
        & (s0.isNull() | F.coalesce(s1 <= s0 + F.greatest(F.lit(0.001), F.coalesce(s0, F.lit(0.0)) * 0.02), F.lit(False)))
        & (F.col(moved_m) <= 0.15) & (F.col(turned_deg) <= 3.0))
    return df.withColumn("accepted", F.coalesce(ok, F.lit(False)))


# --- Q12 to Q17: clean-up and merge

def _sorted_axes() -> Column:
    axes = F.array(*[F.struct(F.exp(clamp(F.col(c).cast("double"), -20.0, 20.0)).alias("v"), F.lit(i).alias("i"))
                     for i, c in enumerate(("s0", "s1", "s2"))])
    return F.array_sort(axes)


def _put_axes(points: DataFrame, changed: dict[int, Column], affected: Column) -> DataFrame:
    """New log-scales where affected; ``changed`` maps sorted position to the linear value."""
    cols = {}
    for i, c in enumerate(("s0", "s1", "s2")):
        value = F.col(c).cast("double")
        for pos, linear in changed.items():
            value = F.when(affected & (F.col("__ax")[pos]["i"] == i), F.log(F.greatest(linear, F.lit(1e-8)))).otherwise(value)
        cols[c] = value.cast(points.schema[c].dataType).alias(c)
    return points.select(*[cols.get(c, F.col(c)) for c in points.columns if c != "__ax"], affected.alias("affected"))


def grow_footprints(points: DataFrame, cameras: DataFrame, *, keys: list[str], depth: str, scale: str, focal: str,
                    pixels: str) -> DataFrame:
    """Q12: the two broad axes grow to the source footprint, by 15 percent at most.

    The thin axis and the row count stay.  ``pixels`` is the image area; the
    pitch compares it with the number of points of the frame.
    """
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cams = join_back(cameras.select(*keys, scale, focal, pixels), counts, keys)
    both = points.join(cams, keys).withColumn("__ax", _sorted_axes())
    pitch = F.sqrt(F.col(pixels) / F.greatest(F.lit(1), F.col("__n")))
    want = F.greatest(F.col(depth), F.lit(0.0)) * F.col(scale) / F.greatest(F.col(focal), F.lit(1e-6)) * pitch * PIXEL_SIGMA
    valid = want.isNotNull() & ~F.isnan(want) & (want > 0)
    def target(pos):
        now = F.col("__ax")[pos]["v"]
        return F.when(valid, F.least(F.greatest(now, want), now * GROWTH_CAP)).otherwise(now)

    growth = F.greatest(*[target(p) / F.greatest(F.col("__ax")[p]["v"], F.lit(1e-8)) for p in (1, 2)])
    out = _put_axes(both, {1: target(1), 2: target(2)}, growth > 1.00001)
    return out.drop("__n", scale, focal, pixels)


def cross_view_votes(points: DataFrame, cameras: DataFrame, depth: DataFrame, *, scene: str, frame: str, idx: str,
                     transform: str, focal: str, width: str, height: str) -> DataFrame:
    """Q13: per point how many other views observe, support or contradict it, and whether it goes.

    Every point meets the other cameras of its scene, a dozen at most, and then
    one pixel of each by an equi-join with the depth buffer.
    """
    cams = cameras.select(scene, F.col(frame).alias("__tf"), similarity_inverse(F.col(transform)).alias("__inv"),
                          F.col(focal).alias("__f"), F.col(width).alias("__w"), F.col(height).alias("__h"))
    needed = cameras.groupBy(scene).agg(
        F.least(F.lit(2), F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("__need"))
    pairs = points.select(scene, frame, idx, "x", "y", "z").join(cams, scene).filter(F.col(frame) != F.col("__tf"))
    tx, ty, tz = mat4_point(F.col("__inv"), *[F.col(c).cast("double") for c in "xyz"])
    # placed by a generator: the optimizer would copy the products into every test on them, too much code to be compiled
    place = F.inline(F.array(F.struct(tx.alias("__x"), ty.alias("__y"), tz.alias("__z"))))
    pairs = pairs.select(scene, frame, idx, "__tf", "__f", "__w", "__h", place)
    pairs = pairs.filter(F.col("__z") > MIN_DEPTH)
    u, v, ok = project(F.col("__x"), F.col("__y"), F.col("__z"), F.col("__f"), F.col("__w"), F.col("__h"))
    aimed = pairs.withColumn("u", u).withColumn("v", v).filter(ok) \
        .select(scene, frame, idx, F.col("__tf"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "__z")
    buffer = depth.select(scene, F.col(frame).alias("__tf"), "u", "v", F.col("z").cast("double").alias("__ref"))
    seen = aimed.join(buffer, [scene, "__tf", "u", "v"])
    tol = F.greatest(F.lit(VIEW_TOLERANCE[0]), F.col("__ref") * VIEW_TOLERANCE[1])
    # every point adds an empty row, so unseen ones come out of the same aggregate
    cols = [scene, frame, idx, "__z", "__ref"]
    empty = points.select(scene, frame, idx, F.lit(None).cast("double").alias("__z"), F.lit(None).cast("double").alias("__ref"))
    out = seen.select(*cols).unionByName(empty).groupBy(scene, frame, idx).agg(
        F.count("__ref").alias("observed"), F.count_if(F.abs(F.col("__z") - F.col("__ref")) <= tol).alias("supported"),
        F.count_if(F.col("__z") < F.col("__ref") - tol).alias("contradicted"))
    return join_back(out, needed, [scene]).withColumn("removed", (
        (F.col("observed") >= F.col("__need")) & (F.col("supported") == 0)
        & (F.col("contradicted") == F.col("observed")))).withColumnRenamed("__need", "required")


def drop_removed(points: DataFrame, votes: DataFrame, *, keys: list[str]) -> DataFrame:
    """Q13, Q17: points that no vote removes."""
    return points.join(votes.filter("removed").select(*keys), keys, "left_anti")


def cleanup_report(votes: DataFrame, *, scene: str) -> DataFrame:
    return votes.groupBy(scene).agg(
        F.count(F.lit(1)).alias("points"), F.count_if("removed").alias("removed"),
        F.count_if(F.col("supported") >= 1).alias("supported"),
        (F.count_if(F.col("supported") >= 1) / F.count(F.lit(1))).alias("supported_fraction"))


def clamp_needles(points: DataFrame, *, keys: list[str]) -> DataFrame:
    """Q14: a single abnormally long axis shrinks to twelve times the second one.

    Both conditions must hold: ratio above twelve, and the axis in the exact
    top half percent of its frame.
    """
    shaped = points.withColumn("__ax", _sorted_axes()).withColumn("__big", F.col("__ax")[2]["v"])
    tails = exact_quantile(shaped, keys, "__big", TAIL_QUANTILE, "__tail")
    both = join_back(shaped, tails, keys)
    second = F.col("__ax")[1]["v"]
    hit = (F.col("__big") / F.greatest(second, F.lit(1e-8)) > NEEDLE_RATIO) & (F.col("__big") >= F.col("__tail"))
    return _put_axes(both, {2: F.least(F.col("__big"), second * NEEDLE_RATIO)}, hit).drop("__big", "__tail")


def colour_gains(samples: DataFrame, edges: DataFrame, *, scene: str, a: str, b: str, confidence: str) -> DataFrame:
    """Q15: bounded RGB gain per frame from overlap samples of verified pairs.

    ``samples`` has (scene, a, b, r1, g1, b1, r2, g2, b2) in 0..1.  Medians per
    pair and channel are exact and distributed; one small ridge system per
    scene is solved from one row per pair.
    """
    def lum(n):
        return add([F.col(f"{c}{n}") * w for c, w in zip("rgb", LUMINANCE, strict=True)])

    clear = reduce(lambda x, y: x & y, [(lum(n) > 0.08) & (lum(n) < 0.94) for n in (1, 2)])
    inside = F.forall(F.array(*[F.col(f"{c}{n}") for c in "rgb" for n in (1, 2)]), lambda v: (v > 0.025) & (v < 0.98))
    keys = [scene, a, b]
    good = samples.filter(clear & inside)
    ratios = good.select(*keys, *[(F.log(F.greatest(F.col(f"{c}1"), F.lit(1e-4))) - F.log(F.greatest(F.col(f"{c}2"), F.lit(1e-4))))
                                  .alias(f"l{c}") for c in "rgb"])
    facts = ratios.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= MIN_COLOUR_SAMPLES)
    channels = ratios.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("__ch"), F.col(f"l{c}").alias("__l")) for c in "rgb"])))
    mids = exact_median(channels, [*keys, "__ch"], "__l", "__m").groupBy(*keys).agg(
        *[F.max(F.when(F.col("__ch") == c, F.col("__m"))).alias(f"m{c}") for c in "rgb"])
    facts = join_back(facts, mids, keys)
    pairs = facts.join(edges.select(*keys, F.col(confidence).cast("double").alias("__c")), keys)
    ftype = edges.schema[a].dataType
    schema = T.StructType([edges.schema[scene], T.StructField("frame", ftype), *[T.StructField(f"gain_{c}", T.DoubleType()) for c in "rgb"],
                           T.StructField("anchor", T.BooleanType()), T.StructField("before", T.DoubleType()), T.StructField("after", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf[a]) | set(pdf[b]))
        degree = dict.fromkeys(nodes, 0.0)
        for x, y, c, n in zip(pdf[a], pdf[b], pdf["__c"], pdf["samples"], strict=True):
            degree[x] += c * n
            degree[y] += c * n
        anchor = min(nodes, key=lambda k: (-degree[k], k))
        free = [k for k in nodes if k != anchor]
        col = {k: i for i, k in enumerate(free)}
        w = np.sqrt(np.maximum(0.05, pdf["__c"]) * np.minimum(1.0, pdf["samples"] / 100.0)).to_numpy()
        system = np.zeros((len(pdf), len(free)))
        for i, (x, y) in enumerate(zip(pdf[a], pdf[b], strict=True)):
            if x in col:
                system[i, col[x]] -= 1
            if y in col:
                system[i, col[y]] += 1
        system *= w[:, None]
        target = pdf[["mr", "mg", "mb"]].to_numpy(float) * w[:, None]
        logs = np.linalg.solve(system.T @ system + RIDGE * np.eye(len(free)), system.T @ target)
        gains = np.clip(np.exp(STRENGTH * logs), *GAIN_BOUNDS)
        before = math.sqrt(float((target**2).mean()))
        after = math.sqrt(float(((system @ np.log(gains) - target) ** 2).mean()))
        rows = [(pdf[scene].iloc[0], anchor, 1.0, 1.0, 1.0, True, before, after)]
        rows += [(pdf[scene].iloc[0], k, *gains[col[k]], False, before, after) for k in free]
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return pairs.groupBy(scene).applyInPandas(solve, schema)


def apply_gains(points: DataFrame, gains: DataFrame, *, scene: str, frame: str) -> DataFrame:
    """Q15: colours times the gain of their frame, clipped to 0..1."""
    g = gains.select(scene, F.col("frame").alias(frame), "gain_r", "gain_g", "gain_b")
    both = points.join(g, [scene, frame], "left")
    for c in "rgb":
        both = both.withColumn(c, clamp(F.col(c) * F.coalesce(f"gain_{c}", F.lit(1.0)), 0.0, 1.0))
    return both.drop("gain_r", "gain_g", "gain_b")


def scene_gate(support: Column, dense: Column) -> Column:
    """Q16: enough cross-view support or enough dense constraints."""
    return (F.coalesce(support, F.lit(0.0)) >= SUPPORT_GATE) | (F.coalesce(dense, F.lit(0)) >= MIN_DENSE)


def merge_clouds(clouds: list[DataFrame], *, scene: str, sh: str | None = None) -> DataFrame:
    """Q17: clouds appended; spherical harmonics stay only where every part of a scene has them."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    if sh is None:
        return out
    stats = with_group_stats(out, [scene], __all=F.bool_and(F.col(sh).isNotNull()))
    return stats.withColumn(sh, F.when(F.col("__all"), F.col(sh))).drop("__all")


# --- Q18 to Q24: reports

def pose_report(cameras: DataFrame, metric: DataFrame, *, keys: list[str], transform: str) -> DataFrame:
    """Q18: rounded pose of each camera and how it was placed."""
    m = F.col(transform)
    scale = similarity_scale(m)
    q = matrix_quaternion(m, F.greatest(scale, F.lit(1e-8)))
    flagged = cameras.join(metric.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    return flagged.select(
        *keys, *[F.bround(m[4 * i + 3], 7).alias(n) for i, n in enumerate(("px", "py", "pz"))],
        *[F.bround(c, 7).alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)], F.bround(scale, 7).alias("scale"),
        F.when(F.col("__hit"), "measured_feature_and_sharp_metric").otherwise("joint_camera_calibrated_by_metric_core").alias("placement"))


def rotation_gap_deg(a: Column, b: Column) -> Column:
    """Angle between the rotations of two similarity transforms."""
    def gap(p):
        trace = add([p["a"][4 * i + j] * p["b"][4 * i + j] for i in range(3) for j in range(3)])
        return F.degrees(F.acos(clamp((trace / p["s"] - 1) / 2, -1.0, 1.0)))

    def scaled(p):
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), (similarity_scale(p["a"]) * similarity_scale(p["b"])).alias("s"))

    return let(let(F.struct(a.alias("a"), b.alias("b")), scaled), gap)


def calibrate_cameras(cameras: DataFrame, constraints: DataFrame, anchors: DataFrame, *, scene: list[str], frame: str) -> DataFrame:
    """Q19: shared-camera estimates scaled by verified metric pairs, relative to the anchor.

    ``cameras``: camera_to_world, depth_confidence.  ``constraints``: a, b,
    transform (b to a), confidence.  Scenes without an agreeing pair drop out.
    """
    def side(n):
        return cameras.select(*scene, F.col(frame).alias(n), F.col("camera_to_world").alias(f"__m{n}"))

    pairs = constraints.join(side("a"), [*scene, "a"]).join(side("b"), [*scene, "b"])
    pairs = pairs.withColumn("__rel", mat4_mul(similarity_inverse(F.col("__ma")), F.col("__mb")))
    def base(m):
        return let(m, lambda v: F.sqrt(add([v[i] * v[i] for i in (3, 7, 11)])))

    pairs = pairs.withColumn("__gap", rotation_gap_deg(F.col("transform"), F.col("__rel"))) \
        .withColumn("__joint", base(F.col("__rel"))).withColumn("__metric", base(F.col("transform")))
    usable = pairs.filter((F.col("__gap") <= MAX_ROTATION_GAP_DEG) & (F.col("__joint") > MIN_BASELINE) & (F.col("__metric") > MIN_BASELINE)) \
        .withColumn("__factor", F.col("__metric") / F.col("__joint"))
    scales = weighted_median(usable, scene, "__factor", F.greatest(F.lit(0.05), F.col("confidence")), "metric_scale")
    gaps = exact_median(usable, scene, "__gap", "rotation_median_deg")
    raw = cameras.withColumn("__raw", F.greatest(F.lit(0.0), F.coalesce("depth_confidence", F.lit(0.0))))
    mids = exact_median(raw, scene, "__raw", "__mid")
    facts = join_back(join_back(scales, gaps, scene), mids, scene)
    root = anchors.select(*scene, F.col("anchor")).join(side("anchor"), [*scene, "anchor"])
    both = raw.join(facts, scene).join(root, scene)
    rel = mat4_mul(similarity_inverse(F.col("__manchor")), F.col("camera_to_world"))
    moved = let(rel, lambda r: F.array(*[r[i] * F.col("metric_scale") if i in (3, 7, 11) else r[i] for i in range(16)]))
    score = clamp(F.lit(0.55) + F.col("__raw") / F.greatest(F.col("__mid"), F.lit(1e-6)) * 0.12, 0.58, 0.78)
    return both.select(*scene, frame, moved.alias("transform"), "metric_scale", "rotation_median_deg",
                       F.when(F.col(frame) == F.col("anchor"), 1.0).otherwise(score).alias("confidence_score"))


def nearest_distance(queries: DataFrame, targets: DataFrame, *, keys: list[str], query: str, target: str,
                     out: str, others_only: bool = False) -> DataFrame:
    """Exact distance to the nearest target of the same group, without pairing a group with itself.

    All queries go down a pyramid of cells together, each level four times finer.  A cell is known by the box around its
    targets: a query keeps the cells whose box may be nearer than the far side of its best one.  A box that is one point
    is settled whatever its number of targets, cells of few targets are looked up, so neither dense nor repeated
    positions make a query meet more than a few rows a level.  Queries of groups without any (other) target drop out, and
    so do positions that are not finite.
    """
    xyz, axes = ("px", "py", "pz"), range(3)

    def finite(df):
        return df.filter(reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in xyz]))

    queries, targets = finite(queries), finite(targets)
    named = [f"__{c}" for c in xyz]
    pool = targets.select(*keys, F.col(target).alias("__t"), *[F.col(c).cast("double").alias(n) for c, n in zip(xyz, named)])
    frame = pool.groupBy(*keys).agg(*[F.min(n).alias(f"__o{i}") for i, n in enumerate(named)],
                                    F.greatest(*[F.max(n) - F.min(n) for n in named]).alias("__w"))
    shares = [F.when(F.col("__w") > 0, F.least((F.col(n) - F.col(f"__o{i}")) / F.col("__w"), F.lit(1 - 2.0**-53))).otherwise(0.0)
              for i, n in enumerate(named)]
    pool = stored(join_back(pool, frame, keys, "inner").select(*keys, "__t", *named, *[c.alias(f"__s{i}") for i, c in enumerate(shares)]), "pool")
    at, above = [f"__c{i}" for i in axes], [f"__p{i}" for i in axes]
    q = [F.col(c) for c in xyz]
    number = queries.select(*keys, query, *xyz).distinct().withColumn("__q", F.monotonically_increasing_id())
    left = stored(number.withColumn("__best", F.lit(float("inf"))).select("*", *[F.lit(0).cast("bigint").alias(p) for p in above]), "queries")
    level, done = 0, []
    while not left.isEmpty():
        level += 1
        cell = [F.floor(F.col(f"__s{i}") * float(4**level)).cast("bigint").alias(c) for i, c in enumerate(at)]
        cells = pool.select(*keys, "__t", *named, *cell).groupBy(*keys, *at).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__t0"), F.max("__t").alias("__t1"),
            *[F.min(n).alias(f"__l{i}") for i, n in enumerate(named)], *[F.max(n).alias(f"__h{i}") for i, n in enumerate(named)]) \
            .select("*", *[F.shiftright(c, 2).alias(p) for c, p in zip(at, above)])
        aimed = left.join(cells, [*keys, *above]).drop(*above)
        if others_only:
            aimed = aimed.filter((F.col(query) != F.col("__t0")) | (F.col(query) != F.col("__t1")))
        gaps = [(F.col(f"__l{i}") - c, c - F.col(f"__h{i}")) for i, c in enumerate(q)]
        near = F.sqrt(add([let(F.greatest(a, b, F.lit(0.0)), lambda v: v * v) for a, b in gaps]))
        far = F.sqrt(add([let(F.greatest(F.abs(a), F.abs(b)), lambda v: v * v) for a, b in gaps]))
        aimed = aimed.withColumn("__near", near).withColumn("__far", far)
        best = F.least("__best", F.min("__far").over(Window.partitionBy("__q")))
        kept = stored(aimed.withColumn("__best", best).filter(F.col("__near") <= F.col("__best") * (1 + 1e-12)), "aimed")
        point = reduce(lambda a, b: a & b, [F.col(f"__l{i}") == F.col(f"__h{i}") for i in axes])
        few = (F.col("__n") <= LOOKED_UP) | F.lit(level >= DEEPEST)
        done.append(kept.filter(point).select(*keys, query, F.col("__near").alias(out)))
        rows = kept.filter(~point & few).select(*keys, query, *xyz, *at).join(pool.select(*keys, "__t", *named, *cell), [*keys, *at])
        if others_only:
            rows = rows.filter(F.col(query) != F.col("__t"))
        done.append(rows.select(*keys, query, dist3(*q, *[F.col(n) for n in named]).alias(out)))
        left = kept.filter(~point & ~few).select(*keys, query, *xyz, "__q", "__best", *[F.col(c).alias(p) for c, p in zip(at, above)])
    if not done:
        return left.select(*keys, query, F.lit(0.0).alias(out))
    return reduce(DataFrame.unionByName, done).groupBy(*keys, query).agg(F.min(out).alias(out))


def capture_envelope(cameras: DataFrame, queries: DataFrame, *, scene: str, camera: str, query: str) -> DataFrame:
    """Q22: whether a position lies outside the captured region of its scene.

    Radius is three times the upper median of nearest-camera spacing, at least
    two metres.  A scene needs two cameras.
    """
    spacing = nearest_distance(cameras, cameras, keys=[scene], query=camera, target=camera, out="spacing", others_only=True)
    mids = upper_median(spacing, [scene], "spacing", "__mid")
    radius = mids.select(scene, F.greatest(F.lit(2.0), F.col("__mid") * 3).alias("measured_radius"))
    near = nearest_distance(queries.join(radius.select(scene), scene, "left_semi"), cameras, keys=[scene], query=query,
                            target=camera, out="nearest_distance")
    return near.join(radius, scene).withColumn("outside", F.col("nearest_distance") > F.col("measured_radius"))


def scene_summary(frames: DataFrame, tree: DataFrame, points: DataFrame, *, scene: str) -> DataFrame:
    """Q24: status, counts and mean tree confidence of every scene.

    ``frames`` has (scene, frame, placed).  Two placed frames are the minimum;
    half the set, at least two, is representative.
    """
    f = frames.groupBy(scene).agg(F.count(F.lit(1)).alias("frames"), F.count_if("placed").alias("connected"))
    e = tree.groupBy(scene).agg(F.avg("confidence").alias("mean_tree_confidence"), F.count(F.lit(1)).alias("tree_edges"))
    p = points.groupBy(scene).agg(F.count(F.lit(1)).alias("points"))
    out = join_back(join_back(f, e, [scene]), p, [scene])
    n, k = F.col("frames"), F.col("connected")
    return out.withColumn("status", F.when(k < 2, "failed").when(k < n, "partial").otherwise("connected")) \
        .withColumn("representative", k >= F.greatest(F.lit(2), F.ceil(n / 2))) \
        .withColumn("points", F.coalesce("points", F.lit(0).cast("bigint")))
