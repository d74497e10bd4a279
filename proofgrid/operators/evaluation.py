"""Acceptance metrics of registered datasets against labelled frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.ranking import join_back

# Thresholds that bound a metric from below or above.
AT_LEAST = {"registration_recall": ("recall", "min_recall"), "registration_precision": ("precision", "min_precision"),
            "gaussian_count": ("gaussian_count", "min_gaussians"), "overlap_color_samples": ("color_samples", "min_color_samples"),
            "cross_view_support": ("cross_view_support", "min_cross_view")}
COUNTS = ("gaussian_count", "overlap_color_samples")  # a missing count is zero
AT_MOST = {"point_rmse": ("point_after", "max_point_rmse")}
# check: (requirement, flag or None, before, after)
IMPROVES = {"pose_graph_improved": ("require_pose", None, "pose_before", "pose_after"),
            "point_optimization": ("require_point", "pose_optimized", "point_before", "point_after"),
            "dense_surface_improved": ("require_dense", "dense_optimized", "dense_before", "dense_after"),
            "overlap_color_improved": ("require_color", "color_applied", "color_before", "color_after")}
PRESERVES = {"scale_count_preserved": ("require_scale_count", "scale_before", "scale_after"),
             "source_coverage_count_preserved": ("require_coverage_count", "coverage_before", "coverage_after")}
MAX_ROTATION_DEG = 180.0


def registration_metrics(frames: DataFrame, registered: DataFrame, *, dataset: str, index: str, expected: str) -> DataFrame:
    """Recall and precision; frames without a label are ignored, empty sets give 1."""
    hit = registered.select(dataset, index).distinct().withColumn("__hit", F.lit(True))
    both = frames.join(hit, [dataset, index], "left")
    on = F.col("__hit").isNotNull()
    agg = both.groupBy(dataset).agg(
        F.count_if(F.col(expected)).alias("expected"), F.count_if(F.col(expected) & on).alias("true_positive"),
        F.count_if(~F.col(expected) & on).alias("false_positive"))
    tp, fp = F.col("true_positive"), F.col("false_positive")
    return agg.withColumn("recall", F.when(F.col("expected") > 0, tp / F.col("expected")).otherwise(1.0)) \
        .withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0))


def room_completeness(frames: DataFrame, registered: DataFrame, *, dataset: str, index: str, room: str) -> DataFrame:
    """Share of each room's frames that were registered."""
    hit = registered.select(dataset, index).distinct().withColumn("__hit", F.lit(1))
    return frames.join(hit, [dataset, index], "left").groupBy(dataset, room).agg(
        F.round(F.avg(F.coalesce("__hit", F.lit(0)).cast("double")), 6).alias("completeness"))


def improved(before: Column, after: Column) -> Column:
    """Strictly smaller, and both present."""
    return F.coalesce(after < before, F.lit(False))


def threshold_checks(metrics: DataFrame, *, dataset: str) -> DataFrame:
    """All checks and their conjunction.

    A missing threshold passes, except that rotation agreement fails when the
    metric itself is missing.  ``metrics`` holds metric and threshold columns.
    """
    false = F.lit(False)
    checks: dict[str, Column] = {}
    for name, (m, t) in AT_LEAST.items():
        value = F.coalesce(F.col(m), F.lit(0.0)) if name in COUNTS else F.col(m)
        checks[name] = F.col(t).isNull() | F.coalesce(value >= F.col(t), false)
    for name, (m, t) in AT_MOST.items():
        checks[name] = F.col(t).isNull() | F.coalesce(F.col(m) <= F.col(t), false)
    for name, (need, flag, b, a) in IMPROVES.items():
        ok = improved(F.col(b), F.col(a))
        ok = ok if flag is None else ok & F.coalesce(F.col(flag), false)
        checks[name] = ~F.coalesce(F.col(need), false) | ok
    for name, (need, b, a) in PRESERVES.items():
        checks[name] = ~F.coalesce(F.col(need), false) | (F.col(b).isNotNull() & F.coalesce(F.col(a) == F.col(b), false))
    checks["rotation_agreement"] = F.coalesce(
        F.col("rotation_deg") <= F.coalesce(F.col("max_rotation"), F.lit(MAX_ROTATION_DEG)), false)
    checks["joint_camera_accepted"] = ~F.coalesce(F.col("require_joint"), false) | F.coalesce(F.col("joint_accepted"), false)
    checks["input_hashes"] = F.coalesce(F.col("inputs_verified"), F.lit(True))
    passed = reduce(lambda x, y: x & y, checks.values())
    return metrics.select(dataset, *[c.alias(n) for n, c in checks.items()], passed.alias("passed"))


def finite_number(x: Column) -> Column:
    """The number when finite, else NULL."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nonnegative_integer(x: Column) -> Column:
    """A whole number of at least zero, else NULL."""
    return F.when(finite_number(x).isNotNull() & (x >= 0) & (x == F.floor(x)), F.floor(x).cast("bigint"))


def extract_metrics(df: DataFrame, *, text: str, schema: str, numbers: list[str], counts: list[str]) -> DataFrame:
    """Typed metrics of report texts; anything malformed becomes NULL."""
    parsed = df.withColumn("__m", F.from_json(text, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}))
    return parsed.select(*[c for c in df.columns if c != text],
                         *[finite_number(F.col(f"__m.{c}").cast("double")).alias(c) for c in numbers],
                         *[nonnegative_integer(F.col(f"__m.{c}").cast("double")).alias(c) for c in counts])


def baseline_gain(registered: DataFrame, baselines: DataFrame, *, dataset: str, index: str, baseline: str) -> DataFrame:
    """Registered frames beyond the earlier run, NULL without one."""
    n = registered.groupBy(dataset).agg(F.count_distinct(index).alias("registered"))
    return join_back(n, baselines.select(dataset, baseline), [dataset]).select(
        dataset, "registered", (F.col("registered") - F.col(baseline)).alias("gain"))


def separation(frames: DataFrame, registered: DataFrame, *, dataset: str, index: str, component: str) -> DataFrame:
    """Frames registered from outside the main component; separate when there is none.

    The main component is the one with the most registered frames, ties to the smaller name.
    """
    on = frames.join(registered.select(dataset, index).distinct(), [dataset, index], "left_semi")
    per = on.groupBy(dataset, component).agg(F.count(F.lit(1)).alias("__n"))
    tot = per.groupBy(dataset).agg(F.sum("__n").alias("registered"), F.max("__n").alias("main"))
    return tot.select(dataset, "registered", (F.col("registered") - F.col("main")).alias("foreign"),
                      (F.col("registered") == F.col("main")).alias("separate"))
