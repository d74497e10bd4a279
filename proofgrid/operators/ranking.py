"""Ranking, sampling and exact order statistics that stay distributed under skew.

A window partitioned by one key puts every row of that key in one task.  These
helpers avoid that: top-k relies on the partial group limit below the shuffle,
numbering and order statistics first aggregate per slice of the sort key and
only then touch rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.session import stored


def join_back(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach one-row-per-key ``stats``; NULL keys match each other.

    Skew in ``df`` is left to adaptive skew-join: the stats side has one row
    per key, so splitting the row side is cheap.
    """
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # one row: a global aggregate
    renamed = stats.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in stats.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return df.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row by aggregate + join, not by a window.

    The aggregate combines map-side, so a key with a third of the rows costs
    one partial row per task instead of one task with a third of the rows.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_back(df, stats, keys)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in the given total order.

    Catalyst turns ``row_number() <= k`` into a partial group limit below the
    shuffle, so at most k rows per key and task are exchanged.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key (first wins)."""
    return top_k(df, keys, order, 1, "__first").drop("__first")


def number_rows(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank",
                slice_by: Column | None = None) -> DataFrame:
    """1-based position of every row inside its key.

    ``slice_by`` is any expression that grows with the sort order (a day of a
    timestamp, a floor of a number).  Rows are numbered inside (key, slice) and
    shifted by the row counts of the earlier slices, so a hot key is spread
    over its slices.  Without it a plain window is used, which is right for
    keys of bounded size.
    """
    if slice_by is None:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sliced = df.withColumn("__slice", slice_by)
    offsets = _slice_offsets(sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n")), keys)
    both = join_back(sliced, offsets, [*keys, "__slice"], "inner")
    local = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    return both.withColumn(rank, (local + F.col("__before")).cast("bigint")).drop("__slice", "__before")


def _slice_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "__slice", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str,
                slice_by: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Running sum inside each key, two-level like :func:`number_rows`."""
    end = 0 if inclusive else -1
    frame = (Window.unboundedPreceding, end)
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    sliced = df.withColumn("__slice", slice_by).withColumn("__v", value)
    offsets = _slice_offsets(sliced.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__n")), keys)
    both = join_back(sliced, offsets, [*keys, "__slice"], "inner")
    w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(*frame)
    local = F.coalesce(F.sum("__v").over(w), F.lit(0))
    return both.withColumn(out, local + F.col("__before")).drop("__slice", "__before", "__v")


def _value_reaching(df: DataFrame, keys: list[str], value: str, weight: Column, wanted: list[tuple[str, Column, bool]]) -> DataFrame:
    """(keys..., tag, total, v): the first value at which the cumulative weight reaches what is wanted.

    ``wanted`` lists (tag, expression of ``total``, strict): at least that weight, or more than it.  Values are counted
    map-side into one row per distinct value.  Then the range that holds the answer is cut into ``HISTOGRAM`` equal
    buckets, again and again, with borders taken from the values still in it, until it is one value.  No bucket holds
    all of its range, so every round gets on; rows out of range drop out before anything is shuffled, no key
    is sorted, and a key with very many distinct values is spread over buckets wherever its values lie.  The ends of a
    range stand alone.
    """
    present = [F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)]
    names = [f"__r_{i}" for i in range(len(keys))]
    d = stored(df.filter(F.col(value).isNotNull()).groupBy(*present, F.col(value).alias("v")).agg(F.sum(weight).alias("w")), "values")
    asked = F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), target.cast("double").alias("t"), F.lit(strict).alias("strict"))
                                for tag, target, strict in wanted]))
    open_ = stored(d.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total"))
                   .select(*names, "lo", "hi", "total", F.lit(0.0).alias("below"), asked.alias("a")).select("*", "a.*").drop("a"), "ranges")
    done = None
    while True:
        ended = open_.filter(F.expr("lo <=> hi"))
        done = ended if done is None else done.unionByName(ended)
        rest = open_.filter(F.expr("not (lo <=> hi)"))
        if rest.isEmpty():
            break
        share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        place = F.floor(share * float(HISTOGRAM))
        usable = ~F.isnan(share) & (share >= 0) & (share < 1)
        # Between ends without a finite distance all values share one bucket for a round.
        bucket = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), HISTOGRAM + 1) \
            .when(usable, F.least(place, F.lit(HISTOGRAM - 1)) + 1).otherwise(1).cast("int")
        inside = join_back(d, rest, names, "inner").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        hist = inside.groupBy(*names, "tag", bucket.alias("b")).agg(
            F.sum("w").alias("bw"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.first(c).alias(c) for c in ("total", "below", "t", "strict")])
        upto = F.col("below") + F.sum("bw").over(Window.partitionBy(*names, "tag").orderBy("b"))
        reached = F.when(F.col("strict"), F.col("upto") > F.col("t")).otherwise(F.col("upto") >= F.col("t"))
        # Rounding of floating sums may leave the last bucket a hair short of the total.
        choice = hist.withColumn("upto", upto).groupBy(*names, "tag").agg(F.min_by(
            F.struct("lo", "hi", "total", (F.col("upto") - F.col("bw")).cast("double").alias("below"), "t", "strict"),
            F.struct(F.when(reached, 0).otherwise(1).alias("late"), F.when(reached, F.col("b")).otherwise(-F.col("b")).alias("b"))).alias("c"))
        open_ = stored(choice.select(*names, "tag", "c.*"), "ranges")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "tag", "total", F.col("lo").alias("v"))


HISTOGRAM = 1024  # buckets of a range per round


def exact_quantile(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Exact quantile per key with linear interpolation between neighbours."""
    rank = (F.col("total") - 1) * F.lit(float(p))
    found = _value_reaching(df, keys, value, F.lit(1), [("lo", F.floor(rank), True), ("hi", F.ceil(rank), True)])
    v = F.col("v").cast("double")
    picked = found.groupBy(*keys).agg(F.max(F.when(F.col("tag") == "lo", v)).alias("__lo"), F.max(F.when(F.col("tag") == "hi", v)).alias("__hi"),
                                      F.max(rank - F.floor(rank)).alias("__frac"))
    # Equal neighbours need no difference: infinities have none.
    between = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac"))
    return picked.select(*keys, between.alias(out))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return exact_quantile(df, keys, value, 0.5, out)


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The middle value, taking the upper one of an even count."""
    found = _value_reaching(df, keys, value, F.lit(1), [("m", F.floor(F.col("total") / 2), True)])
    return found.select(*keys, F.col("v").alias(out))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: Column, out: str) -> DataFrame:
    """First value at which the cumulative weight reaches half of the total."""
    found = _value_reaching(df, keys, value, weight, [("m", F.col("total") / 2, False)])
    return found.select(*keys, F.col("v").alias(out))


def even_sample(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "sample_pos",
                slice_by: Column | None = None) -> DataFrame:
    """``k`` evenly spaced rows per key: positions floor(linspace(0, n-1, k)).

    A key with at most ``k`` rows keeps them all.  A row is kept when the ideal
    grid has a point in [pos, pos+1), which needs no grid table and no join.
    """
    numbered = number_rows(df, keys, order, "__rn", slice_by)
    numbered = with_group_stats(numbered, keys, __n=F.count(F.lit(1)))
    pos, n = F.col("__rn") - 1, F.col("__n")
    if k == 1:
        keep, index = pos == 0, F.lit(0)
    else:
        step = (n - 1).cast("double") / F.lit(float(k - 1))
        grid = lambda i: F.when(i >= k - 1, n - 1).otherwise(F.floor(i * step))
        near = F.ceil(pos / step)
        tries = F.filter(F.array(near - 1, near, near + 1),
                         lambda i: (i >= 0) & (i <= k - 1) & (grid(i) == pos))
        keep, index = F.size(tries) > 0, F.get(tries, 0)
    return (
        numbered.withColumn(rank, F.when(n <= k, pos).otherwise(index).cast("bigint"))
        .filter((n <= k) | keep).drop("__rn", "__n")
    )
