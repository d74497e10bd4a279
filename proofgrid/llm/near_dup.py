"""MinHash near-duplicates from bottom-k sketches of one hash function (operator 8).

Every text becomes the set of its hashed word shingles; the ``k`` smallest
hashes of the set are its sketch.  Four steps, all linear in the input:

1. *Screen.*  A narrow sketch per distinct set.  A set whose retained values
   occur nowhere else often enough cannot have a partner and goes no further.
2. *Inverted lists.*  The sets that are left get a wide sketch, which is the
   whole set unless the text is long.  Values are ordered from rare to
   frequent, and only the prefix that any sufficiently similar pair must share
   enters the inverted lists.
3. *Hubs.*  Each set is compared with one hub: the member of one of its lists
   with the fewest values of its own.  Most groups of near copies are joined
   by their hub with one comparison per member, never by all pairs.
4. *Rest.*  Pairs that share a list, can still reach the threshold by size and
   position, and are not yet in one component are compared too, so no link
   that changes a component is lost.

A comparison first estimates the similarity from the sketch of the union and
then confirms it on the full sets.  The least count of retained values that an
estimate asks for is read from the binomial tail: a link at the very threshold
falls below it with a probability of at most ``MISS`` (one in 10^12) in each of
the screen, the lists and the comparison.  Inverted lists of sets up to the
wide sketch's size are exact.  Sets and shingles are named by 64-bit hashes.

Defined results: a null or blank text has an empty set and no link; a row with
a null id gets the size of its set, a null component and ``kept`` true; rows
that repeat an id each get their own component.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import long_lists, map_arrow, stored
from proofgrid.operators.graph import components_by_rounds

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MISS = 1e-12  # bound of the probability that one estimate hides a link
MAP_BITS = 1 << 23  # of the bitmap of candidate ids: 1 MB, sent to every task


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ hashed[i:len(words) - span + 1 + i]) * np.uint64(MULTIPLIERS[i % 3])
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def set_name(values: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63 if len(values) else None


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, node, sketch): size and name of the shingle set, and its ``k`` smallest hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(set_name, sets), pa.int64()),
             long_lists([s[:k] for s in sets])], names=["id", "n", "node", "sketch"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), sign,
                     f"id {kind}, n bigint, node bigint, sketch array<bigint>")


@lru_cache
def _lenient(t: float, k: int) -> float:
    """The largest share s/k with P(fewer than s of k retained values are shared) <= MISS at similarity ``t``.

    Retained values are drawn without replacement, whose tail is not above the binomial one.
    """
    tail = 0.0
    for s in range(k + 1):
        tail += math.exp(math.lgamma(k + 1) - math.lgamma(s + 1) - math.lgamma(k - s + 1)
                         + s * math.log(t) + (k - s) * math.log1p(-t)) if 0 < t < 1 else float(t == 0 or s == k)
        if tail > MISS:
            return s / k
    return t


def _least_shared(size: Column, n: Column, t: float, k: int) -> Column:
    """How many of its ``size`` retained values a set of ``n`` shares with any similar set."""
    return F.ceil(F.when(n <= t * k, F.lit(t)).otherwise(F.lit(_lenient(t, k))) * size - 1e-6)


def _suspects(sig: DataFrame, t: float, k: int) -> DataFrame:
    """Step 1: (node, rep) of the sets that may have a partner."""
    nodes = sig.filter("node is not null and id is not null").groupBy("node").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    alone = nodes.select("node", F.explode("sketch").alias("v")).groupBy("v").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1") \
        .groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = F.size("sketch")
    return nodes.join(alone, "node", "left").filter(
        size - F.coalesce("own", F.lit(0)) >= _least_shared(size, F.col("n"), t, k)).select("node", "rep")


def _full_sets(docs: DataFrame, suspects: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        named = [(w, shingle_set(t, width)) for w, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        kept = [(w, s) for w, s in named if set_name(s) == w]  # an id may name several texts
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.int64()), long_lists([s for _, s in kept])], names=["node", "values"])

    # A bitmap of fixed size leaves out most other rows before their texts are shuffled.
    place = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS))
    bits = suspects.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    maybe = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).withColumn("h", place) \
        .withColumn("word", F.shiftright("h", 6)).join(F.broadcast(bits), "word") \
        .filter(F.getbit("bits", F.col("h").bitwiseAND(63)) == 1).select("rep", "text")
    texts = maybe.join(suspects, "rep")
    return map_arrow(texts.select("node", "text"), build, "node bigint, values array<bigint>")


def _postings(sets: DataFrame, t: float, k: int) -> DataFrame:
    """Step 2: (v, node, n, s, own, pos): the prefix of every wide sketch, rare values first."""
    wide = sets.select("node", F.size("values").alias("n"), F.explode(F.slice("values", 1, k)).alias("v"))
    counts = wide.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ordered = wide.join(counts, "v").groupBy("node").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("shared"))
    size = F.least("n", F.lit(k))
    placed = ordered.withColumn("s", size).withColumn("own", F.col("s") - F.size("shared")) \
        .withColumn("prefix", F.col("s") - _least_shared(F.col("s"), F.col("n"), t, k) + 1)
    return placed.filter("prefix > own").select(
        "node", "n", "s", "own", F.posexplode(F.slice("shared", F.lit(1), (F.col("prefix") - F.col("own")).cast("int")))
        .alias("i", "e")).select("e.v", "node", "n", "s", "own", (F.col("own") + F.col("i")).alias("pos"))


def _viable(a: str, b: str, t: float, k: int) -> Column:
    """Whether two entries of a list, if it holds their first shared value, can still reach the threshold."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    reach = F.least(F.col(f"{a}.reach"), F.col(f"{b}.reach"))
    need = F.when(F.greatest(n_a, n_b) <= k, (n_a + n_b) * (t / (1 + t))).otherwise(F.lit(_lenient(t, k) * k))
    return (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * t - 1e-6) & (reach >= need - 1e-6)


def _confirmed(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int], k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch passes and whose full sets reach the ratio."""
    num, den = ratio
    least = _lenient(num / den, k)

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for row in range(batch.num_rows):
            x, y = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (2, 3))
            union = np.union1d(x[:k], y[:k])[:k]
            in_both = np.isin(union, x[:k], assume_unique=True) & np.isin(union, y[:k], assume_unique=True)
            if in_both.sum() < least * len(union):
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("node").alias(c), F.col("values").alias(f"v{c}")) for c in "ab")
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb"), check, "a bigint, b bigint")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _hub_pairs(postings: DataFrame, t: float, k: int) -> DataFrame:
    """Step 3: one pair per set at most."""
    entry = postings.withColumn("reach", F.col("s") - F.col("pos"))
    hubs = entry.groupBy("v").agg(F.min(F.struct("own", "pos", "node", "n", "reach")).alias("h"),
                                  F.count(F.lit(1)).alias("c")).filter("c > 1").select("v", "h.*")
    met = entry.alias("x").join(hubs.alias("h"), "v").filter(F.col("x.node") != F.col("h.node")) \
        .filter(_viable("x", "h", t, k))
    best = F.max_by(F.col("h.node"), F.struct(F.least("x.reach", "h.reach"), F.col("h.node")))
    return met.groupBy(F.col("x.node").alias("x")).agg(best.alias("h")).select(*_pair(F.col("x"), F.col("h"))).distinct()


def _rest_pairs(postings: DataFrame, labels: DataFrame, t: float, k: int) -> DataFrame:
    """Step 4: viable pairs of one list whose components differ."""
    entry = postings.withColumn("reach", F.col("s") - F.col("pos")).join(
        labels.select(F.col("v").alias("node"), F.col("component").alias("c")), "node", "left") \
        .withColumn("c", F.coalesce("c", "node"))
    parts = entry.groupBy("v", "c").agg(F.max("reach").alias("reach"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    several = parts.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("v")
    parts = parts.join(several, "v")
    x, y = parts.alias("x"), parts.alias("y")
    need = F.when(F.greatest("x.lo", "y.lo") <= k, (F.col("x.lo") + F.col("y.lo")) * (t / (1 + t))) \
        .otherwise(F.lit(_lenient(t, k) * k))
    need = F.least(need, F.when(F.greatest("x.hi", "y.hi") > k, F.lit(_lenient(t, k) * k)))
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.c") < F.col("y.c"))
                 & (F.col("x.hi") >= F.col("y.lo") * t - 1e-6) & (F.col("y.hi") >= F.col("x.lo") * t - 1e-6)
                 & (F.least("x.reach", "y.reach") >= need - 1e-6)) \
        .select(F.col("x.v").alias("v"), F.col("x.c").alias("cx"), F.col("y.c").alias("cy"))
    left = entry.select("v", F.col("c").alias("cx"), F.struct("node", "n", "reach").alias("p"))
    right = entry.select("v", F.col("c").alias("cy"), F.struct("node", "n", "reach").alias("q"))
    return met.join(left, ["v", "cx"]).join(right, ["v", "cy"]).filter(_viable("p", "q", t, k)) \
        .select(*_pair(F.col("p.node"), F.col("q.node"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5,
                    ratio: tuple[int, int] = (4, 5), screen: int = 64, sketch: int = 1024) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Two texts are linked when ``ratio[1] * intersection >= ratio[0] * union``.
    """
    t = ratio[0] / ratio[1]
    sig = stored(signatures(docs, id_col, text_col, width, screen), "signatures")
    suspects = stored(_suspects(sig, t, screen), "suspects")
    sets = stored(_full_sets(docs, suspects, id_col, text_col, width), "sets")
    postings = stored(_postings(sets, t, sketch), "postings")
    links = stored(_confirmed(_hub_pairs(postings, t, sketch), sets, ratio, screen), "links")
    labels = components_by_rounds(links)
    more = stored(_confirmed(_rest_pairs(postings, labels, t, sketch), sets, ratio, screen), "links")
    if not more.isEmpty():
        # The first labels stay; only the components that the new links join are labelled again.
        ends = [labels.select(F.col("v").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
        joined = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components_by_rounds(joined).select(F.col("v").alias("c"), F.col("component").alias("top"))
        known = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("v")).distinct()
                                   .join(labels, "v", "left_anti").withColumn("component", F.col("v")))
        labels = known.join(merged, F.col("component") == F.col("c"), "left") \
            .select("v", F.coalesce("top", "component").alias("component"))
    rep = sig.filter("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"))
    labels = labels.select(F.col("v").alias("node"), "component")
    linked = rep.join(labels, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    # Stored, so that both sides of the last join are plain scans and a set with very many copies can be split.
    smallest = stored(rep.join(linked.join(least, "component").select("node", "least"), "node", "left")
                      .select("node", F.coalesce("least", "rep").alias("component")), "components")
    out = sig.drop("sketch").join(smallest, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
