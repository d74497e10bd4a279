"""Phrase collocation mining with stripes (operator 12).

A stripe belongs to a prefix of ``k`` words and counts, for every word that follows it inside a piece of text, how often
it does; what follows too rarely to matter, or the end of a piece, is counted under null.  Tasks build the stripes of
their texts, stripes of one prefix are merged element by element, and the merged stripes give everything:

* entries of at least ``least`` are the extensions, the frequent phrases of ``k + 1`` words;
* the sum of a stripe is its prefix's total, the ``f`` of a phrase when it is part of a cut;
* the largest entry, and the largest entry of the stripes whose phrase ends in the prefix, are the subsumption maxima:
  no longer phrase that holds the prefix is more frequent than those with one word more.

Level 0 is the stripe of the empty prefix: it counts words.  A phrase is frequent only if all its parts are, so level
``k`` makes stripes for frequent prefixes alone and names a next word only where the ``k`` words ending in it are
frequent.  Which ones are, tasks read from a bitmap of fixed size; a bit shared with another phrase costs work and
changes no result.  Stripes are dealt to ``SHARDS`` shards per language by prefix, and a task sends one row a shard, so its
rows do not grow with the number of frequent phrases.  The stripe of a hot prefix, known from a second bitmap, is dealt to
``HOT_SHARDS`` of them by next word (the empty prefix: to all), in all tasks alike, so shards merge on their own and no
task holds it whole.

Defined results: null texts are empty, a null language is ``und``; rows of equal ids or texts all count; ties are
ordered by phrase in byte order; an empty table has no phrase.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, slices, stored

MOST_WORDS = 5
SHARDS, HOT_SHARDS = 512, 32
HOT = 1 << 22  # occurrences from which a prefix's stripe is dealt to shards
PLACES_HELD, WORDS_HELD = 3_000_000, 300_000  # occurrences and distinct words whose stripes a task combines
MAP_BITS = 1 << 25  # of each bitmap: 4 MB, sent to every task
BORDERS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" ")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
STRIPES = "lang string, shard int, prefixes array<string>, words array<array<string>>, counts array<array<int>>"
UNKNOWN = "und"


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
                                  for base in (int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = _Powers()
LETTERS = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, piece and hash of every word of ``data``, whose words are parted by blanks and pieces by line feeds.

    The hash of a word is a polynomial over its bytes, taken from one running sum over all of them.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 10) & (raw != 32)
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    pieces = np.cumsum(raw == 10, dtype=np.int32)[starts] if len(raw) else starts
    up, down = POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTERS[raw] * up[:len(raw)], out=sums[1:])
    return starts, ends, pieces, (sums[ends] - sums[starts]) * down[starts]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return word_spans(b" ".join(words))[3]


def mixed(lang: str, columns: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Bitmap places of phrases; ``columns`` holds the hashes of their first words, second words, and so on."""
    h = np.full(size, xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        h = (h ^ c) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return (h % np.uint64(MAP_BITS)).astype(np.int64)


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _grouped(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the prefix of every occurrence, given the numbers of its words, and an occurrence of each number."""
    n = columns.shape[1]
    code = np.zeros(n, np.int64)
    for column in columns:
        code = np.unique(code * (1 + int(column.max(initial=0))) + column, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


class Stripes:
    """Stripes of the texts of one language for prefixes of ``k`` words, combined in the task up to a bound.

    Hashes only choose the places; the words found there are told apart by their bytes.
    """

    def __init__(self, lang: str, k: int, often: np.ndarray | None, hot: np.ndarray | None):
        self.lang, self.k, self.often, self.hot = lang, k, often, hot
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes: list[np.ndarray] = []  # of the words, in the order of their numbers
        self.found: list[np.ndarray] = []  # per occurrence of a prefix the numbers of its words and of the next one
        self.places = 0

    def add(self, texts: list[bytes]) -> None:
        k, data = self.k, b"\n".join(texts).lower().translate(BORDERS)
        starts, ends, pieces, hashes = word_spans(data)
        n = len(starts)
        borders = np.append(np.flatnonzero(np.diff(pieces)) + 1, n)
        room = borders[np.searchsorted(borders, np.arange(n), "right")] - np.arange(n)  # words from here to the border
        if k == 0:
            at, follows = np.arange(n), np.ones(n, bool)
        else:
            at = np.flatnonzero(room >= k)
            at = at[_is_set(self.often, mixed(self.lang, (hashes[at + j] for j in range(k)), len(at)))]
            frequent = np.zeros(n + 1, bool)
            frequent[at] = True
            follows = (room[at] > k) & frequent[at + 1]
        asked = np.zeros(n + 1, bool)
        for j in range(k):
            asked[at + j] = True
        asked[at[follows] + k] = True
        asked = np.flatnonzero(asked)
        number, before = self.number, len(self.number)
        ids = np.full(n + 1, -1, np.int32)
        ids[asked] = [number.setdefault(data[i:j], len(number)) for i, j in zip(starts[asked].tolist(), ends[asked].tolist())]
        new = np.zeros(len(number) - before, np.uint64)
        late = ids[asked] >= before
        new[ids[asked][late] - before] = hashes[asked][late]
        self.hashes.append(new)
        self.found.append(np.stack([*(ids[at + j] for j in range(k)), np.where(follows, ids[np.minimum(at + k, n)], -1)]))
        self.places += len(at)

    def flushed(self) -> pa.RecordBatch:
        """``STRIPES`` rows of what was added since the last time, one a shard."""
        k, size = self.k, len(self.number)
        found, hashes, words = np.concatenate(self.found, axis=1).astype(np.int64), np.concatenate(self.hashes), list(self.number)
        group, example = _grouped(found[:k])
        places, spread = np.zeros(len(example), np.int64), np.full(len(example), SHARDS)
        if k:
            places = mixed(self.lang, (hashes[found[j, example]] for j in range(k)), len(example))
            spread = np.where(_is_set(self.hot, places), HOT_SHARDS, 1)
        keys, counts = np.unique(group * (size + 1) + found[k] + 1, return_counts=True)
        group, following = keys // (size + 1), keys % (size + 1) - 1
        by_word = np.append((hashes >> np.uint64(40)).astype(np.int64), 0)  # null takes the last one
        shard = (places[group] + by_word[following] % spread[group]) % SHARDS
        order = np.lexsort((group, shard))
        group, shard, following, counts = group[order], shard[order], following[order], counts[order]
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
        heads = np.flatnonzero(np.diff(shard[first], prepend=-1) != 0)
        stripes, shards = pa.array(np.append(first, len(group)), pa.int32()), pa.array(np.append(heads, len(first)), pa.int32())
        named = pa.array([w.decode() for w in words], pa.string())
        following = named.take(pa.array(following, pa.int64(), mask=following < 0))
        prefixes = pa.array([b" ".join([words[i] for i in e]).decode() for e in found[:k, example].T.tolist()], pa.string())
        self.clear()
        listed = pa.ListArray.from_arrays
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(heads), pa.string()), pa.array(shard[first[heads]], pa.int32()),
             listed(shards, prefixes.take(pa.array(group[first], pa.int64()))), listed(shards, listed(stripes, following)),
             listed(shards, listed(stripes, pa.array(counts, pa.int32())))],
            names=["lang", "shard", "prefixes", "words", "counts"])


def entries_of(stripes: DataFrame) -> DataFrame:
    """(lang, shard, prefix, word, n) of ``STRIPES`` rows."""
    def entries(s):
        return F.zip_with(s["words"], s["counts"], lambda w, n: F.struct(
            s["prefixes"].alias("prefix"), w.alias("word"), n.alias("n")))

    listed = F.flatten(F.transform(F.arrays_zip("prefixes", "words", "counts"), entries))
    return stripes.select("lang", "shard", F.inline(listed))


def level(docs: DataFrame, k: int, bits: tuple[np.ndarray, np.ndarray] | None, least: int) -> DataFrame:
    """(lang, prefix, shard, total, best, more) per shard of the merged stripes: sum, largest entry, extensions."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Stripes] = {}
        for batch in batches:
            for part in slices(batch):
                of: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    of.setdefault(lang, []).append(text)
                for lang, texts in of.items():
                    held.setdefault(lang, Stripes(lang, k, *(shared.value or (None, None)))).add(texts)
                if sum(h.places for h in held.values()) >= PLACES_HELD or sum(len(h.number) for h in held.values()) >= WORDS_HELD:
                    for h in held.values():
                        yield h.flushed()
                    held = {}
        for h in held.values():
            yield h.flushed()

    key = ["lang", "prefix", "shard"]
    entries = entries_of(in_arrow(docs.select("lang", "text"), build, STRIPES).repartition("lang", "shard")) \
        .groupBy(*key, "word").agg(F.sum("n").alias("n"))
    found = F.col("word").isNotNull() & (F.col("n") >= least)
    return stored(entries.groupBy(*key).agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("word").isNotNull(), F.col("n"))).alias("best"),
        F.collect_list(F.when(found, F.struct("word", "n"))).alias("more")), f"stripes-{k}")


def extensions(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, a): the frequent phrases one word longer than the stripes' prefixes."""
    phrase = F.when(F.col("prefix") == "", F.col("e.word")).otherwise(F.concat_ws(" ", "prefix", "e.word"))
    return stripes.select("lang", "prefix", F.explode("more").alias("e")) \
        .select("lang", phrase.alias("phrase"), F.col("e.n").alias("a"))


def bitmaps(found: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The bits of all phrases and of the hot ones, or nothing where there is no phrase; of fixed size."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for row, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                at[row:row + 1] = mixed(lang, word_hashes(phrase.encode().split(b" "))[:, None], 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(2)], names=["at", "a"])

    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = in_arrow(found.select("lang", "phrase", "a"), place, "at bigint, a bigint") \
        .groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(bit).alias("often"), F.bit_or(F.when(F.col("a") >= HOT, bit).otherwise(F.lit(0))).alias("hot")).toArrow()
    if not words.num_rows:
        return None
    out = []
    for name in ("often", "hot"):
        bits = np.zeros(MAP_BITS // 64, np.int64)
        bits[words["word"].to_numpy()] = words[name].to_numpy()
        out.append(bits.view(np.uint8))
    return out[0], out[1]


def _exact(x: str):
    return F.col(x).cast("decimal(20,0)")


def mine(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000,
         subsumed: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase inside a longer one of at least ``subsumed`` hundredths of its frequency is dropped.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels, bits = [level(texts, 0, None, least)], None
    for k in range(1, MOST_WORDS):
        bits = bitmaps(extensions(levels[-1]))
        if bits is None:
            break
        levels.append(level(texts, k, bits, least))
    words = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    parts = reduce(DataFrame.unionByName, levels[1:], levels[0].filter("false"))
    totals = parts.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"), F.max("best").alias("best"))
    found = extensions(parts)
    # The longer phrases a phrase ends, and those it begins: both are one word longer.
    ends = found.groupBy("lang", F.regexp_extract("phrase", r"(?s)^[^ ]+ (.*)$", 1).alias("phrase")).agg(F.max("a").alias("before"))
    kept = found.join(totals.select("lang", "phrase", "best"), ["lang", "phrase"], "left").join(ends, ["lang", "phrase"], "left") \
        .filter(100 * F.greatest(F.coalesce("best", F.lit(0)), F.coalesce("before", F.lit(0))) < F.greatest(
            subsumed * F.col("a"), F.lit(100 * least)))
    split = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(split, F.col("k") + 1, F.size(split) - F.col("k")), " ").alias("right"))
    left, right = (totals.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(words, "lang") \
        .withColumn("top", 1000 * _exact("a") * _exact("n")).withColumn("under", _exact("l") * _exact("r")) \
        .withColumn("score", F.expr("top div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")) \
        .select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
