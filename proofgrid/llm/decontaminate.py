"""Benchmark decontamination by a distributed positional inverted index (operator 9).

The training texts are cut into blocks of about ``BLOCK_WORDS`` words (whole
documents).  Each block becomes one stored row: for every term its posting
list, the sorted word positions in the block; documents are separated by a gap
as long as a window and a stretch, so no match crosses a border.  Blocks answer all test
windows on their own, so nothing is shuffled and no term or document, however
frequent or long, meets in one task.  For a window the list of its rarest term
(by postings over all blocks) is shifted by the term's offset and intersected
with the shifted lists of its other terms, rarest first: what is left are the
exact phrase matches.

A proximity match is an edited copy: ``slop`` words in a row of a document hold
at least ``share`` of the distinct terms of some window of the item, in any
order, and the item has no phrase match in the document.  It depends on the
document and the item alone.  A window of d terms that needs m of them is only
near one of its d-m+1 rarest: their postings are the candidates.  A signature of
the 2 x ``slop`` words around each bounds how many of the terms are there; where
that is enough, they are counted, and where enough are there, in every stretch.

The index holds the terms whose bit is set in a bitmap of the items' terms, of
fixed size whatever their number.  Words are found by one running sum over the
bytes, and only those whose bit is set become objects.  Test items are sent to
the tasks in blocks of at most ``QUERY_WORDS`` words.

Defined results: a null or empty text has no words; an item without words
matches nothing; a null item id counts as the empty string; items that repeat
an id count once; without items no word is hit.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.collocations import word_spans
from proofgrid.llm.common import in_arrow, long_lists, slices, small_table, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of text with A-Z in lower case; bytes from 0x80 are parts of other letters
BLOCK_WORDS = 200_000
QUERY_WORDS = 1_000_000
PIECE_BYTES = 1 << 20  # of text whose words are found together
TERM_BITS = 23  # the bitmap of the items' terms has 2**23 bits: 1 MB, sent to every task
SIGNS = 2  # 64-bit words of a signature of the terms around a place
PAIRS_SCREENED, PAIRS_AT_ONCE = 100_000, 2_000  # candidates whose signatures, whose surroundings are looked at together
BLANKS = bytes(b if WORD.fullmatch(bytes([b]).lower()) else 32 for b in range(256))  # all that is in no word becomes a blank


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _windows(items: list[tuple[str, str | None]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """Every window of the items and the ids of the items that hold it."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out[tuple(words[i:i + width])].add(item or "")
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Places of words in the bitmap of the items' terms."""
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the texts, and of every word in one its start, its end, its text's number and its hash."""
    data = b"\n".join([t.lower().translate(BLANKS) for t in texts])
    at = text = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        part = data[at:end if end >= 0 else len(data)]
        starts, ends, of, hashes = word_spans(part)
        yield part, starts, ends, of + text, hashes
        text += part.count(b"\n")
        at += len(part)


def asked_terms(items: DataFrame) -> bytes:
    """The bitmap of all terms of ``items`` (text)."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            bits = np.unique(np.concatenate([np.zeros(0, np.int64), *[_bits(piece[4]) for piece in _pieces(texts)]]))
            yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["h"])

    words = in_arrow(items.select("text"), run, "h bigint").groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << TERM_BITS) // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def build_index(docs: DataFrame, id_col: str, text_col: str, asked: bytes, gap: int) -> DataFrame:
    """One row per block: ids, starts and lengths of its documents; terms, their counts and their positions.

    Only terms whose bit is set in ``asked`` are kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def block(ids: pa.Array, lengths: np.ndarray, names: np.ndarray, numbers: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        starts = np.cumsum(lengths + gap) - lengths - gap
        order = np.argsort(numbers, kind="stable")
        terms, counts = np.unique(numbers, return_counts=True)
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, t))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             long_lists([starts]), one(lengths, pa.int64()), one(names[terms].tolist(), pa.binary()), long_lists([counts]),
             one(places[order].astype(np.int32), pa.int32())],
            names=["block", "ids", "starts", "lengths", "terms", "counts", "places"])

    def blocks(ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        bits, number = np.frombuffer(sent.value, np.uint8), {}
        words, found = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)]  # texts of all words; number, place, text of those asked for
        seen = 0
        for part, starts, ends, of, hashes in _pieces(texts):
            at = _bits(hashes)
            kept = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            numbers = [number.setdefault(part[i:j], len(number)) for i, j in zip(starts[kept].tolist(), ends[kept].tolist())]
            found.append(np.stack([np.array(numbers, np.int64), kept + seen, of[kept]]))
            words.append(of)
            seen += len(of)
        lengths = np.bincount(np.concatenate(words), minlength=len(texts))
        numbers, places, of = np.concatenate(found, axis=1)
        names = np.empty(len(number), object)
        names[:] = list(number)
        first, size = 0, 0
        for row, n in enumerate(lengths.tolist(), 1):
            size += n + gap
            if size >= BLOCK_WORDS or row == len(lengths):
                a, b = np.searchsorted(of, [first, row])
                here = places[a:b] - lengths[:first].sum() + (of[a:b] - first) * gap
                yield block(ids.slice(first, row - first), lengths[first:row], names, numbers[a:b], here)
                first, size = row, 0

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, first, size = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], 0, 0
                for row, text in enumerate(texts, 1):
                    size += len(text)
                    if size >= PIECE_BYTES or row == len(texts):
                        yield from blocks(part.column(0).slice(first, row - first), texts[first:row])
                        first, size = row, 0

    return in_arrow(
        docs.select(F.col(id_col), F.col(text_col)), run, f"block string, ids array<{kind}>, starts array<bigint>, lengths array<bigint>, terms array<binary>, "
             "counts array<bigint>, places array<int>")


class _Keys:
    """For every term the rows of a table that are looked for where it stands."""

    def __init__(self, rows_of: list[list[int]]):
        self.count = np.array([*map(len, rows_of), 0], np.int64)  # the last one is for terms that no row asks for
        self.start = np.cumsum(self.count) - self.count
        self.rows = np.array([r for of in rows_of for r in of], np.int64)

    def pairs(self, of_place: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, rows) to be compared, some at a time."""
        per = self.count[of_place]
        at, term, per = places[per > 0].astype(np.int64), of_place[per > 0], per[per > 0]
        cuts = np.searchsorted(np.cumsum(per), np.arange(PAIRS_SCREENED, per.sum(), PAIRS_SCREENED), "right")
        for some, of, n in zip(*[np.split(x, np.unique(cuts)) for x in (at, term, per)]):
            if len(some):
                yield np.repeat(some, n), self.rows[np.repeat(self.start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class _Asked:
    """Windows by their rarest term; windows of which enough terms occur, and how many are enough."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int], share: tuple[int, int]):
        def rare(w):
            return counts.get(w, 0), w

        whole, near = [], []
        for window, ids in windows.items():
            order, items = sorted(range(len(window)), key=lambda i: rare(window[i])), sorted(ids)
            if counts.get(window[order[0]], 0):
                whole.append((window, order, items))
            terms = set(window)
            need, known = -(-share[0] * len(terms) // share[1]), sorted(terms & counts.keys(), key=rare)
            if len(known) >= need:
                near.append((known, need, items))
        self.number = {t: i for i, t in enumerate(sorted({t for known, _, _ in near for t in known} | {t for w, _, _ in whole for t in w}))}
        self.width = max((len(w) for w, _, _ in whole), default=0)
        self.lengths = np.array([len(w) for w, _, _ in whole], np.int64)
        self.whole_items = [items for _, _, items in whole]
        # per window the offsets of its words, rarest first, and the words; short ones name their rarest again
        self.offsets = np.array([[*order, *[order[0]] * (self.width - len(order))] for _, order, _ in whole], np.int64).reshape(len(whole), self.width)
        self.words = np.array([[self.number[w[i]] for i in offsets] for (w, _, _), offsets in zip(whole, self.offsets.tolist())],
                              np.int32).reshape(len(whole), self.width)
        rows_of: list[list[int]] = [[] for _ in self.number]
        for w, (window, order, _) in enumerate(whole):
            rows_of[self.number[window[order[0]]]].append(w)
        self.rarest = _Keys(rows_of)
        self.need = np.array([need for _, need, _ in near], np.int64)
        self.items = [items for _, _, items in near]
        self.terms = np.full((len(near), max((len(k) for k, _, _ in near), default=0)), -2, np.int32)
        rows_of = [[] for _ in self.number]
        for w, (known, need, _) in enumerate(near):
            self.terms[w, :len(known)] = [self.number[t] for t in known]
            for t in known[:len(known) - need + 1]:
                rows_of[self.number[t]].append(w)
        self.keys = _Keys(rows_of)
        # the signs of a term: one bit; two terms of a window may share it, so that many more may be there than bits tell
        self.signs = np.zeros((len(self.number) + 1, SIGNS), np.uint64)
        numbers = np.arange(len(self.number))
        self.signs[numbers, numbers // 64 % SIGNS] = np.uint64(1) << (numbers % 64).astype(np.uint64)
        self.window_signs = np.zeros((len(near), SIGNS), np.uint64)
        for j in range(self.terms.shape[1]):
            self.window_signs |= self.signs[np.maximum(self.terms[:, j], -1)]
        known = (self.terms >= 0).sum(axis=1)
        self.bits_needed = self.need - (known - np.bitwise_count(self.window_signs).sum(axis=1, dtype=np.int64))

    def phrases(self, of_place: np.ndarray, places: np.ndarray, n_places: int):
        """(first places, windows) of all exact matches."""
        words = np.full(n_places + 2 * self.width, -1, np.int32)
        words[places + self.width] = of_place
        for place, window in self.rarest.pairs(of_place, places):
            first = place - self.offsets[window, 0]
            for j in range(1, self.width):
                kept = words[first + self.offsets[window, j] + self.width] == self.words[window, j]
                first, window = first[kept], window[kept]
            if len(first):
                yield first, window

    def _signs_around(self, around: np.ndarray, width: int) -> np.ndarray:
        """The signs of the terms in ``width`` places from each."""
        out, n, reach = self.signs[around], len(around) - width + 1, 1
        while 2 * reach <= width:
            out = out[:-reach] | out[reach:]
            reach *= 2
        return out[:n] | out[width - reach:][:n]

    def nearby(self, of_place: np.ndarray, places: np.ndarray, n_places: int, slop: int):
        """(place, window) of stretches that hold enough of a window's terms."""
        around = np.full(n_places + 2 * slop, -1, np.int32)
        around[places + slop] = of_place
        signs = self._signs_around(around, 2 * slop - 1)
        for all_places, all_windows in self.keys.pairs(of_place, places):
            there = np.bitwise_count(signs[all_places + 1] & self.window_signs[all_windows]).sum(axis=1, dtype=np.int64)
            kept = np.flatnonzero(there >= self.bits_needed[all_windows])
            for some in np.split(kept, range(PAIRS_AT_ONCE, len(kept), PAIRS_AT_ONCE)):
                yield from self._counted(around, all_places[some], all_windows[some], slop)

    def _counted(self, around: np.ndarray, place: np.ndarray, window: np.ndarray, slop: int):
        """Those of the candidates that hold."""
        words, wanted, need = around[place[:, None] + np.arange(1, 2 * slop)], self.terms[window], self.need[window]
        there = sum((words == wanted[:, j, None]).any(axis=1).astype(np.int64) for j in range(wanted.shape[1]))
        kept = there >= need
        if not kept.any():
            return
        place, window, words, wanted, need = (x[kept] for x in (place, window, words, wanted, need))
        held = np.zeros((len(place), slop), np.int64)  # distinct terms of the stretches that start at each place
        for j in range(wanted.shape[1]):
            seen = np.zeros((len(place), 2 * slop), np.int64)
            np.cumsum(words == wanted[:, j, None], axis=1, out=seen[:, 1:])
            held += seen[:, slop:] > seen[:, :-slop]
        kept = held.max(axis=1, initial=0) >= need
        yield from zip(place[kept].tolist(), window[kept].tolist())

    def answer(self, starts, lengths, terms, counts, places, slop):
        """Per document of a block: hit word ranges, items with a phrase match, items with a proximity match."""
        hit = np.zeros(int(starts[-1] + lengths[-1]) + 1, bool)
        phrase, near = defaultdict(set), defaultdict(set)
        of_place = np.repeat(np.array([self.number.get(t, -1) for t in terms], np.int32), counts)
        for first, window in self.phrases(of_place, places, len(hit)) if len(places) else ():
            n = self.lengths[window]
            hit[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
            doc = np.searchsorted(starts, first, "right") - 1
            for d, w in set(zip(doc.tolist(), window.tolist())):
                phrase[d].update(self.whole_items[w])
        for place, window in self.nearby(of_place, places, len(hit), slop) if len(places) and self.items else ():
            near[int(np.searchsorted(starts, place, "right")) - 1].update(self.items[window])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
        edge = edge.reshape(-1, 2)  # a document's last word is followed by a gap or the spare place
        owner = np.searchsorted(starts, edge[:, 0], "right") - 1
        ranges = defaultdict(list)
        for doc, (a, b) in zip(owner.tolist(), edge.tolist()):
            ranges[doc].append({"first": a - int(starts[doc]), "past": b - int(starts[doc])})
        return ranges, phrase, near


def _joined(answers: list[DataFrame]) -> DataFrame:
    """The answers to several query blocks put together: one group per document, one row per query block."""
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    whole = every.groupBy("block", "doc").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")])
    # ranges that overlap or touch become one
    last = "element_at(acc, -1)"
    merged = F.expr(f"""aggregate(slice(hits, 2, greatest(size(hits) - 1, 0)), slice(hits, 1, 1), (acc, x) ->
        if(x.first <= {last}.past,
           concat(slice(acc, 1, size(acc) - 1),
                  array(named_struct('first', {last}.first, 'past', greatest({last}.past, x.past)))),
           concat(acc, array(x))))""")
    return whole.withColumn("hits", merged)


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", *, width: int = 13,
                 slop: int = 26, share: tuple[int, int] = (2, 3), query_words: int = QUERY_WORDS) -> DataFrame:
    """(id, n_words, hits, items, near) per row of ``docs``.

    ``hits`` are the ranges of words inside any occurrence of a window (first, past the last), ``items`` the sorted
    ids of items with a phrase match, ``near`` of those with a proximity match only: ``slop`` words in a row hold
    ``share`` of the terms of a window.
    """
    spark = docs.sparkSession
    item_rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    chars = item_rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // (2 * query_words)) or 1  # a word and its space are two characters at least
    keyed = item_rows.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    kind = docs.schema[id_col].dataType.simpleString()

    def windows_of(b: int):
        return _windows([(r.item, r.text) for r in keyed.filter(F.col("b") == b).collect()], width)

    index = stored(build_index(docs, id_col, text_col, asked_terms(item_rows), max(width, slop)), "index")
    sums = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms") \
        .agg(F.sum("e.counts").alias("n"))

    def ask(windows) -> DataFrame:
        known = sorted({w for win in windows for w in win})
        asked = small_table(spark, {"terms": pa.array(known, pa.binary())})
        counts = {bytes(r.terms): r.n for r in sums.join(asked, "terms", "left_semi").collect()}
        sent = spark.sparkContext.broadcast(_Asked(windows, counts, share))

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column(1)[row].values
                    starts, lengths, counts_, places = (
                        batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6))
                    ranges, phrase, near = sent.value.answer(
                        starts, lengths, batch.column(4)[row].values.to_pylist(), counts_, places, slop)
                    docs_ = range(len(ids))
                    hits = pa.array([ranges.get(d, []) for d in docs_],
                                    pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))
                    named = [pa.array([sorted(found.get(d, ())) for d in docs_], pa.list_(pa.string()))
                             for found in (phrase, near)]
                    block = pa.array([batch.column(0)[row].as_py()] * len(ids), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [block, pa.array(docs_, pa.int64()), ids, pa.array(lengths), hits, *named],
                        names=["block", "doc", "id", "n_words", "hits", "items", "near"])

        return in_arrow(index, run, f"block string, doc bigint, id {kind}, n_words bigint, hits array<struct<first:bigint,past:bigint>>, "
                                     "items array<string>, near array<string>")

    answers = [ask(windows_of(b)) for b in range(blocks)]
    found = answers[0] if blocks == 1 else _joined(answers)
    return found.select(F.col("id").alias(id_col), "n_words", "hits", "items",
                        F.array_except("near", "items").alias("near"))
