"""Best-fit packing planned on a histogram of lengths (operator 7).

1. Texts become token ids and pieces of at most ``size`` tokens where they are read; only lengths and digests move.
2. The histogram (at most ``size`` rows, whatever the input) is packed by best-fit decreasing over counts: all
   sequences that have the same room left are one group, and the documents of one length fill the tightest group
   together.  The plan is a short list of slots (length, ranks from-to, sequences from-to, offset).
3. Pieces are numbered within their length, in slices so that a length that many pieces share is no single window,
   and take their slots by joining on (length, rank).

Defined results: a null text is an empty text, which is one piece with the end token alone; rows that repeat an id
are packed like any others.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import map_arrow, numbered, small_table, stored

SLOT_ROWS = 10_000  # slots that one row of the plan stands for, at most


def default_vocabulary() -> str:
    """The installed byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The same vocabulary as ranks: equal ids for ordinary text, four times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts as the vocabulary's own library gives them, one per Python worker.

    Ranks serve ordinary texts.  Texts with a special string, whose id they lack, and texts with a run of blanks or of
    other characters too long for their pattern go to the library itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.no_truncation()
        self.whole.no_padding()
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s{200}", r"\S{2000}", *special]))
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.quick is None or self.odd.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    if (vocabulary, ranks) not in _ENCODERS:
        _ENCODERS[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _ENCODERS[vocabulary, ranks]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole pieces at the end, what is over comes first."""
    first = n % size or size if n > size else n
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str, ranks: str | None,
           keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text, ended by token 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenize(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, owner, out = encoder(vocabulary, ranks), [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = np.array([*tok.encode(text or ""), 0], "<u4")
            for i, (start, n) in enumerate(cut(len(ids), size)):
                part = ids[start:start + n]
                owner.append(row)
                out.append((i, start, n, zlib.crc32(part.tobytes()), part))
        cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([o[0] for o in out], pa.int32()),
                *[pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3)]]
        if keep_ids:
            cols.append(pa.array([o[4].astype(np.int32) for o in out], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), tokenize,
                     f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
                     + ", ids array<int>" * keep_ids)


def plan_slots(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, offset) of runs of slots."""
    rooms: list[int] = []  # the distinct amounts of room left, ascending
    groups: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room left -> runs of sequences (first, number)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(rooms, length)
            room = rooms[i] if i < len(rooms) else size
            into = min(room // length, left)  # a sequence takes as many of them as it can hold
            if i < len(rooms):
                first, there = groups[room].popleft()
                number = min(there, left // into)
                if number < there:
                    groups[room].appendleft((first + number, there - number))
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                first, number = opened, left // into
                opened += number
            for k in range(into):
                slots.append((length, rank, number, first, size - room + k * length))
                rank += number
            left -= into * number
            if over := room - into * length:
                if over not in groups:
                    insort(rooms, over)
                groups[over].append((first, number))
    return slots


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048,
         vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece."""
    spark = docs.sparkSession
    ranks = default_ranks() if vocabulary is None else None
    cutup = stored(pieces(docs, id_col, text_col, size, vocabulary or default_vocabulary(), ranks, keep_ids), "pieces")
    histogram = {r.length: r.n for r in cutup.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = [(n, rank + d, min(SLOT_ROWS, number - d), first + d, offset)
            for n, rank, number, first, offset in plan_slots(histogram, size) for d in range(0, number, SLOT_ROWS)]
    slots = small_table(spark, {c: pa.array([run[i] for run in runs], pa.int64()) for i, c in enumerate(
        ("length", "rank", "number", "first", "offset"))}) \
        .repartition(max(1, len(runs) // 64)) \
        .select("length", "rank", "first", "offset", F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("d")) \
        .select("length", (F.col("rank") + F.col("d")).alias("rank"), (F.col("first") + F.col("d")).alias("sequence_id"),
                "offset")
    ranked = numbered(cutup, ["length"], max(histogram.values(), default=0))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.join(slots, ["length", "rank"]).select(*columns, *["ids"] * keep_ids)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from the output of ``pack(keep_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's tokens
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
