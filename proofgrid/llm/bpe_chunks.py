"""BPE encoding and decoding with content-defined chunk reuse (operator 13).

1. *Cut.*  A rolling hash over 32 bytes cuts every text where the content says so, so that equal passages of different
   documents become equal chunks wherever they stand.
2. *Share.*  Chunks are named by 128-bit digests.  A digest that occurs more than once sets a bit in a bitmap of fixed
   size; a chunk whose bit is set is encoded once for all documents and joined to its places, any other chunk is
   encoded where it is read.  A bit set by another digest costs a shuffle and changes nothing.
3. *Repair.*  A chunk's code covers the words that lie wholly inside it.  At every chunk join the words cut by the join
   are encoded anew together with one known word on each side; the window grows until the codes of its outer words
   agree exactly with the chunks' own.  Chunks without white space are part of the window.

The vocabulary must treat ASCII white space as a border of words; a join that finds no agreement within
``CONTEXT`` words ends the job instead of giving other ids.

Defined results: a null or empty text has no ids and an empty decoded text; rows that repeat an id are encoded each on
its own; special strings in a text are their special ids, as the library's default has it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, located, slices, stored

LEAST_CHUNK, MEAN_MORE, MOST_CHUNK = 256, 1024, 8192  # bytes; a border comes every MEAN_MORE bytes on average
CONTEXT = 4  # known words on each side that a window may grow to
MAP_BITS = 1 << 25  # of the bitmap of digests that occur more than once: 4 MB, sent to every task
CACHED_WORDS = 200_000  # codes of words held by a task
OUT_BYTES = 4_000_000
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gear() -> np.ndarray:
    """256 fixed pseudo-random numbers, by a rule (a multiplicative mix of the byte)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def borders(data: bytes) -> np.ndarray:
    """Ascending places at which the hash of the 32 bytes before allows a cut, never inside a character."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    at = np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN_MORE) == 0) + 1
    at = at[at < len(raw)]
    return at[(raw[at] & 0xC0) != 0x80]


def cut(data: bytes, at: Iterable[int], start: int, end: int) -> Iterator[bytes]:
    """The chunks of ``data[start:end]``, given the borders inside it."""
    for place in [*at, end]:
        while place - start > MOST_CHUNK:
            stop = start + MOST_CHUNK
            while data[stop] & 0xC0 == 0x80:
                stop -= 1
            yield data[start:stop]
            start = stop
        if place == end or place - start >= LEAST_CHUNK:
            if place > start:
                yield data[start:place]
            start = place


def chunked(texts: pa.Array) -> list[list[bytes]]:
    """The chunks of every text of a batch; the hash runs over all of them at once."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data, ends = b"".join(raw), np.cumsum([0, *map(len, raw)])
    at = borders(data)
    first, last = np.searchsorted(at, ends[:-1], "right"), np.searchsorted(at, ends[1:], "left")
    # A border in a text's first bytes may stem from the text before it, but the least chunk is longer than the hash.
    return [list(cut(data, at[i:j].tolist(), int(s), int(e)))
            for i, j, s, e in zip(first, last, ends[:-1], ends[1:])]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _bit(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2] % np.uint64(MAP_BITS)


class Words:
    """Codes of single words by the library, remembered up to a bound; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = 1 + max(self.tok.get_vocab(with_added_tokens=True).values())
        self.tokens = np.array([self.tok.id_to_token(i) for i in range(size)], object)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and (t or "").endswith(suffix) for t in self.tokens])
        self.known: dict[bytes, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Codes of whole texts, by the library."""
        return [self._pack(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Words of plain letters: many in one call, told apart by the tokens that end words."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i:i + 1000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            out += [p.tobytes() for p in np.split(ids, stops[:-1])] if len(stops) == len(part) else self.texts(part)
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        named = [w.decode() for w in new]
        cores = [w.rstrip(MARKS) for w in named]
        plain = [bool(PLAIN_WORD.fullmatch(c)) for c in cores]
        parts = list(dict.fromkeys(c for c, p in zip(cores, plain) if p))
        codes = dict(zip(parts, self._plain(parts)))
        marks = list({w[len(c):] for w, c, p in zip(named, cores, plain) if p and len(w) > len(c)})
        codes.update(zip(marks, self.texts(marks)))
        codes[""] = b""
        odd = [w for w, p in zip(named, plain) if not p]
        others = iter(self.texts(odd))
        self.known.update((n, codes[c] + codes[w[len(c):]] if p else next(others))
                          for n, w, c, p in zip(new, named, cores, plain))

    def codes(self, texts: list[bytes]) -> list[bytes]:
        """Codes of texts that begin and end at word borders."""
        split = [t.split() for t in texts]
        self.learn({w for words in split for w in words})
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def decoded(self, ids: np.ndarray) -> str:
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.tokens[ids].tolist())


_WORDS: dict[str, Words] = {}


def words_of(vocabulary: str) -> Words:
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = Words(vocabulary)
    return _WORDS[vocabulary]


CODE = "solid boolean, head binary, inner_first binary, codes binary, inner_last binary, tail binary"
BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def encode_chunks(words: Words, chunks: list[bytes]) -> list[pa.Array]:
    """``CODE`` of each chunk: codes of its whole words, the texts of its cut ones, and its outer known words."""
    solid, heads, inner, tails = [], [], [], []
    for c in chunks:
        first = BLANK.search(c)
        solid.append(first is None)
        heads.append(c[:first.start()] if first else c)
        last = max(c.rfind(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if first else len(c) - 1
        inner.append(c[first.end():last] if first else b"")
        tails.append(c[last + 1:])
    codes = words.codes(inner)
    near = [(b" ".join(i.split(None, CONTEXT)[:CONTEXT]), b" ".join(i.rsplit(None, CONTEXT)[-CONTEXT:])) for i in inner]
    return [pa.array(solid, pa.bool_()), pa.array(heads, pa.binary()), pa.array([n[0] for n in near], pa.binary()),
            pa.array(codes, pa.binary()), pa.array([n[1] for n in near], pa.binary()), pa.array(tails, pa.binary())]


def _places(parts: list[list[bytes]], first: int = 0) -> tuple[pa.Array, pa.Array, list[bytes]]:
    """Row and number of every chunk of a batch, and the chunks."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    number = np.concatenate([np.arange(first, first + len(p)) for p in parts] or [np.zeros(0)])
    return pa.array(owner, pa.int64()), pa.array(number, pa.int32()), [c for p in parts for c in p]


def chunk_names(docs: DataFrame, text_col: str) -> DataFrame:
    """(loc, digests) of every text of ``docs``, which has ``__loc``."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cuts = chunked(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[digest(c) for c in p] for p in cuts], pa.list_(pa.binary()))],
                    names=["loc", "digests"])

    return in_arrow(docs.select("__loc", F.col(text_col)), name,
                    "loc struct<file: string, row: bigint>, digests array<binary>")


def repeated_bits(names: DataFrame) -> np.ndarray:
    """The bitmap of the digests that occur more than once, ``MAP_BITS`` wide whatever the input."""
    number = F.conv(F.hex(F.reverse(F.substring("d", 1, 8))), 16, 10).cast("decimal(20,0)")
    seen = names.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = seen.select((number % F.lit(MAP_BITS).cast("decimal(20,0)")).cast("bigint").alias("h"))
    words = places.groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _is_set(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    if not digests:
        return np.zeros(0, bool)
    at = _bit(digests)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(loc, number, id, CODE): one head row (number -1) with the id and one row per chunk for every row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    placed = located(docs.select(F.col(id_col), F.col(text_col)))
    loc = "loc struct<file: string, row: bigint>"
    names = stored(chunk_names(placed, text_col), "chunks")
    shared = spark.sparkContext.broadcast(repeated_bits(names))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in batches:
            for part in slices(batch):
                owner, number, chunks = _places(chunked(part.column(2)))
                mine = pa.array(~_is_set(shared.value, [digest(c) for c in chunks]))
                chunks = [c for c, m in zip(chunks, mine.to_pylist()) if m]
                n, rows = part.num_rows, len(chunks)
                ids = pa.concat_arrays([part.column(1), pa.nulls(rows, part.column(1).type)])
                blank = [pa.nulls(n, t) for t in (pa.bool_(), *[pa.binary()] * 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part.column(0), part.column(0).take(owner.filter(mine))]),
                     pa.concat_arrays([pa.array(np.full(n, -1), pa.int32()), number.filter(mine)]), ids,
                     *[pa.concat_arrays([b, c]) for b, c in zip(blank, encode_chunks(words, chunks))]],
                    names=["loc", "number", "id", *[c.split()[0] for c in CODE.split(", ")]])

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                chunks = {digest(c): c for p in chunked(part.column(0)) for c in p}
                kept = pa.array(_is_set(shared.value, list(chunks)), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.binary()),
                                                  pa.array(list(chunks.values()), pa.binary())],
                                                 names=["digest", "chunk"]).filter(kept)

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *encode_chunks(words, part.column(1).to_pylist())],
                                                 names=["digest", *[c.split()[0] for c in CODE.split(", ")]])

    def of_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, digests = _places(batch.column(1).to_pylist())
            kept = pa.array(_is_set(shared.value, digests), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), number, pa.array(digests, pa.binary())],
                                             names=["loc", "number", "digest"]).filter(kept)

    alone = in_arrow(placed.select("__loc", F.col(id_col), F.col(text_col)), own,
                     f"{loc}, number int, id {kind}, {CODE}")
    once = in_arrow(placed.select(F.col(text_col)), first_seen, "digest binary, chunk binary") \
        .groupBy("digest").agg(F.first("chunk").alias("chunk"))
    codes = stored(in_arrow(once, encode_shared, f"digest binary, {CODE}"), "codes")
    places = in_arrow(names, of_shared, f"{loc}, number int, digest binary")
    met = places.join(codes, "digest").withColumn("id", F.lit(None).cast(kind)).select(alone.columns)
    return alone.unionByName(met)


class _Text:
    """One text while its pieces arrive: codes so far, the open cut word, and the known words before it."""

    def __init__(self, ident):
        self.ident, self.parts, self.open, self.before = ident, [], b"", b""


def _windows(words: Words, asked: list[tuple[bytes, bytes, bytes]]) -> list[bytes]:
    """Codes of the middle of each (known words, middle, known words): re-encoded until the known words agree."""
    out: list[bytes | None] = [None] * len(asked)
    todo = [i for i, (_, middle, _) in enumerate(asked) if middle]
    for i in set(range(len(asked))) - set(todo):
        out[i] = b""  # the join fell between two words
    for width in (1, 2, CONTEXT):
        sides = [(b" ".join(asked[i][0].split()[-width:]), b" ".join(asked[i][2].split()[:width])) for i in todo]
        found = words.texts([b" ".join((a, asked[i][1], b)).decode() for i, (a, b) in zip(todo, sides)])
        left, right = words.codes([a for a, _ in sides]), words.codes([b for _, b in sides])
        again = []
        for i, code, a, b in zip(todo, found, left, right):
            if code.startswith(a) and code.endswith(b) and len(code) >= len(a) + len(b):
                out[i] = code[len(a):len(code) - len(b)]
            else:
                again.append(i)
        todo = again
        if not todo:
            return out
    raise ValueError("the vocabulary joins words over white space: chunk codes do not agree with their windows")


def assemble(found: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n_tokens, ids, decoded) per text; ``ids`` as little-endian unsigned 32-bit integers."""
    kind = found.schema["id"].dataType
    ordered = found.repartition(F.col("loc")).sortWithinPartitions("loc", "number")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, done = words_of(vocabulary), None, []
        names = ["id", "n_tokens", "ids", "decoded"]

        def resolved(texts: list[_Text], asked: list) -> None:
            codes = _windows(words, asked)
            for t in texts:
                t.parts = [codes[p] if isinstance(p, int) else p for p in t.parts]

        def emitted(texts: list[_Text], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for k, t in enumerate(texts):
                ids = np.frombuffer(b"".join(t.parts), words.kind)
                t.parts = []
                rows.append((t.ident, len(ids), ids.astype("<u4").tobytes(), words.decoded(ids)))
                size += 4 * len(ids) + len(rows[-1][3])
                if size > OUT_BYTES or k == len(texts) - 1:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                         pa.array(cols[3], pa.string())], names=names)
                    rows, size = [], 0

        def closed(t: _Text, asked: list) -> None:
            t.parts.append(len(asked))
            asked.append((t.before, t.open, b""))
            t.open = b""

        id_type = None
        for batch in batches:
            id_type = batch.column(1).type
            asked, touched = [], [now] if now else []
            for number, ident, solid, head, first, codes, last, tail in zip(*[c.to_pylist() for c in batch.columns]):
                if number < 0:
                    if now:
                        closed(now, asked)
                        done.append(now)
                    now = _Text(ident)
                    touched.append(now)
                elif solid:
                    now.open += head
                else:
                    now.parts.append(len(asked))
                    asked.append((now.before, now.open + head, first))
                    now.parts.append(codes)
                    now.open, now.before = tail, last or b""
            resolved(touched, asked)
            yield from emitted(done, id_type)
            done = []
        if now:
            asked = []
            closed(now, asked)
            resolved([now], asked)
            yield from emitted([now], id_type)

    return in_arrow(ordered.select("number", "id", *[c.split()[0] for c in CODE.split(", ")]), join,
                    f"id {kind.simpleString()}, n_tokens bigint, ids binary, decoded string")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row of ``docs``."""
    vocabulary = vocabulary or default_vocabulary()
    out = assemble(pieces(docs, id_col, text_col, vocabulary), vocabulary)
    return out.withColumnRenamed("id", id_col)
