"""Language identification of mixed text by Viterbi over per-word scores (operator 1).

*Model.*  Counts of word-bounded character n-grams (1 to ``MAX_GRAM`` characters) per language, in ``BUCKETS`` hashed
cells, from a bounded sample of labelled texts (``sample_per_lang`` texts of each language, those with the smallest
hash of their id, read in full), and the share of each script among the language's letters.  Its size is
``BUCKETS`` times the number of languages, whatever the input, so it may be sent to every task.

*Prediction.*  The words (runs of letters) of a text are scored once per distinct word and batch.  The script of a
word, looked up in fixed ranges, leaves only the languages that use it; a script that no language uses leaves all.
Viterbi with one penalty for every switch then labels each word; all texts of a batch advance together, one word
at a time.  Runs of one label are the spans; the label with the most letters is the language of the text, its share
of the letters the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the alphabetically first
language; without any labelled text every text is ``und``.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, map_arrow, stored

BUCKETS = 1 << 16
MAX_GRAM = 4
SCORED_AT_ONCE = 10_000  # words; bounds the memory for their n-grams
HASH_BITS = 12  # of the hash of an id, in the counts that find the sample
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]+")

# First code point of script ranges and the script, up to the next range.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_ID = {n: i for i, n in enumerate(NAMES)}


def script_of(word: str) -> int:
    """Script of most letters of a word, by code point ranges."""
    if word.isascii():
        return SCRIPT_ID["latin"]
    seen = [SCRIPT_ID[SCRIPTS[bisect_right(STARTS, ord(c)) - 1][1]] for c in word]
    return max(sorted(set(seen)), key=seen.count)


def gram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, cell) of every character n-gram of the words with their borders."""
    marked = [f"^{w.lower()}$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters up to the word's end
    state, owners, cells = points.copy(), [], []
    for n in range(1, MAX_GRAM + 1):
        if n > 1:
            state[:-n + 1 or None] = state[:-n + 1] * np.uint64(0x100000001B3) + points[n - 1:]
        fits = room >= n
        mixed = (state[fits] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner[fits])
        cells.append((mixed >> np.uint64(48)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(cells)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, per_lang: int) -> DataFrame:
    """(lang, text) of at most ``per_lang`` labelled training texts per language, picked by the hash of the id."""
    labelled = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    # Counts per cell of the hash, combined where they are read, tell how far the sample reaches in each language: the
    # exact choice then sees little more than the sample, however many rows a language has.
    chosen = chosen.withColumn("cell", F.shiftright("h", 64 - HASH_BITS))
    counts = chosen.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n")
    reach = counts.withColumn("before", before).filter(F.col("before") < per_lang) \
        .groupBy("lang").agg(F.max("cell").alias("last"))
    near = chosen.join(F.broadcast(reach), "lang").filter("cell <= last")  # one row per language
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
    few = ranked.filter(F.col("r") <= per_lang).select("id", "lang").distinct()
    # Labelled rows only, by id and language: an id may also name rows without text, without label or of other languages.
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(few), ["id", "lang"]).select("lang", "text")  # per_lang ids per language at most


class Model:
    """Per-word scores: log-likelihood per n-gram cell, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        logp = np.log(smooth / smooth.sum(axis=0))
        middle = logp.mean(axis=1, keepdims=True) if langs else 0.0
        self.cells = (logp - middle).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= 0.01  # script x language

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages; languages that do not use a word's script are out of reach."""
        if len(words) > SCORED_AT_ONCE:
            return np.concatenate([self.score(words[i:i + SCORED_AT_ONCE])
                                   for i in range(0, len(words), SCORED_AT_ONCE)])
        owner, cell = gram_cells(words)
        scores = np.stack([np.bincount(owner, self.cells[cell, i], len(words)) for i in range(len(self.langs))],
                          axis=1) / MAX_GRAM
        uses = self.uses[[script_of(w) for w in words]]
        uses |= ~uses.any(axis=1, keepdims=True)
        return np.where(uses, scores, scores.min(axis=1, keepdims=True) - 50.0).astype(np.float32)


def fit(labelled: DataFrame) -> Model:
    """Count n-grams and scripts of (lang, text) in the tasks; what is collected is bounded by the model's size."""
    def count(batches):
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = cells.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                words = RUN.findall(text)
                if words:
                    own[:BUCKETS] += np.bincount(gram_cells(words)[1], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount([script_of(w) for w in words], list(map(len, words)),
                                                 len(NAMES)).astype(np.int64)
        for lang, own in cells.items():
            cell = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell),
                                              pa.array(own[cell])], names=["lang", "cell", "n"])

    rows = in_arrow(labelled, count, "lang string, cell bigint, n bigint").groupBy("lang", "cell") \
        .agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[rows["cell"], rows["lang"].map({v: i for i, v in enumerate(langs)})] = rows["n"]
    return Model(langs, table[:BUCKETS], table[BUCKETS:])


def viterbi(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word of several texts; ``words`` are rows of ``scores``, text after text.

    With one penalty for every switch, the best way into a label is to stay or to come from the best label of all.
    """
    labels = np.zeros(len(words), np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    stay = np.ones((len(words), scores.shape[1]), bool)
    best_before = np.zeros(len(words), np.int16)
    total = scores[words[starts]] if len(starts) else np.zeros((0, scores.shape[1]), np.float32)
    ends = total.argmax(axis=1)
    active = len(starts)
    for t in range(1, int(lengths[0]) if active else 0):
        active = int(np.searchsorted(-lengths, -t, "left"))
        live, at = total[:active], starts[:active] + t
        best = live.argmax(axis=1)
        jump = live[np.arange(active), best][:, None] - penalty
        stay[at] = live >= jump
        best_before[at] = best
        live = np.maximum(live, jump) + scores[words[at]]
        total[:active] = live - live.max(axis=1, keepdims=True)
        ends[:active] = total[:active].argmax(axis=1)
    label = ends.copy()
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        active = int(np.searchsorted(-lengths, -t, "left"))
        at = starts[:active] + t
        labels[at] = label[:active]
        label[:active] = np.where(stay[at, label[:active]], label[:active], best_before[at])
    return labels


class _Words(dict):
    """Numbers and scores of the words seen so far by one task; forgotten when there are too many."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit, self.fresh, self.count = limit, [], 0
        self.sizes, self.scores = np.zeros(0, np.int64), None

    def __missing__(self, word: str) -> int:
        number = -1  # a run without a letter
        if word.isalpha() or any(map(str.isalpha, word)):
            number = self.count
            self.count += 1
            self.fresh.append(word)
        self[word] = number
        return number

    def numbers(self, texts: list[str | None], model: Model) -> list[np.ndarray]:
        """Numbers of the words of every text."""
        if len(self) > self.limit:
            self.clear()
            self.__init__(self.limit)
        out = []
        for text in texts:
            words = RUN.findall(text) if text and model.langs else []
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        if self.fresh:
            scores = model.score(self.fresh)
            self.scores = scores if self.scores is None else np.concatenate([self.scores, scores])
            self.sizes = np.concatenate([self.sizes, [sum(map(str.isalpha, w)) for w in self.fresh]])
            self.fresh = []
        return out


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", *, penalty: float = 8.0,
            with_spans: bool = True) -> DataFrame:
    """``columns`` of ``docs``, lang_pred, score, n_spans and (start, end, lang) of the spans, in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*columns).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + \
        ", lang_pred string, score double, n_spans int" + \
        ", spans array<struct<start:bigint,end:bigint,lang:string>>" * with_spans
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    cache = _Words()
    extra = [] if text_col in columns else [F.col(text_col).alias("__text")]
    at_text, kept_columns = len(columns) if extra else columns.index(text_col), len(columns)

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        texts = batch.column(at_text).to_pylist()
        numbered = cache.numbers(texts, model)
        kept = [n[n >= 0] for n in numbered]
        counts = np.fromiter(map(len, kept), np.int64, len(kept))
        words = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        labels = viterbi(cache.scores, words, counts[counts > 0], penalty) if len(words) else np.zeros(0, np.int16)
        langs, share, n_spans, spans, at = [], [], [], [], 0
        for row, n in enumerate(counts.tolist()):
            own = labels[at:at + n]
            mass = np.bincount(own, cache.sizes[words[at:at + n]], len(model.langs)) if n else None
            at += n
            langs.append(model.langs[int(mass.argmax())] if n else UNKNOWN)
            share.append(float(mass.max() / mass.sum()) if n else 0.0)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
            n_spans.append(len(cuts) - 1)
            if with_spans:
                place = [m.span() for m, i in zip(RUN.finditer(texts[row]), numbered[row]) if i >= 0] if n else []
                spans.append([{"start": place[a][0], "end": place[b - 1][1], "lang": model.langs[own[a]]}
                              for a, b in zip(cuts, cuts[1:])])
        found = [pa.array(langs, pa.string()), pa.array(share, pa.float64()), pa.array(n_spans, pa.int32())]
        if with_spans:
            found.append(pa.array(spans, spans_type))
        return pa.RecordBatch.from_arrays([*batch.columns[:kept_columns], *found], schema=pa.schema(
            [*list(batch.schema)[:kept_columns], *[pa.field(n, a.type) for n, a in zip(("lang_pred", "score", "n_spans", "spans"),
                                                                            found)]]))

    return map_arrow(docs.select(*columns, *extra), label, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             train: Column, columns: list[str], sample_per_lang: int = 1000, with_spans: bool = True) -> DataFrame:
    """Fit on the labelled rows where ``train`` holds, predict every row."""
    labelled = stored(sample(docs, id_col, text_col, lang_col, train, sample_per_lang), "language-sample")
    return predict(docs, fit(labelled), columns, text_col, with_spans=with_spans)
