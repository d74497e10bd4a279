"""Conversation structure repair by a rank-convergence parallel Viterbi (operator 11).

A conversation is repaired when its role initials read ``(s?(ua)+)?``.  Rows may be kept, given another role, deleted,
and empty rows may be inserted; the cheapest edits are wanted, among them those whose initials come first in ASCII.
The costs of the edits still to come, by state of the automaton, are a vector of four, and a row turns the vector
behind it into the vector before it.

1. *Chunks.*  Equal rows of one turn are one run.  Runs are put in order once, over all conversations together, and cut
   into chunks of ``chunk_rows`` runs, so a conversation of any length is many chunks and no task holds it.  A run's row
   that must go and its repetitions move every cost alike; they are one step whatever their number.
2. *Speculation and fix-up.*  All chunks run backward at once, from the vector of a conversation's end, which is right
   for last chunks and a guess for the others.  A chunk whose guess differs from what its successor found, by more than
   a constant, runs again, in passes, until none does.  Costs are small whole numbers and their differences bounded, so
   a step is looked up once it was seen.
3. *Tracing.*  With its true vector every chunk tells, for each state it may be entered in, the state it is left in;
   these maps are composed by doubling from the conversation's first chunk, mostly in one step, since most maps are
   constant.  Then each chunk writes its edits, taking at every row the least letter that the backward costs allow.
4. *Result.*  Rows and chunk edits meet sorted by conversation and are read as a stream: the digest of a repaired
   conversation is one running hash, so one conversation ends in one task, which holds its audit but never its rows.

Defined results: rows of one turn that differ are ordered by role, then by the digest of their text; null turns come
first; null roles and texts are one space; rows of a null id are one conversation; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, stored

DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3  # costs; the last one of a row that ends without a mark and stays
BLANKS = " \t\n\x0b\x0c\r"
# States: 0 nothing yet, 1 behind the system row, 2 behind a user row, 3 behind an assistant row.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
TURN = (2, 2, 3, 2)  # where an inserted or re-roled row leads
ROLE = {2: "user", 3: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
GUESS = ",".join(map(str, END))
PLACE_BITS = 33  # of monotonically_increasing_id, below the partition


def blank_end(text: Column) -> Column:
    """``text`` without blanks at its end."""
    return F.rtrim(text, F.lit(BLANKS))


# ---- the costs of one row -------------------------------------------------------------------------------------------

def before(after: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """Costs before a row from those behind it."""
    if symbol == "D":
        return tuple(v + DELETE for v in after)
    more = CUT_OFF if symbol.isupper() else 0
    keep = KEEP[symbol.lower()]
    out = [min(after[s] + DELETE, after[TURN[s]] + REROLE + more,
               after[keep[s]] + more if s in keep else after[s] + DELETE) for s in range(4)]
    for _ in range(2):  # at most two insertions in a row can pay
        out = [min(out[s], INSERT + out[TURN[s]]) for s in range(4)]
    return tuple(out)


class Steps:
    """Remembered steps on vectors whose last entry is 0, with the constant split off."""

    def __init__(self):
        self.seen: dict[tuple, tuple] = {}

    def __call__(self, after: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], int]:
        if (after, symbol) not in self.seen:
            found = before(after, symbol)
            self.seen[after, symbol] = tuple(v - found[3] for v in found), found[3]
        return self.seen[after, symbol]


def backward(step: Steps, symbols: str, vector: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vectors before every run of a chunk and, last, behind it; repetitions change them by constants only."""
    out = [vector]
    for symbol in reversed(symbols):
        out.append(step(out[-1], symbol)[0] if symbol != "D" else out[-1])
    return out[::-1]


def edit(step: Steps, symbol: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least edits of one row entered in ``state``: inserted initials, then K, D, or the new role's U or A."""
    if symbol == "D":
        return "D", state
    found, constant = step(after, symbol)
    ahead = [v + constant for v in found]
    more, keep, out = CUT_OFF if symbol.isupper() else 0, KEEP[symbol.lower()], ""
    while True:
        if ahead[state] == after[state] + DELETE:
            return out + "D", state
        if ahead[state] == INSERT + ahead[TURN[state]]:
            state = TURN[state]
            out += ROLE[state][0]
        elif state in keep and ahead[state] == after[keep[state]] + more:
            return out + "K", keep[state]
        else:
            state = TURN[state]
            return out + ROLE[state][0].upper(), state


def trace(step: Steps, symbols: str, vectors: list[tuple[int, ...]], state: int) -> tuple[str, int]:
    out = []
    for symbol, after in zip(symbols, vectors[1:]):
        done, state = edit(step, symbol, state, after)
        out.append(done)
    return "".join(out), state


def closing(state: int) -> str:
    """Initials inserted behind the last row."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


# ---- runs and chunks ------------------------------------------------------------------------------------------------

KEY = ["turn", "role", "digest"]


def runs(rows: DataFrame) -> DataFrame:
    """(ck, conv, turn, role, digest, n, symbol) per run of equal rows; ``rows`` has conv, ck, turn, role, text, copies."""
    trimmed = blank_end(F.col("text"))
    flags = rows.filter("copies > 0").select(
        "ck", "conv", "turn", "role", "digest", "copies", (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"))
    group = flags.groupBy("ck", *KEY).agg(F.first("conv").alias("conv"), F.sum("copies").alias("n"),
                                          F.first("blank").alias("blank"), F.first("open").alias("open"))
    firsts = group.groupBy("ck", "role", "digest").agg(F.min(F.struct("turn")).alias("t")).select(
        F.col("ck").alias("fk"), F.col("t.turn").alias("ft"), F.col("role").alias("fr"), F.col("digest").alias("fd"))
    same = (F.col("ck") == F.col("fk")) & F.col("turn").eqNullSafe(F.col("ft")) & (F.col("role") == F.col("fr")) \
        & (F.col("digest") == F.col("fd"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("blank"), "B").when(F.col("fk").isNull(), "D").when(F.col("open"), F.upper(letter)).otherwise(letter)
    return group.join(firsts, same, "left").select("ck", "conv", *KEY, "n", symbol.alias("symbol"))


def chunks(found: DataFrame, chunk_rows: int) -> DataFrame:
    """(ck, conv, c, symbols, faults, counts, first) per chunk; the chunks of a conversation are numbered without gaps."""
    shift = chunk_rows.bit_length() - 1
    if chunk_rows != 1 << shift:
        raise ValueError("chunk_rows must be a power of two")
    ordered = stored(found.repartitionByRange("ck", *KEY).sortWithinPartitions("ck", *KEY)
                     .withColumn("seq", F.monotonically_increasing_id()), "runs")
    block = ordered.withColumn("part", F.shiftright("seq", PLACE_BITS)) \
        .withColumn("block", F.shiftright(F.col("seq").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), shift))
    # One row per partition of the one sort above.
    parts = block.groupBy("part").agg((F.max("block") + 1).alias("blocks"))
    offsets = parts.select("part", (F.sum("blocks").over(Window.orderBy("part")) - F.col("blocks")).alias("before"))
    run = F.sort_array(F.collect_list(F.struct("seq", "symbol", "n")))
    gathered = block.join(F.broadcast(offsets), "part").groupBy("ck", (F.col("before") + F.col("block")).alias("c")).agg(
        F.first("conv").alias("conv"), run.alias("runs"), F.min(F.struct("seq", *KEY)).alias("first"))
    faults = F.array_join(F.transform("runs", lambda r: r["symbol"]), "")
    return stored(gathered.select("ck", "conv", "c", F.translate(faults, "B", "D").alias("symbols"), faults.alias("faults"),
                                  F.transform("runs", lambda r: r["n"]).alias("counts"), "first"), "chunks")


def _vector(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def _mapped(df: DataFrame, fn: Callable[[Steps, list], list], names: str) -> DataFrame:
    """``fn`` on the rows' values from the third column on; the first two, ck and c, pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Steps()
        for batch in batches:
            rows = [fn(step, list(r)) for r in zip(*[c.to_pylist() for c in batch.columns[2:]])]
            cols = zip(*rows) if rows else [[] for _ in names.split()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.string()) for c in cols]],
                                             names=["ck", "c", *names.split()])

    return in_arrow(df, run, "ck string, c bigint, " + ", ".join(f"{n} string" for n in names.split()))


def _run_backward(step: Steps, row: list) -> list:
    symbols, start = row
    return [start, ",".join(map(str, backward(step, symbols, _vector(start))[0]))]


def boundary_vectors(cut: DataFrame) -> tuple[DataFrame, int]:
    """(ck, c, start, out): the vector behind and before every chunk, up to a constant; and the number of fix-up passes."""
    text = cut.select("ck", "c", "symbols")
    now = stored(_mapped(text.withColumn("start", F.lit(GUESS)), _run_backward, "start out"), "vectors")
    for passes in itertools.count():
        following = now.select("ck", (F.col("c") - 1).alias("c"), F.col("out").alias("need"))
        asked = now.join(following, ["ck", "c"], "left").withColumn("need", F.coalesce("need", F.lit(GUESS)))
        wrong = stored(asked.filter("need <> start").select("ck", "c", "need"), "wrong")
        if wrong.isEmpty():
            return now, passes
        again = _mapped(text.join(wrong, ["ck", "c"]).select("ck", "c", "symbols", "need"), _run_backward, "start out")
        now = stored(now.join(wrong, ["ck", "c"], "left_anti").unionByName(again), "vectors")


def _exits(step: Steps, row: list) -> list:
    symbols, start = row
    vectors = backward(step, symbols, _vector(start))
    return ["".join(str(trace(step, symbols, vectors, s)[1]) for s in range(4))]


def entry_states(cut: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ck, c, state): the state in which the best path enters every chunk."""
    exits = _mapped(cut.select("ck", "c", "symbols").join(vectors.select("ck", "c", "start"), ["ck", "c"]), _exits, "exits")
    before_it = exits.select("ck", (F.col("c") + 1).alias("c"), "exits")
    now = stored(cut.select("ck", "c").join(before_it, ["ck", "c"], "left")
                 .select("ck", "c", F.coalesce("exits", F.lit("0000")).alias("exits")), "maps")
    span, constant = 1, F.col("exits") == F.repeat(F.substring("exits", 1, 1), 4)
    while not now.filter(~constant).isEmpty():
        earlier = now.select("ck", (F.col("c") + span).alias("c"), F.col("exits").alias("way"))
        # Each digit of the earlier map goes through the later one.
        later = F.expr("translate(way, '0123', exits)")
        now = stored(now.join(earlier, ["ck", "c"], "left").select(
            "ck", "c", F.when(constant, F.col("exits")).otherwise(later).alias("exits")), "maps")
        span *= 2
    return now.select("ck", "c", F.substring("exits", 1, 1).alias("state"))


def _plan(step: Steps, row: list) -> list:
    symbols, start, state = row
    return list(map(str, trace(step, symbols, backward(step, symbols, _vector(start)), int(state))))


def plans(cut: DataFrame) -> DataFrame:
    """The chunks with ``plan``, their edits, and ``left``, the state they are left in."""
    vectors, _ = boundary_vectors(cut)
    states = entry_states(cut, vectors)
    asked = cut.select("ck", "c", "symbols").join(vectors.select("ck", "c", "start"), ["ck", "c"]).join(states, ["ck", "c"])
    return cut.join(_mapped(asked.select("ck", "c", "symbols", "start", "state"), _plan, "plan left"), ["ck", "c"])


# ---- result ---------------------------------------------------------------------------------------------------------

class _Talk:
    """A conversation while its rows arrive in order."""

    def __init__(self, conv):
        self.conv, self.key, self.initial, self.state, self.lines = conv, None, None, 0, 0
        self.low, self.high, self.turns, self.any_turn = None, None, 0, False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def chunk(self, faults: str, counts: list[int], plan: str, left: str) -> None:
        self.runs, self.plan, self.state = iter(zip(faults, counts)), iter(plan), int(left)

    def line(self, role: str, text: str, letter: str, out: list | None) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        if out is not None:
            out.append((self.conv, self.lines, letter, role, text))
        self.lines += 1

    def insert(self, initial: str, out: list | None) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self.line({"u": "user", "a": "assistant"}[initial], "", "I", out)

    def run(self, turn, role: str, text: str, out: list | None) -> None:
        """The next run, by its first row."""
        fault, n = next(self.runs)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.key is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.illegal += n - 1
        self.initial = role[:1]
        if fault == "B":
            self.blank += n
        else:
            self.duplicate += n if fault == "D" else n - 1
            self.truncated += fault in "SUAX"
        for what in self.plan:
            if what.islower():
                self.insert(what, out)
                continue
            more = CUT_OFF if fault in "SUAX" else 0
            letter = what if what in "KD" else "R"
            self.cost += {"D": DELETE, "K": more, "R": REROLE + more}[letter] + DELETE * (n - 1)
            self.audit.append(letter + "D" * (n - 1))
            if letter != "D":
                self.line({"U": "user", "A": "assistant"}.get(what, role), text, letter, out)
            return

    def close(self, out: list | None) -> None:
        for initial in closing(self.state):
            self.insert(initial, out)

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


def _streamed(rows: DataFrame, planned: DataFrame, lines: bool) -> DataFrame:
    kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    none = {"faults": "string", "counts": "array<bigint>", "plan": "string", "left": "string"}
    texts = rows.select("ck", "conv", *KEY, F.lit(1).alias("after"), "text", "copies",
                        *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    heads = planned.select("ck", "conv", *[F.col(f"first.{k}").alias(k) for k in KEY], F.lit(0).alias("after"),
                           F.lit(None).cast("string").alias("text"), F.lit(1).alias("copies"), *none)
    both = texts.unionByName(heads).repartition(F.col("ck")).sortWithinPartitions("ck", *KEY, "after")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_ck, conv_type = None, None, None
        for batch in batches:
            conv_type = batch.column(1).type
            done, out = [], [] if lines else None
            for ck, conv, turn, role, digest, after, text, copies, faults, counts, plan, left in zip(
                    *[c.to_pylist() for c in batch.columns]):
                if now is None or ck != now_ck:
                    if now is not None:
                        now.close(out)
                        done.append(now.summary())
                    now, now_ck = _Talk(conv), ck
                if after == 0:
                    now.chunk(faults, counts, plan, left)
                elif copies and now.key != (turn, role, digest):
                    now.run(turn, role, text, out)
                    now.key = (turn, role, digest)
            yield from emitted(done, out, conv_type)
        if now is not None:
            out = [] if lines else None
            now.close(out)
            yield from emitted([now.summary()], out, conv_type)

    def emitted(done: list, out: list | None, conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows, types = (out, LINE_TYPES) if lines else (done, SUMMARY_TYPES)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [conv_type, *types.values()])], names=["conv", *types])

    names = {"int64": "bigint", "string": "string"}
    types = LINE_TYPES if lines else SUMMARY_TYPES
    return in_arrow(both, stream, f"conv {kind}, " + ", ".join(f"{c} {names[str(t)]}" for c, t in types.items()))


SUMMARY_TYPES = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()),
                 "audit": pa.string(), "repaired_sha256": pa.string()}
LINE_TYPES = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


def prepared(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None) -> DataFrame:
    """``talks`` under fixed names, nulls as one space, ``copies`` as a row's repetitions (0: only its id counts)."""
    return talks.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("ck"),
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies")) \
        .withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


def repair(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", *, copies: Column | None = None, chunk_rows: int = 128, lines: bool = False) -> DataFrame:
    """One row per conversation with its faults, cost, audit and digest; with ``lines`` one per repaired row:
    (conversation, place, edit, role, text)."""
    rows = prepared(talks, conv_col, turn_col, role_col, text_col, copies)
    return _streamed(rows, plans(chunks(runs(rows), chunk_rows)), lines).withColumnRenamed("conv", conv_col)


def damaged(talks: DataFrame) -> tuple[DataFrame, Column]:
    """The damaged rows of the query, and how often each is there: a rule on the checksum of id and turn."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.col("case")
    text = F.coalesce("text", F.lit(" "))
    out = talks.select("conv_id", "turn", "role", "text", (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary"))
                                                          % 20).alias("case"))
    out = out.withColumn("text", F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)) \
        .withColumn("role", F.when(case == 4, "user").otherwise(F.col("role")))
    return out, F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
