"""Conversation repair, phrase mining and chunked BPE against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.llm import bpe_chunks, collocations, conversations

TALKS = "conv_id bigint, turn bigint, role string, text string, ck string, digest string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def damaged_rows(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        talks[conv] += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return talks


def inserted(raw):
    best = dict(raw)
    for _ in range(4):
        for s in range(4):
            for initial in "ua":
                if (to := NEXT[s].get(initial)) in best:
                    cost, audit, lines = best[to]
                    found = (cost + 3, "I" + audit, (NAMES[initial] + ":", lines))
                    if s not in best or found[:2] < best[s][:2]:
                        best[s] = found
    return best


def best_repair(rows):
    """(faults, cost, audit, digest) by whole audit strings for every suffix and state."""
    seen, kinds, faults = set(), [], Counter()
    for _, role, text in rows:
        core = re.findall("[^\x20\x09-\x0d]", text)
        kind = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        faults[kind] += 1
    best = inserted({0: (0, "", None), 3: (0, "", None)})
    for (_, role, text), kind in reversed(list(zip(rows, kinds))):
        raw = {}
        for s in range(4):
            found = [(best[s][0] + 4, "D" + best[s][1], best[s][2])] if s in best else []
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                for letter, cost, initial, name in [("K", 0, role[:1], role), *[("R", 3, i, NAMES[i]) for i in "ua"]]:
                    if (to := NEXT[s].get(initial)) in best:
                        found.append((best[to][0] + cost + more, letter + best[to][1], (f"{name}:{text}", best[to][2])))
            if found:
                raw[s] = min(found, key=lambda f: f[:2])
        best = inserted(raw)
    cost, audit, lines = best[0]
    texts = []
    while lines:
        texts.append(lines[0])
        lines = lines[1]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
            faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


def best_repairs(rows):
    def order(r):
        return r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()

    return {conv: best_repair(sorted(talk, key=order)) for conv, talk in damaged_rows(rows).items()}


def repaired(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TALKS).repartition(5)
    talks, copies = conversations.damaged(df)
    found = [tuple(r) for r in conversations.repair(talks, copies=copies, **options).collect()]
    assert len({f[0] for f in found}) == len(found)
    return {f[0]: f[1:] for f in found}


def some_talks():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.choice([0, 1, 3, 9, 40, 120])):
            for _ in range(1 if rng.random() < .9 else 3):
                rows.append((conv, None if rng.random() < .05 else turn + rng.randint(0, 1),
                             rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]),
                             rng.choice([None, "", "  ", "hi.", "no end", f"text {turn}.", f"text {turn} x", f"b{turn}! \n"])))
    return rows


@pytest.mark.parametrize("chunk_rows", [8, 128])
def test_repairs_equal_the_best_of_all(spark, chunk_rows):
    rows = some_talks()
    assert repaired(spark, rows, chunk_rows=chunk_rows) == best_repairs(rows)


def test_repairs_of_long_conversations_whose_guesses_are_wrong(spark):
    """Many chunks: strangers, systems, cut-off rows, one repeated row, and a sound conversation."""
    rows = [(1, t, "tool", f"open {t}") for t in range(300)] + [(2, t, "system", f"sys {t}.") for t in range(300)] \
        + [(3, t, "user", f"u {t}") for t in range(300)] + [(4, 0, "user", "same.")] * 500 \
        + [(5, t, "user" if t % 2 == 0 else "assistant", f"g {t}.") for t in range(400)]
    assert repaired(spark, rows, chunk_rows=16) == best_repairs(rows)


def test_repaired_lines_give_the_digest(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hi there."), (7, 2, "user", "Are you there?"), (7, 3, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    lines = sorted(conversations.repair(df, lines=True).collect(), key=lambda r: r.place)
    whole = conversations.repair(df).collect()[0]
    assert [r.edit for r in lines] == [c for c in whole.audit if c != "D"]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == whole.repaired_sha256


def test_conversations_that_lose_all_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}


def brute_phrases(rows, least, top, share):
    texts, out = {}, []
    for lang, text in rows:
        texts.setdefault(lang or "und", []).append(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for lang, of in texts.items():
        f, n = Counter(), 0
        for text in of:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                words = re.findall("[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i:i + k] for q, a in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                if 100 * a >= share * found[q[i:i + k]]}
        scored = []
        for p in found.keys() - gone:
            a = found[p]
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top, share, hot", [(3, 50, 100, 10), (5, 2000, 80, 10_000), (100, 10, 100, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, share, hot):
    """Also with stripes that are dealt to shards."""
    monkeypatch.setattr(collocations, "HOT", hot)
    rng = random.Random(2)
    words = ["x", "Y", "zé", "w ", "  ", "\t", ".", ",", "\n", "x y z ", "The cat sat on ", "É ", "a1 ", "\x00 "]
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < .05 else "".join(rng.choices(words, k=rng.randint(0, 200))))
            for _ in range(200)] + [("a", "long run " * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(6)
    assert sorted(map(tuple, collocations.mine(df, least=least, top=top, subsumed=share).collect())) \
        == brute_phrases(rows, least, top, share)


def test_scores_whose_products_pass_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, 9 * big)], "a bigint, n bigint").withColumn("l", F.col("a")).withColumn("r", F.col("a") + 7)
    top, under = 1000 * collocations._exact("a") * collocations._exact("n"), collocations._exact("l") * collocations._exact("r")
    assert row.select(top.alias("top"), under.alias("under")).select(F.expr("top div under")).first()[0] \
        == 1000 * big * 9 * big // (big * (big + 7))


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


TOKEN_PARTS = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "'", "1", "9", ".", "<|endoftext|>", "<|ENDOFTEXT|>", "é",
               "İ", "ß", "中", "　", "\x1c", "\x85", "😀", "thing ", "word ", "'ll", "_"]


def test_tokens_equal_the_library(spark):
    """Shared chunks, chunks without white space, special strings, and texts that are one long run."""
    rng = random.Random(1)
    texts = ["".join(rng.choices(TOKEN_PARTS, k=rng.randint(0, 3000))) for _ in range(40)]
    texts += [None, "", "   ", "x" * 50_000, " " * 1_000_000, "lorem ipsum dolor sit. " * 3000, "é" * 9000,
              texts[0] + texts[1], texts[1] + texts[0] + "z", texts[0] + texts[1]]
    ids = [None if i % 9 == 0 else i % 30 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids, texts)],
                               "doc_id bigint, text string, id string, loc string").repartition(5)
    tok = bpe_chunks.words_of(bpe_chunks.default_vocabulary()).tok
    want = []
    for i, t in zip(ids, texts):
        codes = tok.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(codes), np.array(codes, "<u4").tobytes(), tok.decode(codes, skip_special_tokens=False)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe_chunks.encode(df).collect()]
    assert sorted(got) == sorted(want)


def test_chunks_are_found_again_behind_an_insertion():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(8000)).encode()
    a, b = ([*bpe_chunks.cut(t, bpe_chunks.borders(t).tolist(), 0, len(t))] for t in (text, b"some new words " + text))
    assert b"".join(a) == text and max(map(len, a)) <= bpe_chunks.MOST_CHUNK
    assert len(set(a) & set(b)) >= len(a) - 2


def test_a_window_grows_until_its_known_words_agree():
    class Odd:
        """Codes of words that a vocabulary joins where exactly one word stands before them."""

        def texts(self, texts):
            return [b"?" if t.count(" ") <= 2 else t.replace(" ", "").encode() for t in texts]

        def codes(self, texts):
            return [t.replace(b" ", b"") for t in texts]

    assert bpe_chunks._windows(Odd(), [(b"p q r", b"mid", b"s t"), (b"p", b"", b"q")]) == [b"mid", b""]
    with pytest.raises(ValueError):
        bpe_chunks._windows(Odd(), [(b"p", b"mid", b"q")])


def test_no_tokens_in_an_empty_table(spark):
    assert bpe_chunks.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_rows_of_a_task_do_not_grow_with_its_phrases():
    """op12: every frequent prefix was a row of its own in every task that met it."""
    texts = [" ".join(f"w{i % 90} x{i % 89}" for i in range(20_000)).encode()]
    often = np.full(collocations.MAP_BITS // 8, 255, np.uint8)
    stripes = collocations.Stripes("en", 2, often, np.zeros_like(often))
    stripes.add(texts)
    rows = stripes.flushed().to_pylist()
    assert len({r["shard"] for r in rows}) == len(rows) <= collocations.SHARDS
    got = {(p, w): n for r in rows for p, ws, ns in zip(r["prefixes"], r["words"], r["counts"]) for w, n in zip(ws, ns, strict=True)}
    words = texts[0].decode().split(" ")
    want = Counter((" ".join(words[i:i + 2]), words[i + 2] if i + 2 < len(words) else None) for i in range(len(words) - 1))
    assert got == want and len({p for p, _ in got}) > 10 * len(rows)
