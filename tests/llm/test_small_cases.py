"""Brute-force comparisons and edge cases of the training-data operators on small tables."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.llm import (
    decontaminate, exact_dedup, html_text, language, near_dup, packing, pii, sharding, url_filter, warc,
)
from proofgrid.llm.common import shared_folder

LONG = "lorem ipsum dolor " * 3000
TEXTS = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "other text of its own here"), (None, "a b c d e f g"), (3, None),
         (4, ""), (5, "   \n"), (6, LONG), (7, LONG + "x"), (7, LONG + "x")]
SCHEMA = "doc_id bigint, text string, id string, rep string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def exact_rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in df.collect()),
                  key=str)


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: F.substring(F.sha2(t, 256), 1, 0)])
def test_exact_duplicates(docs, digest):
    """Also with a digest that all rows share: the full bytes decide."""
    got = exact_dedup.exact_duplicates(docs, digest=digest)
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(-1 if i is None else i)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    sizes = sorted(r.group_size for r in rows)
    assert sizes == sorted(len(groups[t or ""]) for _, t in TEXTS)
    assert sum(r.kept for r in rows) == len(groups)
    assert sorted(r.keep_id for r in rows) == sorted(max(groups[t or ""]) for _, t in TEXTS)


def test_state_over_several_micro_batches(spark, docs):
    many = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text")).repartition(5)
    got = exact_dedup.exact_duplicates(many, batch_bytes=1)
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(i, max(range(i % 7, 40, 7))) for i in range(40)}


def test_operators_on_an_empty_table(spark, empty):
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert decontaminate.find_matches(empty, items).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert sharding.place_rows(empty, limit=100).count() == 0
    lang = empty.withColumn("lang", F.lit("en"))
    assert language.identify(lang, train=F.lit(True), columns=["doc_id"]).count() == 0


def jaccard_components(texts, width, num, den):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [len(s) for s in sets], label


@pytest.mark.parametrize("width,ratio", [(3, (85, 100)), (5, (4, 5))])
def test_near_duplicates_against_all_pairs(spark, width, ratio):
    """Groups of copies with growing numbers of edits, chains, shared passages, short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = ["", "Solo", "solo", "two words", "TWO words"]
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 80, 1600]))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 15):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary) + "x"
            texts.append(" ".join(words))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(12):
        chain[rng.randrange(100)] = f"c{rng.randrange(9999)}"
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(n)]) for n in (5, 20, 20, 60, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes, label = jaccard_components(texts, width, *ratio)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           near_dup.near_duplicates(df, width=width, ratio=ratio).collect()}
    assert got == {i: (sizes[i], label[i], label[i] == i) for i in range(len(texts))}


def test_near_duplicates_edge_rows(docs):
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert [r.component_id for r in rows if r.doc_id in (6, 7)].count(7) == 2  # three of four shingles are shared
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 3), (0, 4), (0, 5)}


def test_contamination_and_query_blocks(spark):
    item = "the quick brown fox jumps over the lazy dog and then runs away from it all"
    docs = spark.createDataFrame([
        (1, "Start. " + item.upper() + " end."), (2, "fox quick brown the jumps over dog lazy"), (3, None), (4, ""),
        (5, "tiny"), (6, item + " gap " + item), (6, "no match here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, item), (11, "tiny"), (11, "tiny"), (12, ""), (13, None), (None, "gap")],
                                  "item_id bigint, text string")
    for words in (decontaminate.QUERY_WORDS, 5):
        rows = decontaminate.find_matches(docs, items, query_words=words).collect()
        got = sorted((r.doc_id, r.n_words, [tuple(h) for h in r.hits], r["items"]) for r in rows)
        n = len(item.split())
        assert got == [(1, n + 2, [(1, n + 1)], ["10"]), (2, 8, [], []), (3, 0, [], []), (4, 0, [], []),
                       (5, 1, [(0, 1)], ["11"]), (6, 3, [], []), (6, 2 * n + 1, [(0, 2 * n + 1)], ["", "10"])]


def near_by_brute_force(docs, items, width, slop, share):
    """Per document the items of which some stretch holds the share of a window's terms, without those in exact order."""
    out = []
    for _, text in docs:
        words, exact, near = decontaminate.words_of(text), set(), set()
        for item, given in items:
            asked = decontaminate.words_of(given)
            for i in range(max(1, len(asked) - width + 1) if asked else 0):
                window = asked[i:i + width]
                if any(words[a:a + len(window)] == window for a in range(len(words))):
                    exact.add(str(item))
                need = -(-share[0] * len(set(window)) // share[1])
                if any(len(set(words[a:a + slop]) & set(window)) >= need for a in range(len(words))):
                    near.add(str(item))
        out.append((sorted(exact), sorted(near - exact)))
    return out


@pytest.mark.parametrize("width,slop,share", [(13, 26, (2, 3)), (4, 6, (3, 4)), (5, 3, (1, 2)), (3, 1, (1, 3))])
def test_edited_copies_against_brute_force(spark, monkeypatch, width, slop, share):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 2, 3, 8, 13, 14, 30, 40))]
    items += [(20, "absent w1 w2 w3 w4 nowhere w5 w6 w7 w8"), (21, "w9 w9"), (22, ""), (23, None)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        copied = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(4) if copied else 0):
            copied[rng.randrange(len(copied))] = rng.choice(["new", "other", *vocabulary])
        docs.append((i, " ".join(words[:9] + copied + words[9:])))
    docs += [(60 + i, "w9") for i in range(4)] + [(64, "w1 w2 w3 w4"), (65, "w5 w6 w7 w8"), (66, None)]
    want = near_by_brute_force(docs, items, width, slop, share)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    given = spark.createDataFrame(items, "item_id bigint, text string")
    for block_words, query_words in ((200_000, decontaminate.QUERY_WORDS), (50, decontaminate.QUERY_WORDS), (200_000, 100)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
        rows = decontaminate.find_matches(frame, given, width=width, slop=slop, share=share, query_words=query_words)
        assert [(r["items"], r.near) for r in sorted(rows.collect(), key=lambda r: r.doc_id)] == want


def test_an_edited_copy_of_an_item_with_absent_terms(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog"), (2, "the quick"), (3, "fox jumps over")],
                                 "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, "the quick brown wolf jumps over a lazy dog")], "item_id bigint, text string")
    assert {r.doc_id: r.near for r in decontaminate.find_matches(docs, items).collect()} == {1: ["1"], 2: [], 3: []}


def test_packing_round_trip(spark, docs):
    tok = packing.encoder(packing.default_vocabulary(), packing.default_ranks())
    out = packing.pack(docs, size=64, keep_ids=True)
    rows = out.collect()
    assert len(rows) == sum(len(packing.cut(len(tok.encode(t or "")) + 1, 64)) for _, t in TEXTS)
    ids = sorted(sum((r.ids for r in sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)), []))
    assert ids == sorted([*tok.encode(LONG), 0])
    whole = {r.sequence_id: r.ids for r in packing.assemble(out).collect()}
    assert all(len(v) <= 64 for v in whole.values())
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_ids_are_those_of_the_vocabulary_and_its_library():
    """Also special strings, and runs that the ranks' pattern can't take."""
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_vocabulary())
    tok = packing.encoder(packing.default_vocabulary(), packing.default_ranks())
    for text in ("", " ", "It's 12,5 €\n\n\tfin  ", "Ünïcode größe ça", "x" * 300, "a <|endoftext|> b", "<|endoftext|", "." * 5000,
                 " " * 1_000_000, "a" + "\n" * 300_000 + "b", "word " * 3000 + " " * 201):
        assert tok.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_packing_takes_a_very_long_run(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a <|endoftext|> b")], "doc_id bigint, text string")
    rows = packing.pack(df, keep_ids=True).collect()
    assert [r.ids for r in rows if r.doc_id == 2] == [[64, 220, 50256, 275, 0]]


def test_language_learns_labelled_rows_only(spark):
    """A repeated id names rows without text, without a label, and of another language."""
    rows = [(1, "the cat and the dog", "en"), (1, None, None), (1, "zzz unlabelled", None), (1, "le chat et le chien", "fr"), (2, None, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(map(tuple, language.sample(df, "doc_id", "text", "lang", F.lit(True), 10).collect())) \
        == [("en", "the cat and the dog"), ("fr", "le chat et le chien")]
    got = language.identify(df, train=F.lit(True), columns=["doc_id", "text"]).collect()
    assert {r.text: r.lang_pred for r in got if r.text and "zzz" not in r.text} == {rows[0][1]: "en", rows[3][1]: "fr"}
    assert [r.lang_pred for r in got if r.text is None] == ["und", "und"]


def test_plan_is_gapless_and_tight():
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 400) for n in range(1, 50, 3)} | {100: 77}
    seen, used = defaultdict(set), defaultdict(list)
    for length, rank, number, first, offset in packing.plan_slots(histogram, 100):
        for d in range(number):
            seen[length].add(rank + d)
            used[first + d].append((offset, length))
    assert {n: set(range(c)) for n, c in histogram.items()} == seen
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 100
    assert len(used) <= -(-sum(n * c for n, c in histogram.items()) // 100) * 1.05


def test_language_of_mixed_and_missing_text(spark):
    rng = random.Random(1)
    word = {"en": lambda: rng.choice(["the", "and", "house", "water", "with", "thing"]),
            "de": lambda: rng.choice(["der", "und", "straße", "schön", "nicht", "über"]),
            "el": lambda: rng.choice(["και", "νερό", "σπίτι", "δεν"])}
    rows = [(i, " ".join(word[lang]() for _ in range(40)), lang) for i, lang in enumerate(["en", "de", "el"] * 20)]
    extra = [(100, None, None), (101, "123 !?", "en"), (102, "νερό σπίτι", None),
             (103, " ".join(["the water house and"] * 8 + ["der straße und nicht"] * 3), None)]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, train=F.col("doc_id") < 100, columns=["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert got[102].lang_pred == "el"
    assert [s.lang for s in got[103].spans] == ["en", "de"] and got[103].lang_pred == "en" and 0.5 < got[103].score < 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) \
                    or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) \
                    or kind == "phone" and 9 <= len(digits) <= 15:
                yield kind, m.start(), m.end()


def test_personal_data_against_plain_expressions():
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456", "x",
             " ", "12", "-", "+1", "é", "foo@bar", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        found = [s[:3] for s in pii.find(text) if s[0] in pii.BASE]
        assert sorted(found) == sorted(base_spans(text)), text


def test_personal_data_added_kinds_and_long_runs():
    assert [s[0] for s in pii.find("IBAN DE89 3704 0044 0532 0130 00.") if s[0] == "iban"] == ["iban"]
    assert not [s for s in pii.find("IBAN DE88 3704 0044 0532 0130 00.") if s[0] == "iban"]
    assert [s[0] for s in pii.find("Social security 123-45-6789")] == ["ssn"]
    assert pii.find("number 123-45-6789 of it") == [] and pii.find(None) == [] and pii.find("") == []
    for run in ("a" * 300_000 + "@", "1" * 300_000, "@" * 100_000, "1." * 100_000):
        pii.find(run)


def test_ibans_next_to_other_codes():
    found = lambda text: [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"]
    codes = ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "NO9386011117947",
             "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    assert found(" ".join(codes)) == codes
    for a in codes:
        for b in codes:
            for gap in (" ", "  ", ", ", "\n"):
                assert found(a + gap + b) == [a, b]
    assert found("Order RE24 IBAN DE89 3704 0044 0532 0130 00") == [codes[2]]
    assert found("DE88370400440532013000 " + codes[0]) == [codes[0]]
    for n in range(500):  # also where a head that runs into the next code passes by chance
        rest = f"{86011117000 + n}"
        first = next(c for c in (f"NO{d:02}{rest}" for d in range(2, 99)) if pii.mod97(c))
        assert found(f"{first} {codes[4]}") == [first, codes[4]]
    assert not found("x" + codes[0]) and not found(codes[0] + "x") and not found("é" + codes[0])
    for run in ("AB12 " * 60_000, "AB12" * 75_000, "A" * 300_000):
        found(run)


def test_page_blocks():
    tree = html_text.trained_tree()
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site name</header><nav><a>Home</a>"
            "</nav><div class='cookie-notice'>We use cookies on this site.</div><article><h1>Head &amp; more</h1><p>One\n two"
            "<b>bold</b><p>Three<ul><li>x</ul><aside>See also</aside><div class=comments><p>Nice one!</p></div></article>"
            "<form>Mail <input></form><footer>&copy; Us</footer></body>")
    assert html_text.main_text(page, tree) == "Head & more One twobold Three x"
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<p></p>", tree) == ""
    assert html_text.main_text("only words, and enough of them to be kept as the text of a page without any tag in it", tree).startswith("only")
    html_text.main_text("<" * 20_000 + "<a href=\"" * 2_000, tree)


@pytest.mark.parametrize("quote", "\"'")
def test_page_attributes_of_any_length(quote):
    tree = html_text.trained_tree()
    long = f"{quote}{'x > <p> ' * 12_500}{quote}"  # 100 000 characters
    body = "Enough words of a text that the page is about, so that it is kept. " * 3
    page = (f"<body><nav data-x={long} class=menu><p>{body}</nav><div data-x={long} class='ad'><p>{body}</div>"
            f"<article style={long}><p>One <img src={long} alt=y> two</article></body>")
    assert html_text.main_text(page, tree) == "One two"
    assert [b[0] for b in html_text.blocks_of(f"<p title={quote}a>one<p>it{quote * 2}s {quote}two{quote}")] == \
        ["one", f"it{quote * 2}s {quote}two{quote}"]
    assert [b[0] for b in html_text.blocks_of(f"<p {quote}>one<p>two <p class={quote}a>three")] == ["one", "two", "three"]
    assert [b[0] for b in html_text.blocks_of("<p>1 <b 2 <!-- 3")] == ["1 <b 2"]
    for part in (f"<a href={quote}", f"<a b={quote}>{quote} ", f"<a b={quote}><p>", "<!", "<a "):
        html_text.blocks_of(part * 100_000)


def test_shards_fit_and_cover(spark, docs):
    rows = sharding.place_rows(docs, limit=60_000).collect()
    assert len(rows) == len(TEXTS)
    sums = defaultdict(lambda: [0, 0])
    for r in rows:
        sums[r.shard][0] += r.n_bytes
        sums[r.shard][1] += 1
    assert all(b <= 60_000 or n == 1 for b, n in sums.values())
    assert all([r.shard_bytes, r.shard_rows] == sums[r.shard] for r in rows)
    copies = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id bigint, text string")
    pages = sharding.place_rows(copies, limit=1000).collect()
    assert len(pages) == 50 and max(r.shard_bytes for r in pages) <= 1000 and len({r.shard for r in pages}) == 5


def test_url_lists_as_of_a_day(spark):
    log = spark.createDataFrame([
        ("domain", "bad.com", "add", "block", "2024-01-10"), ("domain", "bad.com", "remove", "block", "2024-03-05"),
        ("host", "ok.bad.com", "add", "allow", "2024-01-01"), ("prefix", "ok.bad.com/x/", "add", "block", "2024-02-01"),
        ("domain", None, "add", "block", "2024-01-01")], "kind string, value string, action string, verdict string, at string")
    rows = [("http://a.bad.com/", "2024-01-09"), ("http://a.bad.com/", "2024-01-10"), ("http://A.BAD.com:80/q?x", "2024-03-04"),
            ("http://a.bad.com/", "2024-03-05"), ("http://ok.bad.com/x/y", "2024-01-20"), ("http://ok.bad.com/x/y", "2024-02-20"),
            ("http://notbad.com/", "2024-02-01"), (None, "2024-02-01"), ("no url", "2024-02-01"), ("http://a.bad.com/", None),
            ("http://a.bad.com/", "2024-01-10")]
    caps = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, day string") \
        .withColumn("fetched_on", F.to_date("day"))
    got = {r.i: r.verdict for r in url_filter.judge(caps, log).collect()}
    assert [got[i] for i in range(len(rows))] == ["none", "block", "block", "none", "allow", "block", "none", "none", "none",
                                                  "none", "block"]


@pytest.mark.parametrize("split", ["64m", "2k"])
def test_archives_with_magic_in_payloads(spark, split):
    """Fake records inside payloads are candidates, but no chain reaches them, however the files are split."""
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    payloads = [f"page {i} " + "é" * (i * 7 % 300) for i in range(60)] + [fake, "x" + fake * 40 + "y", "", None, "page 3 " + "é" * 21]
    rows = [(i, f"http://h/{i}\r\n", p, "clash") for i, p in enumerate(payloads)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, id string")
    path = shared_folder(spark, "warc-test")
    warc.write_warc(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = warc.read_warc(spark, path, {"n": lambda p: F.octet_length(p), "digest32": warc.sha1_base32,
                                               "payload": lambda p: p})
        got = {int(r.name): r for r in warc.with_referred(records, ["n", "digest32", "payload"]).withColumn(
            "name", warc.urn_id(F.col("id"), "bigint")).withColumn("to", warc.urn_id(F.col("refers_to"), "bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == set(range(len(payloads)))
    for i, p in enumerate(payloads):
        data = (p or "").encode()
        first = next(j for j, q in enumerate(payloads) if (q or "") == (p or ""))
        assert bytes(got[i].payload) == data and got[i].n == len(data)
        assert (got[i].kind, got[i].to) == (("response", None) if first == i else ("revisit", first))
        assert got[i].digest == "sha1:" + got[i].digest32
    import base64

    assert got[1].digest32 == base64.b32encode(hashlib.sha1(payloads[1].encode()).digest()).decode()


def test_archives_of_repeated_ids(spark):
    """Every payload is written once at least, every row once, and each revisit refers to its own payload."""
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "own"), (4, "own"), (4, None), (None, "a")]
    path = shared_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, html string").withColumn("url", F.lit("u")), path)
    records = warc.read_warc(spark, path, {"payload": lambda p: p})
    assert {bytes(r.payload).decode() for r in records.filter("kind = 'response'").collect()} == {p or "" for _, p in rows}
    got = warc.with_referred(records, ["payload"]).withColumn("page", warc.urn_id(F.col("id"), "bigint")).collect()
    assert sorted(((r.page, bytes(r.payload).decode()) for r in got), key=str) == sorted(((i, p or "") for i, p in rows), key=str)


@pytest.mark.parametrize("per_lang", [1, 7, 1000])
def test_language_sample_has_the_smallest_hashes(spark, per_lang):
    """Also where one language has nearly all rows and ids repeat."""
    df = spark.range(3000).select((F.col("id") % 2900).alias("doc_id"), F.when(F.col("id") % 100 == 0, "de").otherwise("en").alias("lang"),
                                  F.col("id").cast("string").alias("text"))
    got = language.sample(df, "doc_id", "text", "lang", F.lit(True), per_lang).select("text").collect()
    rows = df.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    few = {r.doc_id for lang in ("de", "en")
           for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:per_lang]}
    assert {r.text for r in got} == {r.text for r in rows if r.doc_id in few}


BODY = " ".join(["word"] * 40)


@pytest.mark.parametrize("page, want", [
    (f"<article><p>{BODY}</article><section class=comments><article class=comment-body><p>{BODY} c</article></section>", BODY),
    (f"<article><p>{BODY}</article><div class=comments><div class=post>{BODY} c</div></div>", BODY),
    (f"<nav><div class=main><p>Home of all</div></nav><article><p>{BODY}</article>", BODY),
    (f"<div class=cookie-notice>We use cookies here.</div><article><p>{BODY}</article>", BODY),
    (f"<footer>Copyright Foo Inc</footer><div><p>{BODY}</div>", BODY),
    (f"<div class='content no-sidebar'><p>{BODY}</div>", BODY),
    (f"<div class=social-history><p>{BODY}</div>", BODY),
    (f"<div title='a hidden gem'><p>{BODY}</div>", BODY),
    (f"<html><head><title>x</title><p>{BODY}", BODY),
    (f"<article class='post comments-open'><header><h1>T</h1></header><p>{BODY}</article>", f"T {BODY}"),
    (f"<article><p>{BODY}<div class=social-links>Share it now</div><div hidden>No</div><div style='display : none'>No</div></article>", BODY),
])
def test_page_places(page, want):
    assert html_text.main_text(page, html_text.trained_tree()) == want


def test_stray_end_tags_take_linear_time():
    assert html_text.blocks_of("<div>" * 50_000 + "</p>" * 50_000 + "end")[0][0] == "end"


def test_a_similar_pair_is_hidden_by_no_estimate():
    """The least share asked for keeps the exact binomial tail below the stated bound, and one value more does not."""
    for t in (0.8, 0.85):
        for k in (64, 1024):
            least = round(near_dup._lenient(t, k) * k)
            p, q = Fraction(t).limit_denominator(100), 1 - Fraction(t).limit_denominator(100)
            tail = lambda n: float(sum(math.comb(k, s) * p**s * q**(k - s) for s in range(n)))
            assert tail(least) <= near_dup.MISS < tail(least + 1)


def test_context_words_are_whole_words():
    score = lambda text: pii.find(text)[0][3]
    assert score("my card 4111 1111 1111 1111") == score("Kreditkarte: 4111 1111 1111 1111") == 1.0
    assert score("discard 4111 1111 1111 1111") == score("discard" + " " * 36 + "4111 1111 1111 1111") == 0.8
    assert score("tel +49 30 123456789") > score("hotel +49 30 123456789")


def test_few_candidates_are_counted(spark, monkeypatch):
    """op9: every place of a window's rarer terms was counted word by word, and every word of a text was an object."""
    rng = random.Random(4)
    vocabulary = [f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(4000)]
    items = [(str(i), " ".join(vocabulary[i * 30:i * 30 + 30])) for i in range(20)]
    texts = [" ".join(rng.choices(vocabulary, k=600)) for _ in range(8)]
    texts += [items[3][1], items[5][1].replace(" w", " x w", 4), "", "É" + items[7][1].upper() + "\n" + "y" * 3000]
    counted = []
    whole = decontaminate._Asked._counted

    def seen(self, around, place, window, slop):
        counted.append(len(place))
        return whole(self, around, place, window, slop)

    monkeypatch.setattr(decontaminate._Asked, "_counted", seen)
    windows = decontaminate._windows(items, 13)
    words = [w for t in texts for w in [*decontaminate.words_of(t), *[b"|"] * 26]]
    found = [[data[i:j] for data, starts, ends, of, _ in decontaminate._pieces([t.encode()]) for i, j in zip(starts, ends)] for t in texts]
    assert found == [decontaminate.words_of(t) for t in texts]
    places = {}
    for at, w in enumerate(words):
        if any(w in window for window in windows):
            places.setdefault(w, []).append(at)
    asked = decontaminate._Asked(windows, {w: len(at) for w, at in places.items()}, (2, 3))
    lengths = [len(decontaminate.words_of(t)) for t in texts]
    starts = np.cumsum([0, *[n + 26 for n in lengths[:-1]]])
    _, phrase, near = asked.answer(starts, np.array(lengths), list(places), np.array([len(at) for at in places.values()]),
                                   np.concatenate([np.array(at) for at in places.values()]), 26)
    want = near_by_brute_force(list(enumerate(texts)), items, 13, 26, (2, 3))
    assert [(sorted(phrase[d]), sorted(near[d] - phrase[d])) for d in range(len(texts))] == want
    pairs = sum(len(at) * int(asked.keys.count[asked.number[w]]) for w, at in places.items())
    assert sum(counted) * 10 < pairs
