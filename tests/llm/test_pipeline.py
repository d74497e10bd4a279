"""The pipeline's stages one after the other, against what each must keep."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from proofgrid.llm.common import shared_folder
from proofgrid.llm.queries import load

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_must(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    extra = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "...", None, None, 3)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == columns
            counts.append(docs.count())
            if name == "language_id":
                assert docs.filter(F.col("doc_id") >= 10**9).count() == 0
            if name == "exact_dedup":
                assert docs.count() == docs.select("text").distinct().count()
    assert counts == sorted(counts, reverse=True)
    assert docs.filter("offset + length > 2048").count() == 0


def test_dropping_stages_against_brute_force_with_repeated_ids(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    asked, base, other = prose(20), prose(200), prose(150)
    rows = [(1, base), (1, [*base[:100], "new", *base[101:]]), (1, other), (2, [*base[:-1], "end"]), (2, prose(60)),
            (3, [*prose(10), *asked, *prose(10)]), (3, prose(40)), (3, [*prose(999), *asked[:13]]), (4, other), (4, prose(9)),
            (None, [*other, "more"]), (None, prose(30)), (5, asked), (6, [])]
    docs = [(i, " ".join(words), "en", "s", len(words)) for i, words in rows]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([(1, " ".join(asked))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, given):
        return sorted((tuple(r)[:2] for r in stage(spark, spark.createDataFrame(given, schema), str(tmp_path)).collect()), key=str)

    def pieces(text, n):
        words = text.split()
        return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    # one row per component of near copies stays: the least id, null first
    left, kept = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)), []
    while left:
        group, rest = [left[0]], left[1:]
        for member in group:
            a = pieces(member[1], 5)
            near = [r for r in rest if a and 5 * len(a & pieces(r[1], 5)) >= 4 * len(a | pieces(r[1], 5))]
            rest = [r for r in rest if r not in near]
            group.extend(near)
        kept.append(group[0][0])
        left = rest
    got = run(corpus_pipeline.near_dedup_stage, docs)
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in got) and len(kept) < len(docs)
    # exactly the rows of which windows cover a twentieth go
    window = pieces(" ".join(asked), 13)

    def clean(text):
        words, hit = text.split(), set()
        for i in range(len(words) - 12):
            if tuple(words[i:i + 13]) in window:
                hit.update(range(i, i + 13))
        return not hit or 20 * len(hit) < len(words)

    want = sorted((r[:2] for r in docs if clean(r[1])), key=str)
    assert run(corpus_pipeline.decontamination_stage, docs) == want and len(want) == len(docs) - 2


def test_every_dealt_query_is_registered():
    names = load()[0]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in names
