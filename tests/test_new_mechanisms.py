"""Forests and poses by rounds, wavefronts, order statistics, interval slices, and the sinks that commit last."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.operators import drawings, graph, ranking
from proofgrid.operators import scenes as sc
from proofgrid.sources import stores


def matrix(angle, scale, x, y, z):
    c, s = scale * math.cos(angle), scale * math.sin(angle)
    return [c, -s, 0.0, x, s, c, 0.0, y, 0.0, 0.0, scale, z, 0.0, 0.0, 0.0, 1.0]


def product(a, b):
    return [sum(a[4 * i + k] * b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)]


def test_poses_of_a_long_chain_and_a_star(spark):
    """5 000 frames one behind the other; a star that its anchor is no hub of; an anchor without an edge."""
    rng = random.Random(1)
    edges, want = [], {("chain", 0): matrix(0, 1, 0, 0, 0)}
    for i in range(4999):
        m = matrix(rng.uniform(-1, 1), rng.uniform(0.99, 1.01), rng.uniform(-1, 1), 0.5, 0.1)
        edges.append(("chain", i, i + 1, m))
        want["chain", i + 1] = product(want["chain", i], m)
    for i in range(1, 40):
        edges.append(("star", 0, i, matrix(0.0, 2.0, float(i), 0.0, 0.0)))
    df = spark.createDataFrame(edges, "scene string, a int, b int, m array<double>").repartition(4)
    anchors = spark.createDataFrame([("chain", 0), ("star", 7), ("alone", 3)], "scene string, anchor int")
    got = {(r.scene, r.vertex): r.pose for r in graph.compose_poses(df, anchors, group=["scene"], a="a", b="b", transform="m").collect()}
    assert len(got) == 5000 + 40 + 1 and got["alone", 3] == matrix(0, 1, 0, 0, 0)
    assert got["star", 7] == pytest.approx(matrix(0, 1, 0, 0, 0))
    assert got["star", 9] == pytest.approx(matrix(0, 1, 1, 0, 0))  # into the hub by 2x + 9, out of it by (x - 7) / 2
    for key, pose in want.items():
        assert got[key] == pytest.approx(pose, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("limit", [0, 60, 10**6])
def test_poses_of_small_and_large_trees_agree(spark, monkeypatch, limit):
    """F8: every tree went through rounds of joins; null and repeated anchors, null groups and several trees a group."""
    rng = random.Random(8)
    edges, arcs = [], {}
    for g in (1, 2, None):
        for i in range(1, 50 if g == 1 else 90):
            if i % 30:  # the next tree begins there
                a, b = (i - 1 if g == 1 else rng.randrange(i - i % 30, i)), i
                a, b = (a, b) if rng.random() < 0.5 else (b, a)
                m = matrix(rng.uniform(-3, 3), rng.uniform(0.8, 1.2), rng.uniform(-1, 1), 0.5, 0.1)
                edges.append((g, a or None, b or None, m))
                arcs.setdefault((g, a), []).append((b, m))
                inverse = np.linalg.inv(np.array(m).reshape(4, 4)).reshape(-1).tolist()
                arcs.setdefault((g, b), []).append((a, inverse))
    anchors = [(1, 7), (1, 7), (1, 40), (2, 0), (None, 65), (4, 1)]
    want = []
    for g, start in anchors:
        todo = [(start, None, matrix(0, 1, 0, 0, 0))]
        while todo:
            v, came, pose = todo.pop()
            want.append((g, v, pose))
            todo += [(w, v, product(pose, m)) for w, m in arcs.get((g, v), []) if w != came]
    monkeypatch.setattr(graph, "POSES_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 30)
    monkeypatch.setattr(graph, "MATRICES_AT_ONCE", 7)
    if limit == 10**6:
        monkeypatch.setattr(graph, "_rooted_with", None)  # small trees need no rounds
    df = spark.createDataFrame(edges, "g int, a int, b int, m array<double>").repartition(3)
    starts = spark.createDataFrame([(g, v or None) for g, v in anchors], "g int, anchor int")
    got = [(r.g, r.vertex or 0, r.pose) for r in graph.compose_poses(df, starts, group=["g"], a="a", b="b", transform="m").collect()]
    key = lambda r: (r[0] or 0, r[1], [round(x, 6) + 0.0 for x in r[2]])
    assert [key(r) for r in sorted(got, key=key)] == [(g, v, pytest.approx(p, abs=1e-5)) for g, v, p in sorted(map(key, want))]


def test_forest_and_its_components(spark):
    rng = random.Random(4)
    edges = [(g, a, b, rng.random(), f"{a}-{b}") for g in (1, 2) for a in range(40) for b in range(a + 1, 40)
             if rng.random() < 0.05 and (a < 25) == (b < 25)]
    df = spark.createDataFrame(edges, "g int, a int, b int, w double, pos string")
    forest, labels = graph.forest_and_labels(df, group=["g"], a="a", b="b", order=[F.col("w"), F.col("pos")], edge_id="pos")
    top = {}

    def find(v):
        while top.get(v, v) != v:
            v = top[v]
        return v

    want = set()
    for g, a, b, w, pos in sorted(edges, key=lambda e: (e[0], e[3], e[4])):
        x, y = find((g, a)), find((g, b))
        if x != y:
            top[max(x, y)] = min(x, y)
            want.add((g, pos))
    assert {(r.g, r.pos) for r in forest.collect()} == want
    assert {(r.g, r.vertex): r.component for r in labels.collect()} == {v: find(v)[1] for e in edges for v in ((e[0], e[1]), (e[0], e[2]))}


def test_wavefronts_meet_round_walls(spark):
    """A wall with one gap; a seed in a closed room; two seeds on one cell."""
    walls = {(4, y) for y in range(9) if y != 8} | {(x, 6) for x in (7, 8)} | {(7, 7), (7, 8)}
    cells = [(1, x, y) for x in range(9) for y in range(9) if (x, y) not in walls]
    seeds = [(1, "a", 0, 0), (1, "b", 8, 0), (1, "c", 8, 8), (1, "d", 0, 0)]
    got = graph.meeting_distances(spark.createDataFrame(cells, "g int, x int, y int"), spark.createDataFrame(seeds, "g int, s string, x int, y int"),
                                  group=["g"], seed="s", x="x", y="y").collect()
    assert {(r.a, r.b): r.steps for r in got} == {("a", "b"): 24, ("a", "d"): 0, ("b", "d"): 24}


@pytest.mark.parametrize("values", [[i / 1e6 for i in range(3000)], [1e-9, 5.0, 1e12, -3.0, 2.0], [7.0] * 9, [float("-inf"), 1.0, 2.0, float("inf")]])
def test_order_statistics_wherever_the_values_lie(spark, values):
    """One key of very small values splits as well as any other."""
    df = spark.createDataFrame([(k, v) for k in ("x", None) for v in values], "k string, v double")
    s, n = sorted(values), len(values)
    for p in (0.0, 0.5, 0.995):
        at = (n - 1) * p
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
        assert [r.q for r in ranking.exact_quantile(df, ["k"], "v", p, "q").collect()] == pytest.approx([want, want], nan_ok=True)
    assert [r.m for r in ranking.upper_median(df, ["k"], "v", "m").collect()] == [s[n // 2]] * 2


def test_large_whole_numbers_keep_apart(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(9)], "v bigint").withColumn("k", F.lit(1))
    assert ranking.upper_median(df, ["k"], "v", "m").first().m == 2**60 + 4


def test_intervals_of_one_long_key_are_merged_over_slices(spark):
    rng = random.Random(7)
    rows = [(1, x := rng.randrange(20_000), x + rng.randrange(4)) for _ in range(3000)] + [(1, 5, 900)] * 3 + [(None, 0, 1), (None, 2, 3)]
    got = drawings.merge_intervals(spark.createDataFrame(rows, "k int, s int, e int").repartition(8), keys=["k"], start="s", end="e", gap=1)
    want, reach = [], None
    for s, e in sorted((s, e) for k, s, e in rows if k == 1):
        if reach is None or s > reach + 1:
            want.append([s, e, 1])
        else:
            want[-1][1:] = [max(want[-1][1], e), want[-1][2] + 1]
        reach = e if reach is None else max(reach, e)
    found = got.collect()
    assert sorted((r.s, r.e, r.members) for r in found if r.k == 1) == sorted(map(tuple, want))
    assert [(r.s, r.e, r.members) for r in found if r.k is None] == [(0, 3, 2)]


def test_a_batch_that_comes_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "id string, case_id string, created_at timestamp"
    events = spark.sql("select cast(id as string) id, 'c' case_id, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) created_at from range(10)")
    for batch, part in ((0, events.filter("id < 6")), (1, events), (1, events), (0, events.filter("id < 6"))):
        stores.append_events(part, path, batch)
    got = stores.replay_events(spark, path, spark.createDataFrame([], schema).schema).collect()
    assert sorted((r.position, r.id) for r in got) == [(i + 1, str(i)) for i in range(10)]
    tail = stores.replay_then_tail(spark, path, spark.createDataFrame([], schema).schema)
    q = tail.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tail").count() == 10


def test_attempts_without_a_manifest_are_not_read(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    made = spark.sql("select id % 3 as case_id, concat('{\"n\":', id, '}') as document from range(9)")
    stores.write_manifests(made, path, "a")
    made.select(F.col("case_id").alias("case_key"), F.lit("half").alias("document"), F.lit(0).alias("shard")) \
        .write.partitionBy("shard").json(f"{path}/documents/attempt=b")
    got = stores.read_manifests(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect()))
    # a document that is lost after the commit takes its case with it
    kept = made.filter("case_id <> 1 or document <> '{\"n\":4}'")
    kept.select(F.col("case_id").alias("case_key"), "document", F.lit(0).alias("shard")).write.mode("overwrite") \
        .partitionBy("shard").json(f"{path}/documents/attempt=a")
    assert {r.case_key for r in stores.read_manifests(spark, path).collect()} == {0, 2}


def test_files_are_ingested_by_their_bytes(spark, tmp_path):
    import hashlib

    for name, raw in (("a.JPG", b"\xff\xd8\x00"), ("b.bin", b"\x00"), ("empty.txt", b""), ("c.pdf", b"%PDF" * 1000)):
        (tmp_path / name).write_bytes(raw)
    got = {r.name: r for r in stores.ingest_files(spark, str(tmp_path)).collect()}
    assert {n: (r.sha256, r.byte_size, r.media_type) for n, r in got.items()} == {
        "a.JPG": (hashlib.sha256(b"\xff\xd8\x00").hexdigest(), 3, "image/jpeg"),
        "b.bin": (hashlib.sha256(b"\x00").hexdigest(), 1, "application/octet-stream"),
        "c.pdf": (hashlib.sha256(b"%PDF" * 1000).hexdigest(), 4000, "application/pdf")}
    assert sorted(r.arrival for r in got.values()) == [1, 2, 3]


def test_hulls_of_many_groups_equal_one_by_one(spark):
    """Groups that cross batches, one large group, groups without an area, null keys and null places."""
    rng = np.random.default_rng(7)
    rows = [(int(k), float(x), float(y)) for k, x, y in zip(rng.integers(0, 300, 4000), rng.integers(0, 30, 4000), rng.integers(0, 30, 4000))]
    rows += [(None, float(x), float(y)) for x, y in rng.normal(size=(9000, 2)) * 100]
    rows += [(1001, 3.0, 1.0), (1001, 3.0, 9.0), (1001, 3.0, 5.0), (1002, 1.0, 1.0), (1003, None, 4.0), (1003, 2.0, None), (1003, 5.0, 1.0)]
    points = spark.createDataFrame(rows, "k int, x double, y double").selectExpr("*", "1.0d as w", "1.0d as h")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.k: r.hull_coverage for r in sc.match_spread(points, keys=["k"], x="x", y="y", width="w", height="h").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == len({k for k, *_ in rows})
    for key in [*range(300), None, 1001, 1002]:
        x, y = np.array([(a, b) for k, a, b in rows if k == key]).T
        assert got[key] == pytest.approx(sc.ring_area(sc.hull_ring(x, y)) if len(x) > 2 else 0.0)
    assert got[1001] == got[1002] == got[1003] == 0.0


def test_many_small_files_are_written_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """a task read one small file, files were read twice, and the driver moved them one by one."""
    monkeypatch.setattr(stores, "FILES_A_TASK", 20)
    rows = [(f"n{i % 90}", f"line {i}") for i in range(100)] + [(None, "none")]
    text = spark.createDataFrame(rows, "name string, value string")
    path, before = str(tmp_path / "files"), [spark.conf.get(k) for k in stores.SMALL_FILES]
    stores.write_files(text, path, name="name")
    found = stores.ingest_files(spark, path, "part-*")
    assert [spark.conf.get(k) for k in stores.SMALL_FILES] == before
    assert found.rdd.getNumPartitions() <= 8 and "binaryfile" not in found._jdf.queryExecution().toString().lower()
    got = {r.path.split("name=")[1].split("/")[0]: r.byte_size for r in found.collect()}
    want = {}
    for name, value in rows:
        key = name or "__HIVE_DEFAULT_PARTITION__"
        want[key] = want.get(key, 0) + len(value) + 1
    assert got == want
