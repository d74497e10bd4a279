"""Ranking, order statistics and graph primitives against brute force on skewed fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.operators import graph
from proofgrid.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows."""
    rng = random.Random(7)
    rows = [("hot" if i % 2 == 0 else f"k{i % 7}", i, rng.choice([0.5, 1.25, -3.0, rng.random() * 100]), rng.random() + 0.1)
            for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, i long, v double, w double").repartition(5)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("sliced", [False, True])
def test_number_rows_and_running_sum(skewed, sliced):
    rows, df = skewed
    by = F.floor(F.col("i") / 50) if sliced else None
    got = {(r.k, r.i): r["rank"] for r in rk.number_rows(df, ["k"], [F.col("i")], "rank", by).collect()}
    run = {(r.k, r.i): r.s for r in rk.running_sum(df, ["k"], [F.col("i")], F.col("w"), "s", by).collect()}
    for k, g in groups(rows).items():
        total = 0.0
        for n, r in enumerate(sorted(g, key=lambda r: r[1]), 1):
            total += r[3]
            assert got[(k, r[1])] == n
            assert run[(k, r[1])] == pytest.approx(total)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.995, 1.0])
def test_exact_quantile(skewed, p):
    rows, df = skewed
    got = {r.k: r.q for r in rk.exact_quantile(df, ["k"], "v", p, "q").collect()}
    for k, g in groups(rows).items():
        assert got[k] == pytest.approx(float(np.quantile([r[2] for r in g], p)))


def test_medians(skewed):
    rows, df = skewed
    upper = {r.k: r.m for r in rk.upper_median(df, ["k"], "v", "m").collect()}
    weighted = {r.k: r.m for r in rk.weighted_median(df, ["k"], "v", F.col("w"), "m").collect()}
    for k, g in groups(rows).items():
        vs = sorted(r[2] for r in g)
        assert upper[k] == vs[len(vs) // 2]
        total, run = sum(r[3] for r in g), 0.0
        want = None
        for v, w in sorted((r[2], r[3]) for r in g):
            run += w
            if run >= total / 2:
                want = v
                break
        assert weighted[k] == want


def test_even_sample(skewed):
    rows, df = skewed
    got = {}
    for r in rk.even_sample(df, ["k"], [F.col("i")], 13, slice_by=F.floor(F.col("i") / 40)).collect():
        got.setdefault(r.k, []).append(r.i)
    for k, g in groups(rows).items():
        ordered = sorted(r[1] for r in g)
        want = [ordered[j] for j in np.linspace(0, len(ordered) - 1, 13, dtype=int)] if len(ordered) > 13 else ordered
        assert sorted(got[k]) == want


def brute_components(edges):
    label = {v: v for e in edges for v in e[:2]}
    changed = True
    while changed:
        changed = False
        for a, b, *_ in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_forest(edges):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    kept = set()
    for a, b, w, i in sorted(edges, key=lambda e: (-e[2], e[3])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            kept.add(i)
    return kept


def test_components_and_forest(spark):
    """The join rounds must agree with brute force."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.25, 0.5, 0.75]), i) for i in range(45)]
    edges = [(a, b, w, i) for a, b, w, i in edges if a != b] + [(100 + i, 101 + i, 0.5, 1000 + i) for i in range(25)]
    rows = [(s, *e) for s in ("s1", "s2") for e in edges]
    df = spark.createDataFrame(rows, "s string, a long, b long, w double, id long")
    label = brute_components(edges)
    got = graph.connected_components(df, group=["s"], a="a", b="b").collect()
    assert len(got) == 2 * len(label)
    assert all(r.component == label[r.vertex] for r in got)
    tree = graph.spanning_forest(df, group=["s"], a="a", b="b", order=[-F.col("w"), F.col("id")], edge_id="id")
    kept = brute_forest(edges)
    assert sorted((r.s, r.id) for r in tree.collect()) == sorted((s, i) for s in ("s1", "s2") for i in kept)


def test_walk_distances(spark):
    grid = ["..#..", ".##..", "....#", "#.#.."]
    cells = [("g", x, y) for y, row in enumerate(grid) for x, c in enumerate(row) if c == "."]
    df = spark.createDataFrame(cells, "g string, x int, y int")
    seed = spark.createDataFrame([("g", 0, 0)], "g string, x int, y int")
    got = {(r.x, r.y): r.steps for r in graph.walk_distances(df, seed, group=["g"], x="x", y="y").collect()}
    want, edge = {(0, 0): 0}, [(0, 0)]
    passable = {(x, y) for _, x, y in cells}
    while edge:
        edge = [c for x, y in edge for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in passable
                and c not in want and not want.update({c: want[(x, y)] + 1})]
    assert got == want


def test_partition_count_does_not_matter(spark, skewed):
    rows, df = skewed
    results = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = rk.exact_median(df, ["k"], "v", "m")
        results.append(sorted((r.k, round(r.m, 9)) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
    assert all(math.isfinite(m) for _, m in results[0])
