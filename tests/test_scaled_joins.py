"""Joins by cells, pyramids and components beside brute force, on rows made here."""

from __future__ import annotations

import io
import math
import os
import random
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofgrid import session
from proofgrid.operators import address, cells, drawings, graph, points, posegraph, ranking, scenes
from proofgrid.plans import scenes as scene_plans
from proofgrid.plans.registry import Tables


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def cloud(n, seed, spread):
    rng = random.Random(seed)
    return [(i % 2, i, *[rng.choice([-1, 1]) * round(rng.random() * spread, 3) for _ in range(3)]) for i in range(n)]


@pytest.mark.parametrize("dense", [2, 10_000])
def test_near_rows_give_every_pair_in_reach_once(spark, monkeypatch, dense):
    monkeypatch.setattr(cells, "DENSE_ROWS", dense)
    rows = cloud(120, 1, 9.0)
    left = spark.createDataFrame(rows, "g int, i int, x double, y double, z double")
    right = left.toDF("g", "j", "u", "v", "w")
    near = cells.near_rows(left, right, keys=["g"], at=["x", "y", "z"], to=["u", "v", "w"], reach=1.5)
    got = sorted((r.i, r.j) for r in near.filter("sqrt((x-u)*(x-u) + (y-v)*(y-v) + (z-w)*(z-w)) <= 1.5").collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 1.5)


def test_near_pairs_are_not_broadcast(spark):
    """the exploded side was planned by the size of its unexploded rows."""
    p = spark.createDataFrame(cloud(40, 2, 30.0), "g int, i int, px double, py double, pz double")
    assert "BroadcastHashJoin" not in plan_of(scenes.near_pairs(p, keys=["g"], item="i", xyz=("px", "py", "pz"), reach=12.0))


def test_lifted_pixels_are_not_broadcast_and_keep_ring_order(spark):
    """81 rows a pixel were broadcast."""
    px = spark.createDataFrame([(1, 1, 10.5, 17.5), (1, 2, 40.0, 40.0), (2, 3, 0.0, 0.0)], "g int, n int, x double, y double")
    depth = spark.createDataFrame([(1, 14, 18, 1.0, 1.0, 9.0), (1, 12, 18, 2.0, 2.0, 5.0), (1, 15, 18, 3.0, 3.0, 1.0), (2, 0, 4, 4.0, 4.0, 4.0)],
                                  "g int, u int, v int, x double, y double, z double")
    out = points.lift_pixels(px.withColumnsRenamed({"x": "a", "y": "b"}), depth, keys=["g"], pixel=["n"], px="a", py="b")
    assert "BroadcastHashJoin" not in plan_of(out)
    assert sorted((r.n, r.z) for r in out.collect()) == [(1, 5.0), (3, 4.0)]


def test_box_hits_are_not_broadcast(spark):
    """with the boxes broadcast, the points of a small file were one task."""
    p = spark.createDataFrame([(1, 5.0, 5.0)], "g int, x double, y double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 9.0)], "g int, l double, t double, r double, b double")
    hits = drawings.box_hits(p, b, keys=["g"], x="x", y="y", box=("l", "t", "r", "b"))
    assert "BroadcastHashJoin" not in plan_of(hits) and hits.count() == 1


def test_connected_segments_stop_at_the_first_near_one(spark):
    """F07 (F2): a semi-join, so pairs of a crowded cell are not all made."""
    rows = [(1, "a", 0.0, 0.0, 40.0, 0.0), (1, "b", 45.0, 0.0, 60.0, 0.0), (1, "c", 500.0, 500.0, 510.0, 500.0), (1, "d", 0.0, 300.0, 400.0, 300.0),
            (2, "e", 0.0, 0.0, 40.0, 0.0), (2, "e", 0.0, 0.0, 40.0, 0.0)]
    s = spark.createDataFrame(rows, "g int, s string, x1 double, y1 double, x2 double, y2 double").withColumns({"w": F.lit(1000), "h": F.lit(800)})
    out = drawings.connected_segments(s, keys=["g"], seg="s", width="w", height="h")
    assert "LeftSemi" in plan_of(out)
    assert sorted(r.s for r in out.collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_components_of_small_and_large_graphs_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "EDGES_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 30)
    rng = random.Random(3)
    rows = [(g, f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for g in (1, 2, None) for _ in range(35 if g == 1 else 50)]
    rows += [(3, None, "x"), (3, "x", "y"), (3, "z", "z"), (4, "é", "z")]
    got = {(r.g, r.vertex): r.component for r in graph.connected_components(
        spark.createDataFrame(rows, "g int, a string, b string"), group=["g"], a="a", b="b").collect()}
    want = {}
    for g in (1, 2, None, 3, 4):
        top = {}
        edges = [(a, b) for h, a, b in rows if h == g and a != b]
        for v in {v for e in edges for v in e}:
            top[v] = {v}
        for a, b in edges:
            both = top[a] | top[b]
            for v in both:
                top[v] = both
        want |= {(g, v): min(c, key=lambda x: (x is not None, x or "")) for v, c in top.items()}
    assert got == want


@pytest.mark.parametrize("others", [True, False])
def test_nearest_distance_goes_down_a_pyramid(spark, monkeypatch, others):
    """repeated and crowded positions; a query met all targets around it before."""
    monkeypatch.setattr(points, "LOOKED_UP", 2)
    rows = cloud(90, 4, 50.0) + [(0, 900 + i, 1.0, 1.0, 0.0) for i in range(30)] + [(1, 990, 1e-9, 0.0, 0.0), (1, 991, 2e-9, 0.0, 0.0), (5, 1, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "g int, t int, px double, py double, pz double")
    asked = rows if others else [(i % 2, 5000 + i, *[v * 3 for v in r[2:]]) for i, r in enumerate(rows)]
    q = spark.createDataFrame(asked, "g int, q int, px double, py double, pz double")
    got = {(r.g, r.q): r.d for r in points.nearest_distance(q, t, keys=["g"], query="q", target="t", out="d", others_only=others).collect()}
    want = {}
    for a in asked:
        near = [math.dist(a[2:], b[2:]) for b in rows if a[0] == b[0] and not (others and a[1] == b[1])]
        if near:
            want[a[0], a[1]] = pytest.approx(min(near), abs=1e-12)
    assert got == want


def test_point_blocks_of_a_batch_equal_those_of_each_edge():
    """one call per edge before; runs of many edges are one call now."""
    rng = np.random.default_rng(5)
    rows = pd.DataFrame(rng.normal(size=(9, 6)), columns=["ax", "ay", "az", "bx", "by", "bz"])
    rows = rows.assign(ta=[np.full(7, 0.1 * (i // 3)) for i in range(9)], tb=[np.full(7, 0.2)] * 9, point_weight=1.5, confidence=0.5,
                       points=3, unit=0.5)
    starts = np.array([0, 3, 6])
    whole = posegraph._point_blocks(rows, starts)
    single = np.concatenate([posegraph._point_blocks(rows.iloc[i:i + 3].reset_index(drop=True), np.array([0])) for i in starts])
    assert whole.shape == (3, posegraph.CELLS) and np.allclose(whole, single)


def test_colour_gains_search_all_channels_at_once(spark, monkeypatch):
    """one search of the medians per channel before."""
    asked = []
    monkeypatch.setattr(points, "exact_median", lambda *a: asked.append(a) or ranking.exact_median(*a))
    s = spark.createDataFrame([(1, 1, 2, 0.5, 0.4, 0.3, 0.45 + i / 1000, 0.4, 0.35) for i in range(15)],
                              "s int, a int, b int, r1 double, g1 double, b1 double, r2 double, g2 double, b2 double")
    e = spark.createDataFrame([(1, 1, 2, 0.9)], "s int, a int, b int, c double")
    got = {r.frame: r for r in points.colour_gains(s, e, scene="s", a="a", b="b", confidence="c").collect()}
    assert len(asked) == 1 and len(got) == 2 and sum(r.anchor for r in got.values()) == 1
    free = got[2]
    assert free.gain_r > 1 and free.gain_g == 1 and free.gain_b < 1


def test_strongest_component_reads_its_edges_once(spark, monkeypatch):
    """edges were made anew for the vertices, the labels and the weights; large graphs kept all edges in all rounds."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", 3)
    calls = spark.sparkContext.accumulator(0)

    def made(a):
        calls.add(1)
        return a

    rows = [(g, i, i + 1, 0.5) for g in (1, 2) for i in range(0, 40 * g) if i % 40 != 25] + [(3, 7, 8, 0.25), (3, 4, 5, 0.75), (None, 1, 2, 1.0)]
    edges = spark.createDataFrame(rows, "g int, a int, b int, w double").withColumn("a", F.udf(made, "int")("a"))
    ends = spark.createDataFrame([(r[0], v) for r in rows for v in r[1:3]] + [(3, 99)], "g int, vertex int")
    best = scenes.strongest_component(edges, ends, group=["g"], a="a", b="b", weight="w")
    got = sorted((r.g, r.vertex, r.component, r.size, r.weight) for r in best.collect())
    assert got == [(1, v, 0, 26, 12.5) for v in range(26)] + [(2, v, 26, 40, 19.5) for v in range(26, 66)] + [(3, 4, 4, 2, 0.75), (3, 5, 4, 2, 0.75)]
    assert calls.value == len(rows)
    groups = scenes.coverage_groups(edges, ends.distinct(), group=["g"], a="a", b="b", weight="w")
    ranks = {(r.g, r.component): (r.size, r.group_rank) for r in groups.filter("g = 3").collect()}
    assert ranks == {(3, 4): (2, 1), (3, 7): (2, 2), (3, 99): (1, 3)}


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_forests_of_small_and_large_graphs_agree(spark, monkeypatch, limit):
    """Every graph went through rounds of joins."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 30)
    if limit == 10**6:  # failed before: even small graphs came to the rounds
        monkeypatch.setattr(graph, "forest_by_rounds", None)
    rng = random.Random(11)
    rows = [(g, f"v{rng.randrange(25):02d}", f"v{rng.randrange(25):02d}", rng.randrange(4) / 4) for g in (1, 2, None) for _ in range(35 if g == 1 else 50)]
    rows = [(*r, f"e{i:03d}", i) for i, r in enumerate([*rows, (3, None, "x", 1.0), (3, "x", "y", 0.5), (3, "z", "z", 0.5), (3, None, "y", 0.25)])]
    df = spark.createDataFrame(rows, "g int, a string, b string, w double, id string, n int")
    forest, labels = graph.forest_and_labels(df, group=["g"], a="a", b="b", order=[-F.col("w"), F.col("id")], edge_id="id")
    edges, names = [], {}
    for g in (1, 2, 3, None):
        top = {}
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[4])):
            one, two = top.get(r[1], {r[1]}), top.get(r[2], {r[2]})
            if r[1] == r[2] or one is two:
                continue
            edges += [r] if g is not None else []  # a graph without a name keeps no edges
            both = one | two
            for v in both:
                top[v] = both
        names |= {(g, v): min(c, key=lambda x: (x is not None, x or "")) for v, c in top.items()}
    assert sorted(map(tuple, forest.select(df.columns).collect()), key=lambda r: r[5]) == sorted(edges, key=lambda r: r[5])
    assert {(r.g, r.vertex): r.component for r in labels.collect()} == names


def test_votes_are_projected_once_per_pair(spark):
    """The projection was copied into the join's condition, in code too large to be compiled."""
    rng = random.Random(5)
    rows = [(s, f, f"p{i}", rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.0, -1.0, rng.uniform(1, 4)]))
            for s in (1, 2) for f in range(3) for i in range(60)] + [(1, 0, "p0", 0.1, 0.1, 2.0), (None, 0, "n", 0.0, 0.0, 2.0), (1, 1, None, 0.0, 0.0, 1.5)]
    world = spark.createDataFrame(rows, "scene int, frame int, idx string, x double, y double, z double")
    moved = [(s, f, [1.0, 0.0, 0.0, f * 0.2, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 8.0, 16, 16) for s in (1, 2) for f in range(3)]
    cameras = spark.createDataFrame(moved, "scene int, frame int, t array<double>, f double, w int, h int")
    depth = {(s, f, u, v): rng.uniform(1, 4) for s in (1, 2) for f in range(3) for u in range(16) for v in range(16) if rng.random() < 0.7}
    buffer = spark.createDataFrame([(*k, z) for k, z in depth.items()], "scene int, frame int, u int, v int, z double")
    out = points.cross_view_votes(world, cameras, buffer, scene="scene", frame="frame", idx="idx", transform="t", focal="f", width="w", height="h")
    assert not [line for line in plan_of(out).splitlines() if line.startswith("Join condition") and "rint" in line]
    want = {}
    for s, f, i, x, y, z in rows:
        n = want.setdefault((s, f, i), [0, 0, 0])
        for g in range(3) if s else ():
            if g == f or z <= points.MIN_DEPTH:
                continue
            seen = depth.get((s, g, round((x - g * 0.2) / z * 8 + 8), round(y / z * 8 + 8)))
            if seen is not None:
                tol = max(0.08, seen * 0.06)
                n[0] += 1
                n[1] += abs(z - seen) <= tol
                n[2] += z < seen - tol
    assert {(r.scene, r.frame, r.idx): [r.observed, r.supported, r.contradicted] for r in out.collect()} == want


def test_requests_are_parsed_before_candidates_multiply_them(spark):
    """the address was parsed anew for every candidate and every part of it."""
    rows = [(1, 1, "12 Oak Street, Rome, NY 10001", "12", "10001", "NY"), (1, 2, "12 Oak Street, Rome, NY 10001", None, "", "ny"),
            (2, 1, "012b Elm Lane, CA", "12B", None, "NY"), (2, 2, "012b Elm Lane, CA", "12b", "99999-1", None), (3, 1, None, "1", "10001", "CA"),
            (None, 1, "Harbor Tower, 5 Elm Lane", "6", None, None)]
    df = spark.createDataFrame(rows, "r int, n int, address string, house string, zip string, state string")
    df = df.withColumn("wanted", address.address_parts(F.col("address")))
    got = [address.exact_match(df, request="r", address=c, pos="n", house="house", zip_code="zip", state="state") for c in ("address", "wanted")]
    found = [sorted((r.r, r.n) for r in g.select("r", "n").collect()) for g in got]
    assert found[0] == found[1] == [(1, 1), (2, 2), (3, 1)]
    parsed = spark.createDataFrame(got[1].rdd, got[1].schema).select(df.columns)  # nothing left to inline
    assert "split(" not in plan_of(address.exact_match(parsed, request="r", address="wanted", pos="n", house="house", zip_code="zip", state="state"))


def test_scores_of_hopeless_and_other_candidates(spark):
    """what a plain comparison rejects is 0 without token work; a name outweighs another postcode."""
    base = dict(address="Harbor Tower, 12 Oak Street, Rome, NY 10001", lat="1", lon="2", name="Harbor Tower", display_name="x", importance=0.0,
                house_number="12", road="oak st", locality="Rome", state="New York", postcode="10001")
    plain = {**base, "address": "12 Oak Street, Rome, NY 10001"}
    cases = [({}, 1.0), ({"lat": None}, 0.0), ({"lon": ""}, 0.0), ({"display_name": None}, 0.0), ({"house_number": "13"}, 0.0), ({"house_number": "012"}, 1.0),
             ({"state": "CA"}, 0.0), ({"postcode": "99999"}, 0.92), ({"postcode": None}, 0.92), ({"postcode": "99999", "name": "Hill"}, 0.0),
             ({"locality": "Oslo"}, 0.0), ({"state": None}, 1.0), ({"state": None, "road": None, "name": None}, 0.82)]
    rows = [{**base, **change} for change, _ in cases] + [{**plain, "postcode": "99999"}, {**plain, "address": None}]
    names = list(base)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows],
                               ", ".join(f"{n} {'double' if n == 'importance' else 'string'}" for n in names))
    score = address.candidate_score(address.parsed_request(F.col("address")), {n: F.col(n) for n in names[1:]})
    got = [r.s for r in df.coalesce(1).select(F.round(score, 6).alias("s")).collect()]
    assert "CASE WHEN" in plan_of(df.select(score.alias("s"))).split("transform(")[0].split("Project")[-1]
    assert got == [pytest.approx(w) for _, w in cases] + [0.0, 0.28]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_connected_segments_in_tasks_and_by_cells_agree(spark, monkeypatch, limit):
    """every copy of a segment in every cell was sent before; now one, with its sheet, but for crowded sheets."""
    monkeypatch.setattr(drawings, "SEGMENTS_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 40)
    rng = random.Random(7)
    rows = []
    for i in range(300):
        x, y, turn, size = rng.uniform(-500, 900), rng.uniform(-300, 700), rng.uniform(0, math.pi), rng.uniform(1, 90)
        rows.append([rng.choice([1, 2, None]), f"s{i // 2 if i < 20 else i}", x, y, x + size * math.cos(turn), y + size * math.sin(turn)])
    rows += [[1, "long", 0.0, 0.0, 900.0, 700.0], [None, "alone", 0.0, 0.0, 900.0, 0.0], [2, None, 5.0, 5.0, 9.0, 9.0], [2, "half", 10.0, None, 12.0, 8.0]]
    s = spark.createDataFrame(rows, "g int, s string, x1 double, y1 double, x2 double, y2 double").withColumns({"w": F.lit(1000), "h": F.lit(800)})

    def gap(x, y, b):
        dx, dy = b[4] - b[2], b[5] - b[3]
        t = min(max(((x - b[2]) * dx + (y - b[3]) * dy) / max(dx * dx + dy * dy, 1e-9), 0.0), 1.0)
        return math.hypot(x - b[2] - t * dx, y - b[3] - t * dy) <= 20

    def near(a, b):
        if a[0] is None or a[0] != b[0] or None in (a[1], b[1]) or a[1] == b[1]:
            return False
        return any(gap(p[k], p[k + 1], q) for p, q in ((a, b), (b, a)) for k in (2, 4) if None not in (*p[k:k + 2], *q))

    def length(a):
        return -1 if None in a[2:] else math.hypot(a[4] - a[2], a[5] - a[3])

    met = {(a[0], a[1]) for a in rows if 0 <= length(a) < 300 and any(near(a, b) for b in rows)}
    want = sorted(str(a) for a in rows if length(a) >= 300 or (a[0], a[1]) in met)
    out = drawings.connected_segments(s, keys=["g"], seg="s", width="w", height="h")
    assert sorted(str(list(r)[:6]) for r in out.collect()) == want and 40 < len(want) < 280
    assert "MapInArrow" in plan_of(out)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_stairs_in_tasks_and_by_joins_agree(spark, monkeypatch, limit):
    """treads were sent some ten times before; now one copy goes to the task of its sheet."""
    monkeypatch.setattr(drawings, "SEGMENTS_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 50)
    rng = random.Random(11)
    rows = []
    for flight in range(24):
        sheet, x, y, turn, steps = flight % 5, rng.uniform(0, 700), rng.uniform(0, 700), rng.uniform(0, math.pi), rng.randrange(3, 18)
        for i in range(steps):
            px, py = x - math.sin(turn) * 12.35 * i, y + math.cos(turn) * 12.35 * i
            rows.append((sheet if flight else None, f"f{flight}-{i}", px, py, px + 40 * math.cos(turn), py + 40 * math.sin(turn), 800))
    rows += [rows[40], (1, None, 0.0, 0.0, 40.0, 0.0, 800), (1, "none", None, 0.0, 40.0, 0.0, 800), (3, "far", -900.0, 5.0, -860.0, 5.0, 800)]
    s = spark.createDataFrame(rows, "g int, s string, x1 double, y1 double, x2 double, y2 double, size int")
    out = drawings.stair_runs(s, keys=["g"], seg="s", size="size")
    joined = drawings._stairs_by_joins(s.filter("hypot(x2 - x1, y2 - y1) between 0.018 * size and 0.16 * size"), ["g"], "s", "size")
    want = drawings.spaced_first(joined, keys=["g"], item="component", x="cx", y="cy", near="__near", limit=3).drop("__near")
    assert out.schema.simpleString() == want.schema.simpleString()
    got, told = (sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()) for df in (out, want))
    assert got == told and len(got) > 6
    assert ("MapInArrow" in plan_of(out)) and all(5 <= r[2] <= 15 for r in got)


def test_levels_are_rounded_half_to_even():
    assert drawings._half_even(np.array([0.25, 0.35, 1.45, -0.25, 16.15, 2.0, 0.249])).tolist() == [0.2, 0.4, 1.4, -0.2, 16.2, 2.0, 0.2]


@pytest.mark.parametrize("limit", [60, 10**6])
def test_components_of_a_large_graph_are_graphs_of_their_own(spark, monkeypatch, limit):
    """a graph with many small components went through rounds of joins with all its columns."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", limit)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 30)
    asked, by_rounds = [], graph.forest_by_rounds
    monkeypatch.setattr(graph, "forest_by_rounds", lambda edges, *more: asked.append(edges.count()) or by_rounds(edges, *more))
    rng = random.Random(5)
    ends = [(1, c, rng.randrange(12), rng.randrange(12)) for c in range(6) for _ in range(20 if c else 90)] + [(2, 0, 1, 2), (None, 0, 1, 2)]
    rows = [(g, 100 * c + x, 100 * c + y, rng.randrange(5) / 4, f"e{i:03d}") for i, (g, c, x, y) in enumerate(ends)]
    rows += [(1, 300, 300, 0.5, "e100"), (1, None, 500, 1.0, "n")]
    df = spark.createDataFrame(rows, "g int, a int, b int, w double, id string")
    got = graph.forest_of_trees(df, group=["g"], a="a", b="b", order=[-F.col("w"), F.col("id")], edge_id="id").collect()
    top, want = {}, {}
    for g, a, b, w, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[3], r[4])):
        one, two = (top.get((g, v), {v}) for v in (a, b))
        if a != b and one is not two:
            want[g, i] = a
            both = one | two
            top |= {(g, v): both for v in both}
    least = {k: min(v, key=lambda x: (x is not None, x or 0)) for k, v in top.items()}
    assert {(r.g, r.id): r.component for r in got if r.a != r.b} == {(g, i): least[g, v] for (g, i), v in want.items() if v is not None}
    assert asked == ([90] if limit == 60 else [])


def test_lines_of_an_order_meet_once(spark, tmp_path):
    """lines were sent twice by order and number, then by order and by customer; numbers may repeat, skip or be missing."""
    lines = [(1, 1, 10, 1.0), (1, 2, 11, 2.0), (1, 2, 12, 3.0), (1, 4, 13, 4.0), (2, 1, 10, 5.0), (2, 2, 11, 6.0), (3, 1, 7, 1.0), (3, 2, 7, 1.0),
             (None, 1, 1, 1.0), (None, 2, 2, 1.0), (4, None, 1, 1.0), (4, None, 2, 1.0), (5, 1, None, 1.0), (5, 2, 9, None), (5, 3, 8, 1.0), (6, 2, 1, 1.0), (6, 3, 2, 1.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(o, o % 3) for o in range(1, 6)], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(0, 8), (1, 7), (2, 7)], "c_custkey bigint, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    edges = scene_plans.trade_edges(Tables(spark, str(tmp_path)))
    assert plan_of(edges).count("Scan parquet") == 6  # three scans, each named twice
    assert sorted(map(tuple, edges.collect())) == [(7, 8, 9, None, "8-9"), (7, 10, 11, 0.11, "10-11"), (7, 10, 12, 0.04, "10-12")]


def test_files_of_a_stored_table_can_be_discarded(spark, tmp_path):
    kept, gone = session.stored(spark.range(3), "kept"), session.stored(spark.range(3), "gone")
    other = spark.range(3).write.parquet(str(tmp_path / "other")) or spark.read.parquet(str(tmp_path / "other"))
    session.discard(gone)
    session.discard(other)  # not below the checkpoint folder
    assert kept.count() == 3 and other.count() == 3
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file:"))
