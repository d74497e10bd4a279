"""Loop closure and point constraints on the classic three-camera chain."""

import math
from unittest.mock import MagicMock

import numpy as np
import pytest

from proofgrid.operators import posegraph
from proofgrid.operators.posegraph import refine_poses
from proofgrid.plans import points as plans


def shift(x):
    return [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("with_points", [False, True])
def test_loop(spark, with_points):
    poses = spark.createDataFrame([("s", i, shift(float(i))) for i in range(3)], "s string, f int, pose array<double>")
    edges = spark.createDataFrame([("s", 0, 1, shift(1.0), 0.95), ("s", 1, 2, shift(1.0), 0.92), ("s", 0, 2, shift(2.2), 0.75)],
                                  "s string, a int, b int, transform array<double>, confidence double")
    rows = [("s", a, b, i, 0.1 * i + d, 0.05 * (i % 5), 2.0 + 0.1 * (i % 3), 0.1 * i, 0.05 * (i % 5), 2.0 + 0.1 * (i % 3))
            for a, b, d in ((0, 1, 1.1), (1, 2, 1.1), (0, 2, 2.2)) for i in range(24)] if with_points else []
    pts = spark.createDataFrame(rows, "s string, a int, b int, idx int, ax double, ay double, az double, bx double, by double, bz double")
    anchor = spark.createDataFrame([("s", 0)], "s string, anchor int")
    if with_points:  # point and transform terms must agree for a joint improvement
        edges = spark.createDataFrame([("s", 0, 1, shift(1.1), 0.95), ("s", 1, 2, shift(1.1), 0.92), ("s", 0, 2, shift(2.2), 0.75)], edges.schema)
    out, report = refine_poses(poses, edges, pts, anchor, scene=["s"], frame="f", rounds=6)
    r = report.first()
    assert r.optimised and r.transform_after < r.transform_before and r.edges - (r.nodes - 1) == 1
    got = {x.f: x.pose for x in out.collect()}
    assert got[0] == shift(0.0)
    if with_points:
        assert r.constraints_before == 72 and r.point_after < r.point_before
        assert got[1][3] == pytest.approx(1.1, abs=1e-3) and got[2][3] == pytest.approx(2.2, abs=1e-3)


def test_no_loop_keeps_poses(spark):
    poses = spark.createDataFrame([("s", i, shift(float(i))) for i in range(2)], "s string, f int, pose array<double>")
    edges = spark.createDataFrame([("s", 0, 1, shift(1.5), 0.9)], "s string, a int, b int, transform array<double>, confidence double")
    pts = spark.createDataFrame([], "s string, a int, b int, idx int, ax double, ay double, az double, bx double, by double, bz double")
    anchor = spark.createDataFrame([("s", 0)], "s string, anchor int")
    out, report = refine_poses(poses, edges, pts, anchor, scene=["s"], frame="f", rounds=2)
    assert not report.first().optimised and {x.f: x.pose[3] for x in out.collect()} == {0: 0.0, 1: 1.0}


def turned(v):
    angle = math.sqrt(sum(x * x for x in v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / (angle or 1.0)
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def similarity(t):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = math.exp(t[6]) * turned(t[:3]), t[3:6]
    return m


def rough_scene(name, seed, frames=4):
    """Cameras on a way with noise, loops and a few points far off."""
    rng = np.random.default_rng(seed)
    true = [np.concatenate([0.2 * rng.normal(size=3), [i, 0, 0] + 0.2 * rng.normal(size=3), [0.05 * rng.normal()]]) for i in range(frames)]
    start = [true[0], *[t + 0.15 * rng.normal(size=7) for t in true[1:]]]
    links = [(i, j) for i in range(frames) for j in range(i + 1, frames)]
    edges = [(name, a, b, (np.linalg.inv(similarity(true[a])) @ similarity(true[b] + 0.05 * rng.normal(size=7))).ravel().tolist(), float(rng.uniform(0.3, 0.9)))
             for a, b in links]
    points = []
    for a, b in links[:-1]:
        for i in range(8):
            world = rng.normal(size=3) * 2
            at = [np.linalg.inv(similarity(true[f])) @ np.append(world, 1) for f in (a, b)]
            off = rng.normal(size=3) * (3.0 if i == 0 else 0.02)
            points.append((name, a, b, i, *map(float, at[0][:3]), *map(float, at[1][:3] + off)))
    return [(name, i, similarity(t).ravel().tolist()) for i, t in enumerate(start)], edges, points


def loss(poses, edges, points):
    """The whole robust loss of a scene, written without the operator's shortcuts."""
    m = {f: np.array(p).reshape(4, 4) for _, f, p in poses}
    parts = lambda x: (np.cbrt(np.linalg.det(x[:3, :3])), x[:3, :3] / np.cbrt(np.linalg.det(x[:3, :3])))
    unit = max(0.25, float(np.median([np.linalg.norm(np.array(e[3]).reshape(4, 4)[:3, 3]) for e in edges])))
    res = []
    for _, a, b, seen, confidence in edges:
        seen, told, w = np.array(seen).reshape(4, 4), np.linalg.inv(m[a]) @ m[b], math.sqrt(max(0.05, confidence))
        (s, r), (t, q) = parts(told), parts(seen)
        r = r @ q.T
        angle = math.acos(min(1.0, max(-1.0, (np.trace(r) - 1) / 2)))
        axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) * (0.5 if angle < 1e-9 else angle / (2 * math.sin(angle)))
        res += [*(w * axis), *(w * (told[:3, 3] - seen[:3, 3]) / unit), w * math.log(s / t)]
        mine = [p for p in points if (p[1], p[2]) == (a, b)]
        for p in mine if len(mine) >= 3 else []:
            res += [*(1.5 * w / math.sqrt(len(mine)) / unit * ((m[a] @ [*p[4:7], 1]) - (m[b] @ [*p[7:10], 1]))[:3])]
    return 0.25 * sum(math.sqrt(1 + (r / 0.5) ** 2) - 1 for r in res)


POSES, EDGES = "s string, f int, pose array<double>", "s string, a int, b int, transform array<double>, confidence double"
POINTS = "s string, a int, b int, idx int, ax double, ay double, az double, bx double, by double, bz double"


@pytest.mark.parametrize("limit", [0, 10**6])
def test_scenes_are_refined_until_no_step_helps(spark, monkeypatch, limit):
    """a count of rounds ended the refinement before; in a task and by rounds every scene reaches its least loss."""
    monkeypatch.setattr(posegraph, "POINTS_A_TASK", limit)
    scenes = {"u": rough_scene("u", 1), "v": rough_scene("v", 2, 3), "w": rough_scene("w", 3)}
    poses, edges, points = (spark.createDataFrame([r for s in scenes.values() for r in s[i]], t) for i, t in enumerate((POSES, EDGES, POINTS)))
    anchors = spark.createDataFrame([(n, 0) for n in scenes], "s string, anchor int")
    out, report = posegraph.refine_poses(poses, edges, points, anchors, scene=["s"], frame="f", tolerance=10.0)
    told = {r.s: r for r in report.collect()}
    got = {(r.s, r.f): np.array(r.pose).reshape(4, 4) for r in out.collect()}
    rng = np.random.default_rng(0)
    for name, (start, e, p) in scenes.items():
        assert told[name].converged and told[name].optimised and 2 < told[name].evaluations <= 250
        best = [(name, f, got[name, f]) for _, f, _ in start]
        least = loss(best, e, p)
        assert least < loss(start, e, p) and np.allclose(best[0][2], np.array(start[0][2]).reshape(4, 4))
        for _ in range(40):
            near = [best[0], *[(n, f, m @ similarity(1e-3 * rng.normal(size=7))) for n, f, m in best[1:]]]
            assert loss(near, e, p) > least


def test_the_query_sets_no_count_of_rounds(spark, monkeypatch):
    """the query asked for two rounds."""
    class Asked(Exception):
        pass

    def refine(*args, **given):
        raise Asked(given)

    monkeypatch.setattr(plans, "refine_poses", refine)
    monkeypatch.setattr(plans, "cams", lambda t: MagicMock())
    monkeypatch.setattr(plans, "cloud", lambda t: MagicMock())
    with pytest.raises(Asked) as asked:
        plans.q08(MagicMock())
    assert "rounds" not in asked.value.args[0]
