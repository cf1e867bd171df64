import numpy as np
import pytest
from pyspark.sql import functions as F

from planiscope.operators import boundary, evaluation, planes, rules, surfaces
from planiscope.sources import generators


def test_planted_planes_are_recovered(spark):
    rng = np.random.default_rng(0)
    n = np.array([2.0, -1.0, 0.5]) / np.linalg.norm([2.0, -1.0, 0.5])
    x = rng.normal(size=(200, 3))
    x = x - (x @ n + 0.3)[:, None] * n + 0.002 * rng.normal(size=(200, 1)) * n
    x[:20] += rng.normal(size=(20, 3))
    rows = [(0, 1, p.tolist()) for p in x] + [(2, 1, [0.0, 0.0, 0.0])]
    got = surfaces.frontier_planes(spark.createDataFrame(rows, "y0 int, y1 int, x array<double>")).collect()
    best = max(got, key=lambda r: r.inliers)
    assert (best.y0, best.y1) == (0, 1) and abs(np.array(best.n) @ n) > 0.9999 and abs(abs(best.b) - 0.3) < 0.01 and best.inliers > 140
    assert all(abs(np.linalg.norm(r.n) - 1) < 1e-9 for r in got)


def test_sphere_as_quadric_and_cubic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x = 2 * x / np.linalg.norm(x, axis=1, keepdims=True) + np.array([1.0, 0.0, -1.0])
    m = surfaces.fit_implicit(x, np.full(300, 1 / 300), 2)
    q, r, c = surfaces.quadric(m)
    y = rng.normal(size=(20, 3))
    assert np.allclose(np.einsum("ni,ij,nj->n", y, q, y) + y @ r + c, surfaces.evaluate_implicit(m, y))
    assert np.abs(surfaces.evaluate_implicit(m, x)).max() < 1e-6
    t = surfaces.crossings(m, np.array([1.0, 0, -1]), np.array([5.0, 0, -1]))
    assert len(t) == 1 and abs(t[0] - 0.5) < 1e-5
    assert np.abs(surfaces.evaluate_implicit(surfaces.fit_implicit(x, np.full(300, 1 / 300), 3), x)).max() < 1e-6


def test_surfaces_per_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(0, 1, p.tolist(), 1 / 40) for p in rng.normal(size=(40, 2))] + [(0, 2, [0.0, 1.0], 1.0)]
    got = surfaces.surfaces(spark.createDataFrame(rows, "y0 int, y1 int, x array<double>, w double"), 3).collect()
    assert len(got) == 1 and len(got[0].coef) == 10
    with pytest.raises(ValueError):
        surfaces.surfaces(spark.createDataFrame(rows, "y0 int, y1 int, x array<double>, w double"), 4)


def test_flips_end_on_the_other_side(spark):
    w, b = [[3.0, 0.0], [-3.0, 1.0]], [0.2, -0.1]
    rng = np.random.default_rng(3)
    predict = boundary.numpy_softmax(w, b)
    x = rng.normal(size=(80, 2))
    y = predict(x).argmax(axis=1)
    pairs = [(f"{i}-{j}", x[i].tolist(), x[j].tolist(), int(y[i]), int(y[j])) for i in range(40) for j in range(40, 44) if y[i] != y[j]]
    segs = spark.createDataFrame(pairs, "seg_id string, x0 array<double>, xb array<double>, y0 int, yb int")
    got = boundary.flips(segs, predict).collect()
    assert len(got) == len(pairs) and all(r.y1 != r.y0 and 0 < r.t <= 1 for r in got)
    assert all(abs(np.subtract(*r.s1)) < 0.25 for r in got)
    points = boundary.change_points(segs, predict).groupBy("seg_id").count().collect()
    assert len(points) == len(pairs) and all(p["count"] == 1 for p in points)


def test_explorer_finds_the_planted_columns(spark):
    rows = generators.corner_classes(spark, 60).withColumn("x9", F.rand(1)).withColumn("x8", F.rand(2))
    top = evaluation.explore(rows, ["x1", "x2", "x3", "x8", "x9"], sizes=(2,), keep=3).orderBy("place").collect()
    assert "x8" not in top[0].features and "x9" not in top[0].features and top[0].score > 0.5
    assert evaluation.explore(rows, ["x1", "x2", "x8"], sizes=(2,), keep=3, preset="ultra_fast").count() == 3


def test_ruleset_budget_and_inequalities():
    r = [{"ks": [1, 2], "precision": 0.9, "lift": 2.0, "size": 10}, {"ks": [3], "precision": 0.8, "lift": 2.0, "size": 10}, {"ks": [1, 2, 3], "precision": 0.95, "lift": 1.0, "size": 5}]
    assert [x["ks"] for x in rules.ruleset(r, 4)] == [[1, 2, 3], [3]]
    assert planes.inequality([1.0, 0.0], -0.75, 1, ["x0", "x1"]) == "x0 ≤ 0.75"
    assert planes.inequality([-2.0, 0.0], 1.5, 1, ["x0", "x1"]) == "x0 ≥ 0.75"
    assert planes.inequality([1.0, 1.0, 1.0], 0.0, -1, ["a", "b", "c"]).endswith("≥ 0")


def test_constrained_pick_keeps_its_caps():
    rng = np.random.default_rng(4)
    cand = [{"a": 0, "b": 1 + k % 2, "i": int(rng.integers(6)), "j": int(rng.integers(6)), "score": float(rng.random())} for k in range(60)]
    got = boundary.constrained_pick(cand, {(0, 1): 5, (0, 2): 5})
    assert len(got) == 10 and all(sum(c["b"] == b for c in got) == 5 for b in (1, 2))
    few = boundary.constrained_pick(cand[:3], {(0, 1): 5, (0, 2): 5})
    assert len(few) == 3
