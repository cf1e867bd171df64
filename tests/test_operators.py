"""Operators that SQL has no form of, against plain code and planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planiscope.operators import boundary, evaluation, generators, graph, models, planes, quantiles, rules, surfaces
from planiscope.operators.cells import HalfSpace


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v), float(np.round(w, 1)), None if k % 7 == 0 else float(k % 3)) for k, (g, v, w) in enumerate(zip(rng.integers(0, 3, 5000), rng.normal(size=5000), rng.normal(size=5000)))]
    rows += [(7, 1.5, float("nan"), 2.0), (8, None, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(5)
    at = [0.0, 0.2, 0.5, 0.77, 1.0]
    for r in quantiles.percentiles(df, ["a", "b", "c"], at, ("g",)).collect():
        for k, c in enumerate("abc", 1):
            own = [x[k] for x in rows if x[0] == r["g"] and x[k] is not None and not np.isnan(x[k])]
            assert (r[c] is None) == (not own) and (not own or np.allclose(r[c], np.quantile(own, at), atol=1e-9))
    r = quantiles.percentiles(df, ["a"], at).first()
    assert np.allclose(r["a"], np.quantile([x[1] for x in rows if x[1] is not None], at))


def test_components_and_large_banks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(1000, 1001)], "a int, b int")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {i: 0 for i in range(151)} | {1000: 1000, 1001: 1000}
    ids = spark.range(300).select(F.col("id").cast("int").alias("hs_id"))
    own = spark.createDataFrame([(i, i + 1) for i in range(150)], "a int, b int")
    assert {(r.hs_id, r.family) for r in planes.families(ids, own, driver_bank=10).collect()} == {(i, 0 if i <= 150 else i) for i in range(300)} == {(r.hs_id, r.family) for r in planes.families(ids, own).collect()}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 0.6, (60, 3)) for m in ([0, 0, 0], [3, 0, 0], [0, 3, 0])])
    rows = [(i, p.tolist(), int(i // 60)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, y int").cache()


def _fitted(blobs):
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = blobs.select(array_to_vector("features").alias("features"), F.col("y").cast("double").alias("label"))
    two = data.filter("label < 2")
    return LogisticRegression(maxIter=20).fit(data), LinearSVC(maxIter=20).fit(two), RandomForestClassifier(numTrees=5, maxDepth=3, seed=1).fit(data)


def test_every_kind_of_model_scores(spark, blobs):
    logistic, svm, _ = _fitted(blobs)
    got = models.scored_by(blobs, logistic).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.label == int(np.argmax(r.p)) for r in got) and np.mean([r.label == r.y for r in got]) > 0.95
    got = models.scored_by(blobs.filter("y < 2"), svm).collect()
    assert all(len(r.p) == 2 for r in got) and np.mean([r.label == r.y for r in got]) > 0.95
    one = models.scored_by(blobs, lambda x: 1 / (1 + np.exp(-x[:, 0]))).select("p").first().p
    assert len(one) == 2 and abs(sum(one) - 1) < 1e-9
    decision = models.scored_by(blobs, lambda x: x[:, :2], mode="decision").first()
    assert abs(sum(decision.p) - 1) < 1e-9
    assert models.scored_by(blobs, boundary.linear_softmax([[1.0, 0, 0], [0, 1.0, 0]], [0.0, 0.0])).count() == 180
    with pytest.raises(ValueError):
        models.scored_by(blobs, logistic, mode="other")
    twice = blobs.unionByName(blobs)
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(len(x))
        return np.stack([x[:, 0], 1 - x[:, 0]], axis=1)

    assert models.scored_once_by(twice, counted).count() == 360 and calls.value == 180


def test_tree_change_points_against_a_fine_grid(spark, blobs):
    _, _, forest = _fitted(blobs)
    splits = boundary.tree_splits(forest)
    assert splits and all(0 <= f < 3 for f, _ in splits)
    from pyspark.ml.linalg import Vectors

    predict = lambda x: np.array([forest.predictProbability(Vectors.dense(v)).toArray() for v in x])
    segs = [("a", [0.0, 0.1, 0.0], [3.0, 0.2, 0.1]), ("b", [0.0, 3.0, 0.0], [3.0, 0.0, 0.2]), ("c", [0.0, 0.0, 0.0], [0.1, 0.0, 0.0])]
    table = spark.createDataFrame(segs, "seg_id string, x0 array<double>, xb array<double>")
    t = {}
    for r in boundary.split_crossings(table, spark.createDataFrame(splits, "feature int, threshold double")).collect():
        t.setdefault(r.seg_id, []).append(r.t)
    for name, a, b in segs:
        a, b = np.array(a), np.array(b)
        want = sorted({round((v - a[f]) / (b[f] - a[f]), 9) for f, v in splits if min(a[f], b[f]) < v < max(a[f], b[f])})
        assert np.allclose(sorted(t.get(name, [])), want, atol=1e-8)
    rng = np.random.default_rng(0)
    w, c = rng.normal(size=(3, 3)), np.zeros(3)
    steps = lambda x: np.floor(x * 4)  # noqa: E731  constant between thresholds k / 4
    stair = lambda x, w=w, c=c: steps(np.asarray(x)) @ w.T + c
    grid = [(f, k / 4) for f in range(3) for k in range(-20, 21)]
    got = boundary.tree_change_points(table, spark.createDataFrame(grid, "feature int, threshold double"), stair).collect()
    for name, a, b in segs:
        a, b = np.array(a), np.array(b)
        fine = np.linspace(0, 1, 40_001)
        y = stair(a + (b - a) * fine[:, None]).argmax(axis=1)
        changes = fine[1:][y[1:] != y[:-1]]
        assert np.allclose(sorted(r.t for r in got if r.seg_id == name), changes, atol=1e-4)


def test_boundary_records_from_rows_to_scores(blobs):
    w, c = [[-1.0, -1.0, 0.0], [1.0, -1.0, 0.0], [-1.0, 1.0, 0.0]], [3.0, -1.0, -1.0]
    got = boundary.sample_boundary(blobs, (boundary.linear_softmax(w, c), boundary.numpy_softmax(w, c)), target=40).collect()
    assert 20 <= len(got) <= 40 and {(r.a, r.b) for r in got} >= {(0, 1), (0, 2)}
    assert all(r.y1 != r.y0 and 0 <= r.final_score <= 1 for r in got) and sorted(r.place for r in got) == list(range(1, len(got) + 1))


def test_change_points_are_thinned_evenly(spark):
    wave = lambda x: np.stack([np.sin(40 * x[:, 0]), -np.sin(40 * x[:, 0])], axis=1)
    segs = spark.createDataFrame([("s", [0.01], [1.0])], "seg_id string, x0 array<double>, xb array<double>")
    every = sorted(r.t for r in boundary.change_points(segs, wave).collect())
    few = sorted(r.t for r in boundary.change_points(segs, wave, most=4).collect())
    assert len(every) == 12 and len(few) == 4 and few[0] == every[0] and few[-1] == every[-1]


def test_principal_axes_and_projection(spark, blobs):
    x = np.array([r.features for r in blobs.collect()])
    axes = boundary.principal_axes(blobs, "features", 3, 2)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose([r.variance for r in axes.orderBy("component").collect()], values[:2])
    z = np.array([r.z for r in boundary.projected(blobs, "features", axes, 3).collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.var(axis=0), values[:2])


def test_groups_of_segments_and_planes_of_a_pair(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(-2, 2, (60, 2))
    one = np.column_stack([np.zeros(60), y]) + rng.normal(0, 0.01, (60, 3)) * [1, 0, 0]
    two = np.column_stack([y[:, 0], np.full(60, 5.0), y[:, 1]]) + rng.normal(0, 0.01, (60, 3)) * [0, 1, 0]
    starts = np.vstack([one - [1, 0, 0], two - [0, 1, 0]])
    ends = np.vstack([one, two])
    groups = surfaces.segment_groups(starts, ends)
    assert sorted(map(len, groups)) == [60, 60]
    rows = [(0, 1, a.tolist(), b.tolist()) for a, b in zip(starts, ends)] + [(0, 2, [0.0] * 3, [1.0] * 3)]
    got = surfaces.frontier_planes(spark.createDataFrame(rows, "y0 int, y1 int, x0 array<double>, x array<double>"), subspaces=[[0, 1]]).collect()
    whole = [np.abs(r.n) for r in got if r.dims == [0, 1, 2] and r.inliers > 40]
    assert any(n[0] > 0.99 for n in whole) and any(n[1] > 0.99 for n in whole)
    assert {tuple(r.dims) for r in got} == {(0, 1, 2), (0, 1)} and {(r.y0, r.y1) for r in got} == {(0, 1)}
    t, cos = surfaces.ray_hits(np.array([[0.0, 0, 0], [0.0, 0, 0]]), np.array([[1.0, 0, 0], [0, 1.0, 0]]), np.array([1.0, 0, 0]), -2.0)
    assert t[0] == 2 and np.isinf(t[1]) and cos.tolist() == [1, 0]
    up = np.vstack([np.tile([0, 0, 1.0], (10, 1)), np.tile([0, 0, -1.0], (9, 1))])
    assert sorted(map(len, surfaces.two_signs(up))) == [9, 10] and len(surfaces.two_signs(up[:11])) == 1


def test_separating_surface_has_the_boundary_between_the_ends(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(200, 2))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    m = surfaces.fit_separating(0.7 * u, 1.3 * u, np.ones(200), 2)
    assert (surfaces.evaluate_implicit(m, 0.7 * u) < 0).all() and (surfaces.evaluate_implicit(m, 1.3 * u) > 0).all()
    assert all(abs(surfaces.crossings(m, np.zeros(2), 2 * v)[0] - 0.5) < 0.1 for v in u[:10])
    x = spark.createDataFrame([(v.tolist(),) for v in u[:20]], "x array<double>").select(surfaces.surface_value("x", m).alias("v")).collect()
    assert np.allclose([r.v for r in x], surfaces.evaluate_implicit(m, u[:20]))
    assert surfaces.explorer_dims([{"features": "b,a"}, {"features": ["a", "b"]}, {"features": ["x2"]}, {"features": [0, 2]}], ["a", "b", "c"]) == [[0, 1], [0, 2]]


@pytest.fixture(scope="module")
def planted(spark):
    """y tells whether a and b have one sign; c follows a; d and e are noise."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(800):
        a, b, d, e = rng.normal(size=4)
        rows.append((i, float(a), float(b), float(a + 0.1 * rng.normal()), float(d), float(e), int((a > 0) == (b > 0)) + int(a > 1.2)))
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, e double, y int").cache()


@pytest.mark.parametrize("name", sorted(generators.METHODS))
def test_methods_propose_sorted_sets_and_repeat_them(planted, name):
    a = generators.analyse(planted, list("abcde"), "y")
    first = generators.METHODS[name](a)
    assert all(s == tuple(sorted(set(s))) and len(s) in (2, 3) and set(s) <= set("abcde") for s in first)
    assert sorted(set(first)) == sorted(set(generators.METHODS[name](a)))
    if "correlated" in name:
        assert ("a", "c") in first and ("d", "e") not in first
    elif "minhash" in name:
        assert ("a", "c") in first  # masks of unrelated columns share a band now and then, those of a and c nearly always
    else:
        assert first


def test_trees_find_columns_that_act_together(planted):
    a = generators.analyse(planted, list("abcde"), "y", sizes=(2,))
    for method in (generators.forest_weighted, generators.random_trees_refined):
        best = method(a)[:4]
        assert any(s in best for s in (("a", "b"), ("b", "c"))), (method, best)
    trees = generators.forest_nodes(a, a.columns, 3, 3, False)
    assert len(trees) == 3 and all(t[0].feature >= 0 for t in trees)
    ways = list(generators.paths(trees[0]))
    assert len(ways) == sum(n.feature < 0 for n in trees[0].values()) and all(len(w) <= 3 for w, _, _ in ways)


def test_bundle_and_its_summary(planted):
    reports, summary = evaluation.bundle(planted, list("abcde"), cap=6, keep=5, methods=("1b topk_guided", "10 gradient_synergy", "6b sparse_projection_guided"))
    rows = reports.collect()
    assert len(rows) == 5 and all(r.methods for r in rows)
    by = {r.method: r for r in summary.collect()}
    assert len(by) == 3 and all(0 < r.candidates <= 6 and r.seconds >= 0 for r in by.values()) and max(r.selected for r in by.values()) > 0


def test_hyper_grid():
    options = {"a": [1, 2], "b": [3, 4, 5]}
    rows = evaluation.hyper_grid(options)
    assert len(rows) == 6 and len(evaluation.hyper_grid(options, draws=4)) == 4
    assert len(evaluation.hyper_grid(options, done=frozenset({"a=1,b=3"}))) == 5


def test_presets_differ_and_large_banks_are_refused(spark):
    rng = np.random.default_rng(5)
    rows = [(float(u), float(v), int(u > 0.6 and v < 0.4) + 2 * int(u < 0.2)) for u, v in rng.random((600, 2))]
    df = spark.createDataFrame(rows, "u double, v double, y int")
    bank = planes.axis_half_spaces([[0.2, 0.4, 0.6, 0.8]] * 2)
    found = {p: rules.search(df, bank, ["u", "v"], preset=p).collect() for p in rules.PRESETS}
    assert {r.kind for r in found["deterministic"]} == {"and"} and all(r.parent is None for r in found["deterministic"])
    assert any(r.parent for r in found["default"]) and max(r.num_planes for r in found["support_first"] if r.kind == "and") <= 2
    best = max((r for r in found["default"] if r.target == 1), key=lambda r: r.f1)
    assert best.f1 > 0.99
    with pytest.raises(ValueError):
        rules.search(df, [HalfSpace(i, f"p{i}", (1.0, 0.0), 0.0, 1) for i in range(63)], ["u", "v"])
