"""Boundary sampling: pair quotas, candidate segments, flips, and the records made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..storage import stored
from .quantiles import percentiles

Scorer = Callable[[Column], Column]


def linear_softmax(weights: list[list[float]], biases: list[float]) -> Scorer:
    """A closed-form classifier as an expression: features array to probability array."""
    return lambda x: g.softmax(F.array(*[g.dot(x, g.vector(w)) + float(b) for w, b in zip(weights, biases, strict=True)]))


def scored(df: DataFrame, scorer: Scorer, features: str = "features") -> DataFrame:
    """Adds p (probabilities) and label (their first argmax)."""
    return df.withColumn("p", scorer(F.col(features))).withColumn("label", g.argmax(F.col("p")))


def scored_once(df: DataFrame, scorer: Scorer, features: str = "features", digits: int = 6) -> DataFrame:
    """As `scored`, each distinct rounded row scored once; worth it where the model is dear and rows repeat."""
    key = F.transform(features, lambda v: F.round(v, digits))
    rows = df.withColumn("_key", key)
    distinct = rows.select("_key").distinct()
    return rows.join(scored(distinct.withColumnRenamed("_key", "k"), scorer, "k").select(F.col("k").alias("_key"), "p", "label"), "_key").drop("_key")


def pair_quotas(proba: DataFrame, target: int) -> DataFrame:
    """(a, b, weight, quota): segments for each pair of classes present, by the product of mean probabilities.

    Quotas are whole numbers that sum to the target: largest remainders first, the larger pair on ties.
    """
    mean = proba.select(F.posexplode("p").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("m")).filter("m > 1e-12")
    a, b = mean.select(F.col("c").alias("a"), F.col("m").alias("ma")), mean.select(F.col("c").alias("b"), F.col("m").alias("mb"))
    everything = Window.partitionBy()  # classes squared
    w = a.join(b, F.col("a") < F.col("b")).withColumn("weight", F.col("ma") * F.col("mb"))
    w = w.withColumn("weight", F.col("weight") / F.sum("weight").over(everything)).withColumn("exact", F.round(F.col("weight") * target, 9)).withColumn("base", F.floor("exact"))
    order = Window.orderBy((F.col("exact") - F.col("base")).desc(), F.col("a").desc(), F.col("b").desc())
    rest = target - F.sum("base").over(everything)
    return w.withColumn("rk", F.row_number().over(order)).withColumn("quota", F.col("base") + F.when(F.col("rk") <= rest, 1).otherwise(0)).select("a", "b", "weight", "quota")


def margin_seeds(rows: DataFrame, a: int, b: int, share: float = 0.25, most: int = 48, key: str = "row_id") -> DataFrame:
    """Rows labelled a or b whose margin p[a] - p[b] is among the smallest `share` of their side, at most `most` a side."""
    margin = F.abs(F.element_at("p", a + 1) - F.element_at("p", b + 1))
    own = rows.filter(F.col("label").isin(a, b)).withColumn("margin", margin)
    cut = percentiles(own, ["margin"], [share], ("label",)).select("label", F.element_at("margin", 1).alias("cut"))
    order = Window.partitionBy("label").orderBy(F.round("margin", 9), key)
    near = own.join(F.broadcast(cut), "label").filter(F.col("margin") <= F.col("cut") + 1e-12)
    return near.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= most).drop("cut", "rk")


def seed_cap(quota: int) -> int:
    """Seeds on either side of a pair with that many segments to draw."""
    return int(6 * max(8, 1.5 * quota**0.5))


def gated(pairs: DataFrame, a: int, b: int, tau: float = 0.0) -> DataFrame:
    """Pairs (pi, pj) whose ends lie on different sides: the score difference of a and b changes its sign, or both ends are
    within `tau` of the margin."""
    margin = lambda p: F.element_at(p, a + 1) - F.element_at(p, b + 1)
    mi, mj = margin("pi"), margin("pj")
    return pairs.filter((mi * mj < 0) | ((F.abs(mi) <= tau) & (F.abs(mj) <= tau)))


def nearest_pairs(seeds: DataFrame, a: int, b: int, k: int = 5, quantile: float = 0.35, key: str = "row_id", features: str = "features") -> DataFrame:
    """(i, j, d): for each seed of class a its k nearest seeds of class b within the distance quantile; seeds are capped."""
    side = lambda c, i, x, p: seeds.filter(F.col("label") == c).select(F.col(key).alias(i), F.col(features).alias(x), F.col("p").alias(p))
    pairs = side(a, "i", "xi", "pi").join(side(b, "j", "xj", "pj")).withColumn("d", g.norm(g.minus(F.col("xi"), F.col("xj"))))
    cut = pairs.agg(F.percentile("d", F.lit(quantile)).alias("cut"))
    order = Window.partitionBy("i").orderBy(F.round("d", 9), "j")
    return pairs.withColumn("rk", F.row_number().over(order)).join(F.broadcast(cut)).filter((F.col("rk") <= k) & (F.col("d") <= F.col("cut") + 1e-12)).drop("rk", "cut")


def candidate_score(mi: Column, mj: Column, hi: Column, hj: Column, d: Column, dims: int) -> Column:
    """.45 closeness to the margin + .35 mean entropy + .20 shortness."""
    return 0.45 * (1 - (F.abs(mi) + F.abs(mj)) / 2) + 0.35 * (hi + hj) / 2 + 0.2 * (1 - d / float(dims) ** 0.5)


def numpy_softmax(weights: list[list[float]], biases: list[float]) -> Callable:
    """The same classifier as a function of a matrix of rows, as flips and change_points take any model."""

    def predict(x):
        import numpy as np

        z = x @ np.array(weights).T + np.array(biases)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


def _ends(d):
    import numpy as np

    return np.array(d["x0"].tolist(), float), np.array(d["xb"].tolist(), float)


def flips(segments: DataFrame, predict: Callable, secant: int = 2, bisect: int = 8) -> DataFrame:
    """(seg_id, t, x1, s1, y0, y1): the first point found on the far side of the boundary along x0 to xb.

    False position on the score difference narrows the bracket, bisection on the label ends it; the upper end of the
    bracket always carries another label than y0 if xb does. `predict` maps a matrix to probabilities and is called once
    per step for a whole Arrow batch, so any model serves.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        for d in batches:
            if not len(d):
                continue
            a, b = _ends(d)
            y0, yb = d["y0"].to_numpy(), d["yb"].to_numpy()
            at, rows = (lambda t: a + (b - a) * t[:, None]), np.arange(len(d))
            lo, hi = np.zeros(len(d)), np.ones(len(d))
            for k in range(secant + bisect):
                if k < secant:
                    s, e = predict(at(lo)), predict(at(hi))
                    h0, h1 = s[rows, y0] - s[rows, yb], e[rows, y0] - e[rows, yb]
                    share = np.clip(h0 / (h0 - h1 + 1e-12), 1e-4, 1 - 1e-4)
                else:
                    share = 0.5
                t = lo + (hi - lo) * share
                same = predict(at(t)).argmax(axis=1) == y0
                lo, hi = np.where(same, t, lo), np.where(same, hi, t)
            x1 = at(hi)
            s1 = predict(x1)
            yield pd.DataFrame({"seg_id": d["seg_id"], "t": hi, "x1": list(x1), "s1": list(s1), "y0": y0, "y1": s1.argmax(axis=1)})

    return segments.select("seg_id", "x0", "xb", "y0", "yb").mapInPandas(run, "seg_id string, t double, x1 array<double>, s1 array<double>, y0 int, y1 int")


def delta_metrics(rows: DataFrame, jsd_weight: float = 0.2) -> DataFrame:
    """Adds the record's measures from (x0, x1, s0, s1, y0, y1)."""
    at = lambda s, y: F.element_at(F.col(s), F.col(y) + 1)
    m0, m1 = at("s0", "y0") - at("s0", "y1"), at("s1", "y0") - at("s1", "y1")
    gain = F.log(at("s1", "y1") + 1e-12) - F.log(at("s1", "y0") + 1e-12) - (F.log(at("s0", "y1") + 1e-12) - F.log(at("s0", "y0") + 1e-12))
    swing = 0.5 * (F.greatest(F.lit(0.0), at("s0", "y0") - at("s1", "y0")) + F.greatest(F.lit(0.0), at("s1", "y1") - at("s0", "y1")))
    delta = g.minus(F.col("x1"), F.col("x0"))
    out = rows.select("*", m0.alias("m0"), m1.alias("m1"), gain.alias("logit_gain"), swing.alias("prob_swing"), g.jensen_shannon(F.col("s0"), F.col("s1")).alias("jsd"), g.norm(delta).alias("delta_l2"), g.norm_inf(delta).alias("delta_linf"))
    out = out.withColumn("success", (F.col("y1") != F.col("y0")) & (F.col("m1") <= -0.02) & (F.col("logit_gain") >= 0.25)).withColumn("margin_gain", F.greatest(F.lit(0.0), F.col("m0") - F.col("m1")))
    return out.withColumn("score_change", 0.7 * F.col("prob_swing") + 0.3 * F.greatest(F.lit(0.0), -F.col("m1")) + jsd_weight * F.col("jsd"))


def final_scores(records: DataFrame) -> DataFrame:
    """Adds final_score: .6 change + .4 shortness, each over its pair's 95th percentile among successes; failures are 0."""
    cut = percentiles(records.filter("success"), ["delta_l2", "score_change"], [0.95], ("y0", "y1"))
    p95 = cut.select("y0", "y1", F.element_at("delta_l2", 1).alias("d95"), F.element_at("score_change", 1).alias("c95"))
    part = lambda v, q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / F.greatest(F.col(q), F.lit(1e-12))))
    score = 0.6 * part("score_change", "c95") + 0.4 * (1 - part("delta_l2", "d95"))
    return records.join(F.broadcast(p95), ["y0", "y1"], "left").withColumn("final_score", F.when(F.col("success"), score).otherwise(F.lit(0.0))).drop("d95", "c95")


def round_robin(records: DataFrame, target: int, key: str) -> DataFrame:
    """One record of each pair in turn, best first, up to `target`; adds place."""
    turn = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("score").desc(), key))
    rows = records.withColumn("turn", turn)
    return rows.filter(F.col("turn") <= target).withColumn("place", F.row_number().over(Window.orderBy("turn", "a", "b"))).filter(F.col("place") <= target)


def change_points(segments: DataFrame, predict: Callable, cells: int = 128, steps: int = 12, most: int = 32, stop: float = 1e-6) -> DataFrame:
    """(seg_id, t, y_left, y_right): label changes along x0 to xb, from a grid of midpoints narrowed by bisection until a
    bracket is shorter than `stop`. Of more than `most` changes of a segment that many, evenly spread, are given."""

    def run(batches):
        import numpy as np
        import pandas as pd

        # the ends are labelled too, else a change within half a cell of them would be missed
        grid = np.concatenate([[0.0], (np.arange(cells) + 0.5) / cells, [1.0]])
        for d in batches:
            if not len(d):
                continue
            a, b = _ends(d)
            points = a[:, None, :] + (b - a)[:, None, :] * grid[None, :, None]
            y = predict(points.reshape(-1, a.shape[1])).argmax(axis=1).reshape(len(d), len(grid))
            row, i = np.nonzero(y[:, 1:] != y[:, :-1])
            count = np.bincount(row, minlength=len(d))
            keep = np.zeros(len(row), bool)
            for k, at in zip(count, np.cumsum(count) - count, strict=True):
                keep[at + (np.arange(k) if k <= most else np.unique(np.round(np.linspace(0, k - 1, most)).astype(int)))] = True
            row, i = row[keep], i[keep]
            lo, hi, left = grid[i], grid[i + 1], y[row, i]
            for _ in range(steps if len(row) else 0):
                if (hi - lo).max() < stop:
                    break
                m = (lo + hi) / 2
                same = predict(a[row] + (b[row] - a[row]) * m[:, None]).argmax(axis=1) == left
                lo, hi = np.where(same, m, lo), np.where(same, hi, m)
            yield pd.DataFrame({"seg_id": d["seg_id"].to_numpy()[row], "t": hi, "y_left": left, "y_right": y[row, i + 1]})

    return segments.select("seg_id", "x0", "xb").mapInPandas(run, "seg_id string, t double, y_left int, y_right int")


def split_crossings(segments: DataFrame, splits: DataFrame, tolerance: float = 1e-9, most: int = 512) -> DataFrame:
    """(seg_id, t): where segments (x0 to xb) cross the thresholds (feature, threshold) of a tree model's splits, exact and in
    order, each place once; a range join of segments and splits by feature. Over `most` places of a segment are thinned evenly."""
    ends = segments.select("seg_id", F.posexplode(F.arrays_zip("x0", "xb")).alias("feature", "e")).select("seg_id", "feature", F.col("e.x0").alias("v0"), F.col("e.xb").alias("v1"))
    ends = ends.withColumn("low", F.least("v0", "v1")).withColumn("high", F.greatest("v0", "v1")).filter("low < high")
    hit = ends.join(splits.select("feature", "threshold").distinct(), "feature").filter((F.col("threshold") > F.col("low")) & (F.col("threshold") < F.col("high")))
    t = hit.select("seg_id", ((F.col("threshold") - F.col("v0")) / (F.col("v1") - F.col("v0"))).alias("t")).groupBy("seg_id", F.round(F.col("t") / tolerance).alias("_k")).agg(F.min("t").alias("t"))
    w = Window.partitionBy("seg_id")
    placed = t.withColumn("rk", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count("*").over(w))
    # the rank is one of the `most` even steps from 0 to n - 1
    step = F.round(F.round(F.col("rk") * (most - 1) / (F.col("n") - 1)) * (F.col("n") - 1) / (most - 1))
    return placed.filter((F.col("n") <= most) | (F.col("rk") == step)).select("seg_id", "t")


def tree_change_points(segments: DataFrame, splits: DataFrame, predict: Callable, tolerance: float = 1e-9) -> DataFrame:
    """(seg_id, t, y_left, y_right): label changes of a tree model along segments. The label is constant between crossings,
    so one prediction between any two neighbours decides, without a search."""
    t = split_crossings(segments, splits, tolerance).groupBy("seg_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for d in batches:
            if not len(d):
                continue
            a, b = _ends(d)
            ts = [np.asarray(v, float) for v in d["ts"]]
            mids = [(np.append(0.0, v) + np.append(v, 1.0)) / 2 for v in ts]
            row = np.repeat(np.arange(len(d)), [len(m) for m in mids])
            y = predict(a[row] + (b[row] - a[row]) * np.concatenate(mids)[:, None]).argmax(axis=1)
            edge = np.flatnonzero((row[1:] == row[:-1]) & (y[1:] != y[:-1]))
            place = edge - np.searchsorted(row, row[edge])
            yield pd.DataFrame({"seg_id": d["seg_id"].to_numpy()[row[edge]], "t": [ts[r][k] for r, k in zip(row[edge], place, strict=True)], "y_left": y[edge], "y_right": y[edge + 1]})

    return segments.join(t, "seg_id").select("seg_id", "x0", "xb", "ts").mapInPandas(run, "seg_id string, t double, y_left int, y_right int")


def tree_splits(model) -> list[tuple[int, float]]:
    """(feature, threshold) of all numeric splits of a Spark tree or forest model, from its own node objects."""
    out: set[tuple[int, float]] = set()
    for tree in getattr(model, "trees", [model]):
        stack = [tree._call_java("rootNode")]
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                if split.getClass().getSimpleName() == "ContinuousSplit":
                    out.add((split.featureIndex(), split.threshold()))
                stack += [node.leftChild(), node.rightChild()]
    return sorted(out)


RECORD = "rec_id string, y0 int, y1 int, x0 array<double>, x1 array<double>, s0 array<double>, s1 array<double>, t double"


def sample_boundary(rows: DataFrame, model, target: int = 750, key: str = "row_id", features: str = "features", near: int = 5, far: int = 2, secant: int = 2, bisect: int = 8, tau: float = 0.02, seed: int = 0) -> DataFrame:
    """Boundary records of a classifier, from rows to scored records: the whole chain.

    Rows are scored once; quotas say how many segments each pair of classes gets; near and far candidates come from seeds
    beside the margin, gated, scored and picked under caps; flips end each segment on the other side; measures and final
    scores follow, and round robin gives at most `target` records. `model` is what `models.scored_by` takes, or a pair
    of an expression and a function of a matrix for the flips. Rows are touched by the scoring and the seeds alone: what
    follows has some target times ten rows.
    """
    from . import models

    expression, predict = model if isinstance(model, tuple) else (model, models.matrix_function(model))
    scored_rows = stored(models.scored_by(rows.select(F.col(key).alias("row_id"), F.col(features).alias("features")), expression), "scored")
    quotas = {(r["a"], r["b"]): r["quota"] for r in pair_quotas(scored_rows, target).filter("quota > 0").collect()}
    dims = scored_rows.select(F.size("features").alias("d")).first()
    picked = constrained_pick(_candidates(scored_rows, quotas, near, far, tau, dims["d"], seed), quotas) if dims else []
    segs = rows.sparkSession.createDataFrame([(f"{c['a']}-{c['b']}-{c['i']}-{c['j']}", c["i"], c["j"]) for c in picked], "seg_id string, i string, j string")
    end = lambda side, *names: scored_rows.select(F.col("row_id").cast("string").alias(side), *[F.col(n).alias(m) for n, m in names])
    ends = segs.join(end("i", ("features", "x0"), ("p", "s0"), ("label", "y0")), "i").join(end("j", ("features", "xb"), ("label", "yb")), "j")
    ends = stored(ends, "segments")
    found = flips(ends, predict, secant, bisect).select("seg_id", "t", "x1", "s1", "y1")
    records = delta_metrics(ends.join(found, "seg_id").withColumnRenamed("seg_id", "rec_id"))
    scored_records = final_scores(stored(records, "records"))
    return round_robin(scored_records.select("*", F.least("y0", "yb").alias("a"), F.greatest("y0", "yb").alias("b"), F.round("final_score", 9).alias("score")), target, "rec_id")


def _candidates(rows: DataFrame, quotas: dict[tuple[int, int], int], near: int, far: int, tau: float, dims: int, seed: int) -> list[dict]:
    """Scored candidate segments of all pairs, both kinds: some tens for each seed, and seeds are capped."""
    out = []
    for (a, b), quota in sorted(quotas.items()):
        seeds = stored(margin_seeds(rows, a, b, most=seed_cap(quota)), "seeds")
        margin = lambda p, a=a, b=b: F.element_at(p, a + 1) - F.element_at(p, b + 1)
        one = nearest_pairs(seeds, a, b, near).select("i", "j", "d")
        other = far_pairs(seeds, a, b, far, seed=seed).select("i", "j", "d")
        side = lambda n, p: seeds.select(F.col("row_id").alias(n), F.col("p").alias(p))  # noqa: B023, E731
        both = one.unionByName(other).dropDuplicates(["i", "j"]).join(side("i", "pi"), "i").join(side("j", "pj"), "j")
        score = candidate_score(margin("pi"), margin("pj"), g.entropy(F.col("pi")), g.entropy(F.col("pj")), F.col("d"), dims)
        out += [{"a": a, "b": b, "i": str(r["i"]), "j": str(r["j"]), "score": r["score"]} for r in gated(both, a, b, tau).select("i", "j", F.round(score, 9).alias("score")).collect()]
    return out


def covariance(df: DataFrame, features: str, dims: int):
    """Means and covariance matrix of an array column, one scan: tasks add up products, a second step adds up what they give
    row by row, and the driver gets the matrix."""
    import numpy as np

    def sums(frames):
        import pandas as pd

        total = np.zeros((dims + 1, dims + 1))
        for d in frames:
            if len(d):
                x = np.hstack([np.ones((len(d), 1)), np.array(d[features].tolist(), float)])
                total += x.T @ x
        yield pd.DataFrame({"i": range(dims + 1), "v": list(total)})

    def added(frames):
        import pandas as pd

        rows: dict[int, np.ndarray] = {}
        for d in frames:
            for i, v in zip(d["i"], d["v"], strict=True):
                rows[i] = rows.get(i, 0.0) + np.asarray(v, float)
        if rows:
            yield pd.DataFrame({"i": list(rows), "v": list(rows.values())})

    schema = "i int, v array<double>"
    parts = df.select(features).mapInPandas(sums, schema).repartition(dims + 1, "i").mapInPandas(added, schema)
    m = np.zeros((dims + 1, dims + 1))
    for r in parts.collect():
        m[r["i"]] = r["v"]
    n = max(1.0, m[0, 0])
    mean = m[0, 1:] / n
    return mean, m[1:, 1:] / n - np.outer(mean, mean)


def principal_axes(df: DataFrame, features: str, dims: int, k: int = 3) -> DataFrame:
    """(component, loading, variance): the first directions of largest variance of the centred rows; the largest entry of a
    direction is positive."""
    import numpy as np

    _, cov = covariance(df, features, dims)
    values, vectors = np.linalg.eigh(cov)
    rows = []
    for c, at in enumerate(np.argsort(values)[::-1][:k]):
        own = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
        rows.append((c, own.tolist(), float(values[at])))
    return df.sparkSession.createDataFrame(rows, "component int, loading array<double>, variance double")


def projected(df: DataFrame, features: str, axes: DataFrame, dims: int) -> DataFrame:
    """Adds z: the centred rows on the axes of `principal_axes`."""
    loadings = [r["loading"] for r in axes.orderBy("component").collect()]
    means = df.agg(*[F.avg(F.element_at(features, i + 1)).alias(str(i)) for i in range(dims)]).first()
    centre = g.vector([means[str(i)] for i in range(dims)])
    return df.withColumn("z", F.array(*[g.dot(g.minus(F.col(features), centre), g.vector(v)) for v in loadings]))


def ordered_pairs(records: DataFrame, classes: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Records with y0 <= y1: ends, scores and delta are swapped where they were not; `classes` keeps pairs of these only and
    `limit` that many of the best of each pair."""
    if classes is not None:
        records = records.filter(F.col("y0").isin(*classes) & F.col("y1").isin(*classes))
    if limit is not None:
        w = Window.partitionBy(F.least("y0", "y1"), F.greatest("y0", "y1")).orderBy(F.round("final_score", 9).desc(), "rec_id")
        records = records.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= limit).drop("_rk")
    swap = F.col("y0") > F.col("y1")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return records.select("rec_id", F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"), pick("x0", "x1").alias("x0"), pick("x1", "x0").alias("x1"), *([pick("s0", "s1").alias("s0"), pick("s1", "s0").alias("s1")] if "s0" in records.columns else []), swap.alias("swapped"))


def top_variance(df: DataFrame, features: str, dims: int, k: int = 3) -> DataFrame:
    """(dim, variance) of the k dimensions of largest variance."""
    each = df.select(F.posexplode(features).alias("dim", "v")).groupBy("dim").agg(F.var_pop("v").alias("variance"))
    return each.withColumn("rk", F.row_number().over(Window.orderBy(F.round("variance", 9).desc(), "dim"))).filter(F.col("rk") <= k).select("dim", "variance")


def mean_distance(points: DataFrame, k: int = 8) -> DataFrame:
    """(y0, y1, rec_id, spacing): mean distance of a point to the k + 1 nearest of its pair, itself among them; pairs of k
    points or fewer give none. Points of a pair are boundary records, some hundreds by their quota."""
    side = lambda i, x: points.select("y0", "y1", F.col("rec_id").alias(i), F.col("x").alias(x))
    both = side("rec_id", "xa").join(side("other", "xb"), ["y0", "y1"]).select("y0", "y1", "rec_id", "other", g.norm(g.minus(F.col("xa"), F.col("xb"))).alias("d"))
    w = Window.partitionBy("y0", "y1", "rec_id")
    near = both.withColumn("rk", F.row_number().over(w.orderBy(F.round("d", 9), "other"))).withColumn("m", F.count("*").over(w))
    return near.filter((F.col("rk") <= k + 1) & (F.col("m") > k)).groupBy("y0", "y1", "rec_id").agg(F.greatest(F.avg("d"), F.lit(1e-12)).alias("spacing"))


def weighted_points(points: DataFrame, mode: str = "power", gamma: float = 2.0, temperature: float = 0.15, density_k: int | None = None) -> DataFrame:
    """Adds w: weights of each ordered pair's frontier points from their scores, summing to 1; with density_k over the
    mean distance to that many neighbours, so that crowded places do not count more."""
    pair = Window.partitionBy("y0", "y1")
    s = F.col("final_score")
    if mode == "power":
        raw = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), F.lit(gamma))
    elif mode == "sigmoid":
        raw = g.sigmoid((s - F.percentile("final_score", F.lit(0.5)).over(pair)) / temperature)
    elif mode == "softmax":
        raw = F.exp((s - F.max("final_score").over(pair)) / temperature)
    else:
        raw = s
    rows = points.withColumn("_raw", raw)
    if density_k:
        rows = rows.join(mean_distance(points, density_k), ["y0", "y1", "rec_id"], "left").withColumn("_raw", F.col("_raw") / F.coalesce("spacing", F.lit(1.0))).drop("spacing")
    whole = F.sum("_raw").over(pair)
    return rows.withColumn("w", F.when(whole > 0, F.col("_raw") / whole).otherwise(1.0 / F.count("*").over(pair))).drop("_raw")


def weighted_moments(points: DataFrame, dims: int) -> DataFrame:
    """(y0, y1, mean, cov) of each pair's points (x, w): what a weighted total-least-squares plane needs."""
    sums = [F.sum(F.col("w") * F.element_at("x", i + 1)).alias(f"m{i}") for i in range(dims)]
    cross = [F.sum(F.col("w") * F.element_at("x", i + 1) * F.element_at("x", j + 1)).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]
    rows = points.groupBy("y0", "y1").agg(F.count("*").alias("n"), *sums, *cross)
    cov = F.array(*[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}") for j in range(dims)]) for i in range(dims)])
    return rows.select("y0", "y1", "n", F.array(*[F.col(f"m{i}") for i in range(dims)]).alias("mean"), cov.alias("cov"))


def tls_planes(moments: DataFrame) -> DataFrame:
    """(y0, y1, n, b): the plane through the mean, normal to the direction of least variance; pairs of 3 points or more."""

    def fit(batches):
        import numpy as np
        import pandas as pd

        for d in batches:
            out = []
            for y0, y1, n, mean, cov in d[["y0", "y1", "n", "mean", "cov"]].itertuples(index=False):
                if n < 3:
                    continue
                c, m = np.stack([np.asarray(r, float) for r in cov]), np.asarray(mean, float)
                v = np.linalg.eigh(c)[1][:, 0]
                v = v * np.sign(v[np.argmax(np.abs(v))])
                out.append((y0, y1, v.tolist(), float(-v @ m)))
            yield pd.DataFrame(out, columns=["y0", "y1", "n", "b"])

    return moments.mapInPandas(fit, "y0 int, y1 int, n array<double>, b double")


def far_pairs(seeds: DataFrame, a: int, b: int, k: int = 2, quantile: float = 0.8, seed: int = 0, key: str = "row_id", features: str = "features") -> DataFrame:
    """(i, j, d): for each seed of class a up to k seeds of class b beyond the distance quantile, drawn by a hash."""
    side = lambda c, i, x: seeds.filter(F.col("label") == c).select(F.col(key).alias(i), F.col(features).alias(x))
    pairs = side(a, "i", "xi").join(side(b, "j", "xj")).select("i", "j", g.norm(g.minus(F.col("xi"), F.col("xj"))).alias("d"))
    cut = pairs.agg(F.percentile("d", F.lit(quantile)).alias("cut"))
    far = pairs.join(F.broadcast(cut)).filter(F.col("d") >= F.col("cut") - 1e-12).drop("cut")
    order = Window.partitionBy("i").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "i", "j")))
    return far.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).drop("rk")


def constrained_pick(candidates: list[dict], quotas: dict[tuple[int, int], int], per_origin: int = 2, per_destination: int = 2) -> list[dict]:
    """Candidates (a, b, i, j, score) chosen best first under caps: the scarcest pair of classes is served first.

    An origin serves a pair once and `per_origin` times in all, a destination `per_destination` times; pairs left short
    are filled again without the caps. A few thousand rows at most, by their quotas, so this runs on the driver.
    """
    by: dict[tuple[int, int], list[dict]] = {p: [] for p in quotas}
    for c in candidates:
        by.setdefault((c["a"], c["b"]), []).append(c)
    out, origin, goal = [], {}, {}
    for pair in sorted(quotas, key=lambda p: (len(by[p]) - quotas[p], p)):
        ranked = sorted(by[pair], key=lambda c: (-c["score"], c["i"], c["j"]))
        own, seen = [], set()
        for capped in (True, False):
            for c in ranked:
                if len(own) >= quotas[pair]:
                    break
                if any(c is o for o in own) or (capped and (c["i"] in seen or origin.get(c["i"], 0) >= per_origin or goal.get(c["j"], 0) >= per_destination)):
                    continue
                own.append(c)
                seen.add(c["i"])
                origin[c["i"]], goal[c["j"]] = origin.get(c["i"], 0) + 1, goal.get(c["j"], 0) + 1
        out += own
    return out


def frontier_sets(records: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(kind, y0, y1, x): interior points (one class) and frontier points, each once within the tolerance."""
    kind = F.when(F.col("y0") == F.col("y1"), "interior").otherwise("frontier")
    rows = records.select(kind.alias("kind"), "y0", "y1", F.col("x1").alias("x"), F.transform("x1", lambda v: F.round(v / tolerance).cast("long")).alias("_k"))
    return rows.groupBy("kind", "y0", "y1", "_k").agg(F.min("x").alias("x")).drop("_k")


def segment_arrays(records: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(a, b, u, mid, length) of segments that have a length, and w if records have it. With `changes` (rec_id, t) a segment
    ends at the mean of its change points, else at x1."""
    more = ["w"] if "w" in records.columns else []
    if changes is not None:
        mean = changes.groupBy("rec_id").agg(F.avg("t").alias("_t"))
        records = records.join(mean, "rec_id", "left").withColumn("x1", F.when(F.col("_t").isNull(), F.col("x1")).otherwise(g.lerp(F.col("x0"), F.col("xb"), F.col("_t"))))
    d = g.minus(F.col("x1"), F.col("x0"))
    rows = records.select(F.col("x0").alias("a"), F.col("x1").alias("b"), d.alias("_d"), g.norm(d).alias("length"), *more).filter("length > 1e-12")
    return rows.select(*more, "a", "b", F.transform("_d", lambda v: v / F.col("length")).alias("u"), g.lerp(F.col("a"), F.col("b"), F.lit(0.5)).alias("mid"), "length")


def residual_stats(points: DataFrame, n: list[float], b: float) -> DataFrame:
    """Mean, median, median absolute deviation and RMSE of distances from a plane."""
    rows = points.select(F.abs(g.residual(F.col("x"), g.vector(n), F.lit(b))).alias("r"))
    med = rows.agg(F.median("r").alias("med"))
    return rows.crossJoin(F.broadcast(med)).agg(F.avg("r").alias("mean"), F.median("r").alias("median"), F.median(F.abs(F.col("r") - F.col("med"))).alias("mad"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))  # one row joined
