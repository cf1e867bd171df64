"""Cross-validated scores of column sets, and the explorer and bundle over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features as f
from . import generators as g

REPORT = "features string, size int, score double, score_sd double, coverage double"


def with_folds(df: DataFrame, label: str, key: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """Adds fold: rows are dealt out by a hash of their key, each class alike; nothing is gathered for it."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, label, F.lit(seed)), F.lit(folds)).cast("int"))


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (with a bias row) of an L2-regularised softmax regression, by Newton-like steps of bounded curvature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], classes))
    target = np.eye(classes)[y]
    penalty = np.full(x.shape[1], 1 / c)
    penalty[-1] = 1e-6
    h = np.linalg.inv(0.5 * x.T @ x + np.diag(penalty))  # an upper bound of the curvature: every step descends
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = h @ (x.T @ (p - target) + penalty[:, None] * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def macro_f1(y: np.ndarray, p: np.ndarray, classes: int) -> float:
    out = []
    for k in range(classes):
        tp = ((y == k) & (p == k)).sum()
        out.append(2 * tp / max(1, (y == k).sum() + (p == k).sum()))
    return float(np.mean(out))


def cross_validated(df: DataFrame, sets: list[list[str]], label: str = "y", folds: int = 3, key: str = "row_id") -> DataFrame:
    """REPORT rows: mean and deviation of macro F1 over folds, and the share of classes ever predicted.

    Each column set is one task over its own columns of a sample of bounded size; take it with adaptive_sample before.
    Labels are 0..K-1.
    """
    names = sorted({c for s in sets for c in s})
    rows = with_folds(df, label, key, folds).select(F.col(label).cast("int").alias("_y"), "fold", *[F.col(c).cast("double").alias(c) for c in names])
    which = F.explode(F.array(*[F.lit(",".join(s)) for s in sets]))

    def one(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        cols = key[0].split(",")
        d = d.sort_values([*cols, "_y", "fold"])
        x, y, fold = d[cols].to_numpy(), d["_y"].to_numpy(), d["fold"].to_numpy()
        classes, scores, seen = int(y.max()) + 1, [], set()
        for k in range(folds):
            a, b = fold != k, fold == k
            if not a.any() or not b.any():
                continue
            mu, sd = x[a].mean(axis=0), x[a].std(axis=0)
            sd = np.where(sd < 1e-12, 1.0, sd)
            w = softmax_regression((x[a] - mu) / sd, y[a], classes)
            p = (np.hstack([(x[b] - mu) / sd, np.ones((b.sum(), 1))]) @ w).argmax(axis=1)
            scores.append(macro_f1(y[b], p, classes))
            seen |= set(p.tolist())
        return pd.DataFrame([(key[0], len(cols), float(np.mean(scores)), float(np.std(scores)), len(seen) / classes)], columns=["features", "size", "score", "score_sd", "coverage"])

    return rows.select("*", which.alias("_set")).groupBy("_set").applyInPandas(one, REPORT)


PRESETS = ("proxy_microcv", "high_quality", "fast", "auto", "ultra_fast")


def chosen(sets: DataFrame, scores: DataFrame, preset: str, budget: int, columns: int) -> DataFrame:
    """The sets worth validating, with proxy and mean_mi: all (high_quality), the `budget` best by proxy (proxy_microcv),
    four fifths of it best and the rest drawn (fast); auto is high_quality for few columns, else proxy_microcv."""
    ranked = f.proxy_scores(sets, scores)
    preset = ("high_quality" if columns <= 8 else "proxy_microcv") if preset == "auto" else preset
    if preset in ("high_quality", "ultra_fast"):
        return ranked
    order = Window.orderBy(F.round("proxy", 9).desc(), "features")  # sets of columns, not rows
    placed = ranked.withColumn("place", F.row_number().over(order))
    if preset == "proxy_microcv":
        return placed.filter(F.col("place") <= budget).drop("place")
    sure = max(1, int(0.8 * budget))
    drawn = Window.orderBy((F.col("place") <= sure).desc(), F.md5(F.concat_ws(",", "features")))
    return placed.withColumn("turn", F.row_number().over(drawn)).filter((F.col("place") <= sure) | (F.col("turn") <= budget)).drop("place", "turn")


def explore(
    df: DataFrame, columns: list[str], label: str = "y", sizes: tuple[int, ...] = (2, 3), budget: int = 60, keep: int | None = 10, key: str = "row_id", preset: str = "proxy_microcv",
    methods: tuple[str, ...] = (g.DEFAULT,), analysis: g.Analysis | None = None, folds: int = 3, cap: int | None = None,
) -> DataFrame:
    """Column sets by cross-validated macro F1 (REPORT, methods and proxy): an adaptive sample is analysed, `methods` propose
    sets, a preset chooses which are validated, and a diverse pick keeps `keep`. ultra_fast scores by mean mutual
    information and validates nothing. `analysis`, once made by `generators.analyse`, serves several calls."""
    if preset not in PRESETS:
        raise ValueError(f"preset: {preset}")
    part = analysis.df if analysis else f.adaptive_sample(df, key, len(columns)).cache()
    own = analysis or g.analyse(part, columns, label, sizes=sizes)
    sets, _ = g.proposed(own, methods, cap)
    scores = part.sparkSession.createDataFrame([(c, float(v["mi"])) for c, v in own.scores.items()], "feature string, mi double")
    picked = chosen(sets.select("features"), scores, preset, budget, len(columns))
    proxies = picked.select(F.concat_ws(",", "features").alias("features"), F.size("features").alias("size"), "proxy", "mean_mi")
    if preset == "ultra_fast":
        reports = proxies.withColumn("score", F.col("mean_mi"))
    else:
        wanted = [r["features"] for r in picked.select("features").collect()]
        reports = cross_validated(part, wanted, label, folds, key).join(proxies.drop("size"), "features")
    named = sets.select(F.concat_ws(",", "features").alias("features"), "methods")
    out = reports.drop("mean_mi").join(named, "features")
    return f.diverse_pick(out.withColumn("id", F.col("features")), keep or 1 << 30).drop("id")


#: The methods that a bundle runs together, and its limits.
BUNDLE = ("8 random_trees", "10b gradient_hessian", "1b topk_guided", "10 gradient_synergy", "6b sparse_projection_guided")


def bundle(df: DataFrame, columns: list[str], label: str = "y", key: str = "row_id", cap: int = 120, keep: int | None = None, methods: tuple[str, ...] = BUNDLE, preset: str = "proxy_microcv") -> tuple[DataFrame, DataFrame]:
    """Reports over the sets of all the bundle's methods on one sample and one analysis, and its summary by method."""
    part = f.adaptive_sample(df, key, len(columns)).cache()
    own = g.analyse(part, columns, label)
    sets, took = g.proposed(own, methods, cap)
    reports = explore(part, columns, label, key=key, methods=methods, analysis=own, keep=keep, cap=cap, preset=preset)
    return reports, bundle_summary(sets, reports, took)


def bundle_summary(sets: DataFrame, reports: DataFrame, took: dict[str, float]) -> DataFrame:
    """(method, candidates, selected, best_score, seconds): what each method proposed and how much of it was reported."""
    seconds = sets.sparkSession.createDataFrame([(m, float(s)) for m, s in took.items()], "method string, seconds double")
    each = sets.select(F.concat_ws(",", "features").alias("features"), F.explode("methods").alias("method")).join(reports.select("features", "score"), "features", "left")
    out = each.groupBy("method").agg(F.count("*").alias("candidates"), F.count("score").alias("selected"), F.max("score").alias("best_score"))
    return seconds.join(out, "method", "left").na.fill(0, ["candidates", "selected"]).select("method", "candidates", "selected", "best_score", "seconds")


def calibrated_proxy(sets: DataFrame, scores: DataFrame, baseline: float, classes: int) -> DataFrame:
    """Adds calibrated: mean mutual information times 1 + the majority baseline times log(1 + classes)."""
    import math

    return f.proxy_scores(sets, scores).withColumn("calibrated", F.col("mean_mi") * (1 + baseline) * math.log(1 + classes))


def set_summary(sets: DataFrame, reports: DataFrame) -> DataFrame:
    """(features, n_methods, score, place): sets by the number of methods that propose them, then by score."""
    named = sets.select(F.concat_ws(",", "features").alias("features"), "n_methods").join(reports.select("features", "score"), "features", "left")
    order = Window.orderBy(F.col("n_methods").desc(), F.round("score", 9).desc_nulls_last(), "features")
    return named.withColumn("place", F.row_number().over(order))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sets that only one of two runs proposes; empty if a bundle's method gives what it gives alone."""
    key = F.concat_ws(",", "features").alias("features")
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("only_in", F.lit("a")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("b")))


def preset_matrix(runs: list[tuple[str, g.Analysis]], methods: tuple[str, ...] = ("1b topk_guided",), budget: int = 60, key: str = "row_id", folds: int = 2) -> DataFrame:
    """(preset, size, reports, best_score): each preset over its analysis, nothing left out of the reports."""
    out = None
    for preset, own in runs:
        found = explore(own.df, own.columns, own.label, budget=budget, keep=None, key=key, preset=preset, methods=methods, analysis=own, folds=folds)
        one = found.groupBy("size").agg(F.count("*").alias("reports"), F.max("score").alias("best_score")).select(F.lit(preset).alias("preset"), "size", "reports", "best_score")
        out = one if out is None else out.unionByName(one)
    return out


def hyper_grid(options: dict[str, list], draws: int | None = None, seed: int = 0, done: frozenset[str] = frozenset()) -> list[dict]:
    """All combinations of the options, or `draws` of them by a hash, without those whose key is already done."""
    import hashlib
    import itertools

    rows = [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]
    if draws is not None:
        rows = sorted(rows, key=lambda r: hashlib.md5(f"{seed}:{grid_key(r)}".encode()).digest())[:draws]
    return [r for r in rows if grid_key(r) not in done]


def grid_key(row: dict) -> str:
    return ",".join(f"{k}={row[k]}" for k in sorted(row))
