"""The methods that propose sets of columns, over one analysis of the table.

What depends on rows is gathered in a few scans (`analyse`, and one more scan for the methods that look at rows again); a
method then works on numbers about columns, which fit the driver whatever the rows. Sets are sorted tuples of names.
What a method draws at random is drawn by a hash of the set, the method and a seed, so that a run can be repeated.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from . import features as f
from .quantiles import percentiles

Sets = list[tuple[str, ...]]


@dataclass
class Analysis:
    """Scores of columns (mi, chi2, drop, distinct), their correlations and moments, and the rows for a closer look."""

    df: DataFrame
    columns: list[str]
    label: str
    scores: dict[str, dict[str, float]]
    corr: dict[tuple[str, str], float]
    moments: dict[str, tuple[float, float]]
    sizes: tuple[int, ...] = (2, 3)
    seed: int = 0
    sketches: dict = field(default_factory=dict)

    def ranked(self, by: str = "mi", most: int | None = None) -> list[str]:
        return sorted(self.columns, key=lambda c: (-round(self.scores[c][by], 9), c))[:most]

    def mi(self, s: Iterable[str]) -> list[float]:
        return [self.scores[c]["mi"] for c in s]

    def pair(self, a: str, b: str) -> float:
        return abs(self.corr.get((a, b), self.corr.get((b, a), 0.0)) or 0.0)

    def pairs(self, s: Iterable[str]) -> list[float]:
        return [self.pair(a, b) for a, b in itertools.combinations(s, 2)]

    def standard(self, c: str) -> Column:
        mean, sd = self.moments[c]
        return (F.col(c) - mean) / sd


def analyse(df: DataFrame, columns: list[str], label: str, bins: int = 8, sizes: tuple[int, ...] = (2, 3), seed: int = 0) -> Analysis:
    """Scores of all columns on quantile bins, their correlations and moments: a fixed number of scans for any columns."""
    cuts = percentiles(df, columns, [i / bins for i in range(1, bins)]).first()
    edges = {c: sorted({round(e, 6) for e in cuts[c]}) for c in columns}
    code = lambda c: reduce(lambda a, b: a + b, [(F.lit(e) < F.col(c)).cast("int") for e in edges[c]], F.lit(0))
    table = f.contingency(df.select(label, *[code(c).alias(c) for c in columns]), columns, label)
    rows = [r.asDict() for r in table.collect()]  # bins times classes for each column
    frame = df.sparkSession.createDataFrame([(r["feature"], r["code"], r["y"], r["o"]) for r in rows], table.schema)
    found = f.mutual_information(frame).join(f.chi_square(frame), "feature").join(f.stump_drop(df, columns, label), "feature")
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns], *[F.avg(c).alias(f"m {c}") for c in columns], *[F.stddev_pop(c).alias(f"s {c}") for c in columns]).first()
    scores = {r["feature"]: {"mi": r["mi"], "chi2": r["chi2"], "drop": r["drop"], "distinct": float(distinct[r["feature"]])} for r in found.collect()}
    corr = {(r["a"], r["b"]): r["corr"] for r in f.correlations(df, columns).collect()} if len(columns) > 1 else {}
    sd = lambda v: v if v and v > 1e-12 else 1.0
    return Analysis(df, columns, label, scores, corr, {c: (distinct[f"m {c}"] or 0.0, sd(distinct[f"s {c}"])) for c in columns}, sizes, seed)


# --------------------------------------------------------------------------- drawing and ranking


def draw(a: Analysis, sets: Iterable[tuple[str, ...]], k: int, tag: str) -> Sets:
    """k sets of each size, by a hash."""
    out: Sets = []
    for _, own in itertools.groupby(sorted(set(sets), key=lambda s: (len(s), s)), key=len):
        out += sorted(own, key=lambda s: hashlib.md5(f"{a.seed}:{tag}:{','.join(s)}".encode()).digest())[:k]
    return out


def combos(a: Analysis, pool: Iterable[str]) -> Sets:
    return [s for k in a.sizes for s in itertools.combinations(sorted(pool), k)]


def best(scored: dict[tuple[str, ...], float], k: int, per_size: bool = False) -> Sets:
    order = sorted(scored, key=lambda s: (-round(scored[s], 9), s))
    if not per_size:
        return order[:k]
    return [s for size in sorted({len(s) for s in order}) for s in [x for x in order if len(x) == size][:k]]


# --------------------------------------------------------------------------- methods on scores and correlations


def topk_random(a: Analysis, k: int = 20, draws: int = 120, spread: float = 0.15) -> Sets:
    """Draws from the most informative columns, and runs of them whose information is nearly the same."""
    order = a.ranked(most=k)
    out = draw(a, combos(a, order), draws, "topk")
    for size in a.sizes:
        for at in range(len(order) - size + 1):
            own = order[at : at + size]
            mi = a.mi(own)
            if max(mi) > 0 and (max(mi) - min(mi)) / max(mi) <= spread:
                out.append(tuple(sorted(own)))
    return out


def topk_guided(a: Analysis, k: int = 32, draws: int = 420) -> Sets:
    """Information less correlation: sum of MI - .22 sum of |corr| + .18 least MI."""
    sets = draw(a, combos(a, a.ranked(most=k)), draws, "guided")
    return best({s: sum(a.mi(s)) - 0.22 * sum(a.pairs(s)) + 0.18 * min(a.mi(s)) for s in sets}, max(20, min(45, len(a.columns))), per_size=True)


def chi2_sets(a: Analysis, k: int = 20, draws: int = 120) -> Sets:
    return draw(a, combos(a, a.ranked("chi2", k)), draws, "chi2")


def chi2_guided(a: Analysis, k: int = 28, keep: int = 40) -> Sets:
    own = {c: a.scores[c]["chi2"] + 0.45 * a.scores[c]["mi"] + 0.12 * math.log(1 + a.scores[c]["distinct"]) for c in a.columns}
    return best({s: sum(own[c] for c in s) for s in combos(a, a.ranked("chi2", k))}, keep)


def correlated(a: Analysis, threshold: float = 0.55) -> Sets:
    return [s for s in itertools.combinations(sorted(a.columns), 2) if a.pair(*s) >= threshold]


def correlated_guided(a: Analysis, threshold: float = 0.55, k: int = 36, draws: int = 320, keep: int = 60) -> Sets:
    sets = [s for s in draw(a, combos(a, a.ranked(most=k)), draws, "corr") if min(a.pairs(s)) >= 0.85 * threshold]
    return best({s: float(np.mean(a.pairs(s))) * (1 + 0.35 * sum(a.mi(s))) for s in sets}, keep)


def greedy(a: Analysis, seeds: int = 8, penalty: float = 0.18, restarts: int = 4) -> Sets:
    """From each of the best columns, add the one that most raises information less correlation; and some draws."""
    order, out = a.ranked(), set()
    for s in order[:seeds]:
        own = [s]
        while len(own) < min(max(a.sizes), len(order)):
            own.append(max((c for c in order if c not in own), key=lambda c: (round(a.scores[c]["mi"] - penalty * sum(a.pair(c, o) for o in own), 9), -order.index(c))))
            if len(own) in a.sizes:
                out.add(tuple(sorted(own)))
    return sorted(out) + draw(a, combos(a, order), restarts, "greedy")


def greedy_refined(a: Analysis, k: int = 35) -> Sets:
    """As `greedy`, with .15 variance, - .18 |covariance| and .25 log determinant of the standardised columns' covariance."""
    pool, out = a.ranked(most=k), set()
    cov = np.array([[1.0 if x == y else a.corr.get((x, y), a.corr.get((y, x))) or 0.0 for y in pool] for x in pool])

    def score(idx: list[int]) -> float:
        sub = cov[np.ix_(idx, idx)]
        sign, logdet = np.linalg.slogdet(sub + 1e-6 * np.eye(len(idx)))
        off = (np.abs(sub).sum() - np.abs(np.diag(sub)).sum()) / 2
        return sum(a.mi(pool[i] for i in idx)) + 0.15 * np.diag(sub).sum() - 0.18 * off + (0.25 * logdet if sign > 0 else 0.0)

    seeds = min(max(6, min(len(pool), 10)), len(pool))
    for size in a.sizes:
        for s in range(seeds):
            own = [s]
            while len(own) < min(size, len(pool)):
                own.append(max((i for i in range(len(pool)) if i not in own), key=lambda i: (round(score(sorted([*own, i])), 9), -i)))
            if len(own) == size:
                out.add(tuple(sorted(pool[i] for i in own)))
    return sorted(out) + draw(a, combos(a, pool), max(3, seeds // 2), "refined")


# --------------------------------------------------------------------------- methods on trees


@dataclass(frozen=True)
class Node:
    feature: int  # -1 for a leaf
    gain: float
    left: int
    right: int
    stats: tuple[float, ...]


def forest_nodes(a: Analysis, columns: list[str], trees: int, depth: int, bootstrap: bool, strategy: str = "auto", bins: int = 32) -> list[dict[int, Node]]:
    """The node tables of a random forest's trees, as the model itself writes them; trees and depth bound their size."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = a.df.sparkSession
    data = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(a.df).select("_v", F.col(a.label).cast("double").alias("_y"))
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, maxBins=bins, seed=a.seed, bootstrap=bootstrap, subsamplingRate=1.0, featureSubsetStrategy=strategy)
    path = f"{shared_dir(spark)}/forest-{hashlib.md5(repr((columns, trees, depth, bootstrap, strategy, id(a))).encode()).hexdigest()}"
    forest.fit(data).write().overwrite().save(path)
    out: dict[int, dict[int, Node]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        out.setdefault(r["treeID"], {})[r["id"]] = Node(r["split"]["featureIndex"], r["gain"], r["leftChild"], r["rightChild"], tuple(r["impurityStats"]))
    return [out[t] for t in sorted(out)]


def paths(tree: dict[int, Node]) -> Iterable[tuple[list[int], float, Node]]:
    """For every leaf the features on the way, the sum of their gains, and the leaf."""
    stack: list[tuple[int, list[int], float]] = [(0, [], 0.0)]
    while stack:
        k, way, gain = stack.pop()
        node = tree[k]
        if node.feature < 0:
            yield way, gain, node
        else:
            more = gain + max(node.gain, 0.0)
            stack += [(node.left, [*way, node.feature], more), (node.right, [*way, node.feature], more)]


def _by_leaf(a: Analysis, columns: list[str], trees: list[dict[int, Node]], score: Callable[[set[int], float, Node], float], keep: int = 70) -> Sets:
    out: dict[tuple[str, ...], float] = {}
    for tree in trees:
        for way, gain, leaf in paths(tree):
            used = set(way)
            for size in a.sizes:
                for s in itertools.combinations(sorted(columns[i] for i in used), size):
                    out[s] = max(out.get(s, 0.0), score(used, gain, leaf))
    return best(out, keep)


def forest_paths(a: Analysis, trees: int = 80, depth: int = 6, keep: int = 70) -> Sets:
    """Sets of columns that share trees of a random forest, by the number of trees."""
    count: dict[tuple[str, ...], float] = {}
    for tree in forest_nodes(a, a.columns, trees, depth, True):
        for s in combos(a, {a.columns[n.feature] for n in tree.values() if n.feature >= 0}):
            count[s] = count.get(s, 0.0) + 1
    return best(count, keep)


def forest_weighted(a: Analysis, trees: int = 80, depth: int = 6) -> Sets:
    """Sets on one path of trees grown on all rows, by the largest sum of impurity gains of a path."""
    return _by_leaf(a, a.columns, forest_nodes(a, a.columns, max(60, trees), depth, False), lambda used, gain, leaf: gain)


def random_trees(a: Analysis, trees: int = 80, depth: int = 3, draws: int = 3) -> Sets:
    """Draws from the columns of each of many shallow trees that choose among few columns and coarse thresholds at a split.

    Spark has no extremely randomised trees; one column by chance at each split, and few bins, come near them.
    """
    out: Sets = []
    for t, tree in enumerate(forest_nodes(a, a.columns, max(30, trees // 2), depth, False, "1", 8)):
        out += draw(a, combos(a, {a.columns[n.feature] for n in tree.values() if n.feature >= 0}), draws, f"tree{t}")
    return sorted(set(out))


def random_trees_refined(a: Analysis, trees: int = 80, depth: int = 3) -> Sets:
    """Sets on one path of such trees, by the largest purity of a leaf times 1 + the number of columns on its path."""
    nodes = forest_nodes(a, a.columns, max(60, trees), depth, False, "1", 8)
    return _by_leaf(a, a.columns, nodes, lambda used, gain, leaf: max(leaf.stats) / max(sum(leaf.stats), 1e-9) * (1 + len(used)))


# --------------------------------------------------------------------------- methods on directions


def _covariances(a: Analysis) -> tuple[dict, list[str]]:
    """For every class and for all rows: rows, means and covariance matrix of the columns, from one scan."""
    if "cov" not in a.sketches:
        cells = list(itertools.combinations_with_replacement(a.columns, 2))
        aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m {c}") for c in a.columns], *[F.covar_pop(x, y).alias(f"c {i}") for i, (x, y) in enumerate(cells)]]
        out = {}
        for r in [*a.df.groupBy(F.col(a.label).alias("_y")).agg(*aggs).collect(), *a.df.agg(*aggs).withColumn("_y", F.lit(None)).collect()]:
            cov = np.zeros((len(a.columns),) * 2)
            for i, (x, y) in enumerate(cells):
                j, k = a.columns.index(x), a.columns.index(y)
                cov[j, k] = cov[k, j] = r[f"c {i}"] or 0.0
            out[r["_y"]] = (r["n"], np.array([r[f"m {c}"] or 0.0 for c in a.columns]), cov)
        a.sketches["cov"] = out
    return a.sketches["cov"], a.columns


def _loadings(cov: np.ndarray, rank: int) -> np.ndarray:
    """Squared loadings of the columns on the first principal directions."""
    values, v = np.linalg.eigh(cov)
    return (v[:, np.argsort(values)[::-1][:rank]] ** 2).sum(axis=1)


def leverage_scores(a: Analysis, rank: int = 8) -> dict[str, float]:
    """Leverage of columns: squared loadings of the standardised columns on the first directions."""
    corr = np.array([[1.0 if x == y else a.corr.get((x, y), a.corr.get((y, x))) or 0.0 for y in a.columns] for x in a.columns])
    return dict(zip(a.columns, _loadings(corr, min(rank, len(a.columns))).tolist(), strict=True))


def leverage(a: Analysis, k: int = 20, draws: int = 18) -> Sets:
    own = leverage_scores(a)
    return draw(a, combos(a, sorted(own, key=lambda c: (-round(own[c], 9), c))[:k]), draws, "leverage")


def leverage_class(a: Analysis, k: int = 20, keep: int = 60) -> Sets:
    """Leverage over all rows + .65 of that within each class + 1.1 variance of class means, less .1 of differences."""
    per, _ = _covariances(a)
    rank = max(1, min(len(a.columns), 6))
    score = _loadings(per[None][2], rank)
    means = []
    for y, (n, mean, cov) in per.items():
        if y is not None and n >= 2:
            means.append(mean)
            score = score + 0.65 * _loadings(cov, min(rank, 4, len(a.columns)))
    own = dict(zip(a.columns, score + 1.1 * np.var(means, axis=0), strict=True)) if means else dict(zip(a.columns, score, strict=True))
    pool = sorted(own, key=lambda c: (-round(own[c], 9), c))[:k]
    return best({s: sum(own[c] for c in s) - 0.1 * sum(abs(own[x] - own[y]) for x, y in itertools.combinations(s, 2)) for s in combos(a, pool)}, keep)


def projections(a: Analysis, count: int, density: float, tag: str) -> list[list[float]]:
    """Sparse vectors of -1, 0 and 1 over the columns, by a hash; none is zero."""
    out = []
    for p in range(count):
        draws = [int.from_bytes(hashlib.md5(f"{a.seed}:{tag}:{p}:{c}".encode()).digest()[:8], "big") / 2**64 for c in a.columns]
        row = [0.0 if d >= density else 1.0 if d < density / 2 else -1.0 for d in draws]
        if not any(row):
            row[int(np.argmin(draws))] = 1.0
        out.append(row)
    return out


def fisher(a: Analysis, vectors: list[list[float]]) -> list[float]:
    """Variance of class means over mean class variance of the rows' projections, from the classes' covariances."""
    per, _ = _covariances(a)
    groups = [v for y, v in per.items() if y is not None]
    w = np.array(vectors)
    means, spreads = np.array([w @ m for _, m, _ in groups]), np.array([np.einsum("ij,jk,ik->i", w, c, w) for _, _, c in groups])
    return (means.var(axis=0) / (spreads.mean(axis=0) + 1e-9)).tolist()


def sparse_projection(a: Analysis, count: int = 24, density: float = 0.15, draws: int = 12) -> Sets:
    """Draws from the columns of the projections that part the classes best."""
    vectors = projections(a, count, density, "sparse")
    ratio = fisher(a, vectors)
    out: Sets = []
    for p in sorted(range(count), key=lambda p: (-round(ratio[p], 9), p))[: max(1, count // 2)]:
        used = [c for c, w in zip(a.columns, vectors[p], strict=True) if w]
        used += [c for c in a.ranked() if c not in used][: max(0, max(a.sizes) - len(used))]
        out += draw(a, combos(a, used), draws, f"sparse{p}")
    return sorted(set(out))


def sparse_projection_guided(a: Analysis, count: int = 30, density: float = 0.12, keep: int = 35) -> Sets:
    """Columns weighed by the Fisher ratios of the projections they are in; the heaviest sets, and draws from the best projections."""
    vectors = projections(a, count, density, "guided")
    ratio = fisher(a, vectors)
    weight = {c: sum(r for r, v in zip(ratio, vectors, strict=True) if v[i]) for i, c in enumerate(a.columns)}
    out = best({s: sum(weight[c] for c in s) for s in combos(a, a.columns)}, keep, per_size=True)
    for p in sorted(range(count), key=lambda p: (-round(ratio[p], 9), p))[:10]:
        used = [c for c, w in zip(a.columns, vectors[p], strict=True) if w]
        used += [c for c in a.ranked() if c not in used][: max(0, max(a.sizes) - len(used))]
        out += draw(a, combos(a, used), 6, f"guided{p}")
    return sorted(set(out))


# --------------------------------------------------------------------------- methods on hashes of rows


def _codes(a: Analysis, parts: int) -> DataFrame:
    """The label and each column's quantile code of `parts` parts."""
    cuts = percentiles(a.df, a.columns, [i / parts for i in range(1, parts)]).first()
    return a.df.select(F.col(a.label).alias("y"), *[reduce(lambda x, y: x + y, [(F.lit(round(e, 6)) < F.col(c)).cast("int") for e in cuts[c]], F.lit(0)).alias(c) for c in a.columns])


def sketch_shares(a: Analysis, sets: Sets, parts: int, primes: tuple[int, ...], buckets: int = 257) -> dict[tuple[str, ...], list[float]]:
    """For each set and class the share of the fullest bucket, in falling order; one scan for all sets."""
    h = lambda s: reduce(lambda x, y: x.bitwiseXOR(y), [((F.col(c) + 1) * p % buckets).cast("int") for c, p in zip(s, itertools.cycle(primes))])  # noqa: E731, B905
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), h(s).alias("h")) for i, s in enumerate(sets)]))
    counts = _codes(a, parts).select("y", each.alias("e")).groupBy("e.s", "y", "e.h").agg(F.count("*").alias("n"))
    out: dict[tuple[str, ...], list[float]] = {}
    for r in counts.groupBy("s", "y").agg((F.max("n") / F.sum("n")).alias("share")).collect():
        out.setdefault(sets[r["s"]], []).append(r["share"])
    return {s: sorted(v, reverse=True) for s, v in out.items()}


def count_sketch(a: Analysis, most: int = 180, least: float = 0.55) -> Sets:
    """Sets of which some class has a bucket of at least `least` of its rows; a bucket is a hash of quartile codes."""
    shares = sketch_shares(a, draw(a, combos(a, a.columns), most, "sketch"), 4, (3, 5, 7))
    return sorted(s for s, v in shares.items() if v[0] >= least)


def count_sketch_refined(a: Analysis, most: int = 220, keep: int = 80, k: int = 30) -> Sets:
    """Sets by the largest share + .6 of its lead over the next class, on quintile codes."""
    shares = sketch_shares(a, draw(a, combos(a, a.ranked(most=k)), most, "sketch2"), 5, (3, 5, 7, 11, 13, 17, 19, 23, 29, 31))
    return best({s: v[0] + 0.6 * (v[0] - v[1] if len(v) > 1 else v[0]) for s, v in shares.items()}, keep)


def minhash(a: Analysis, masks: dict[str, Column], key: str, perms: int, band: int) -> set[tuple[str, str]]:
    """Pairs of masks whose rows share a band of least hashes; one scan, `perms` longs for each mask."""
    hashes = [F.min(F.when(m, F.xxhash64(key, F.lit(p)))).alias(f"{i} {p}") for i, m in enumerate(masks.values()) for p in range(perms)]
    row = a.df.agg(*hashes).first()
    names, found = list(masks), set()
    for lo in range(0, perms - band + 1, band):
        bands: dict[tuple, list[str]] = {}
        for i, name in enumerate(names):
            own = tuple(row[f"{i} {p}"] for p in range(lo, lo + band))
            if None not in own:
                bands.setdefault(own, []).append(name)
        for same in bands.values():
            found |= set(itertools.combinations(sorted(same), 2))
    return found


def _masked(a: Analysis, masks: dict[str, tuple[str, Column]], perms: int) -> dict[tuple[str, ...], tuple[float, float]]:
    """For sets of columns grown from colliding masks: recall times precision of the masks' conjunction, best and second class."""
    key = "_row"
    rows = a.df.withColumn(key, F.xxhash64(*a.columns))
    own = Analysis(rows, a.columns, a.label, a.scores, a.corr, a.moments, a.sizes, a.seed)
    hit = minhash(own, {n: m for n, (_, m) in masks.items()}, key, perms, 4)
    groups = {p for p in hit if masks[p[0]][0] != masks[p[1]][0]}
    for _ in range(2, max(a.sizes)):
        groups |= {tuple(sorted({*g, n})) for g in groups for p in hit for n in p if set(p) & set(g) and masks[n][0] not in {masks[x][0] for x in g}}
    groups = sorted(g for g in groups if len(g) in a.sizes)
    if not groups:
        return {}
    both = [reduce(lambda x, y: x & y, [masks[n][1] for n in g]) for g in groups]
    counts = rows.groupBy(F.col(a.label).alias("y")).agg(F.count("*").alias("n"), *[F.sum(F.when(b, 1).otherwise(0)).alias(f"g{i}") for i, b in enumerate(both)]).collect()
    out: dict[tuple[str, ...], tuple[float, float]] = {}
    for i, g in enumerate(groups):
        inside = sum(r[f"g{i}"] for r in counts)
        per = sorted(((r[f"g{i}"] / r["n"]) * (r[f"g{i}"] / max(1, inside)) for r in counts), reverse=True)
        s = tuple(sorted({masks[n][0] for n in g}))
        out[s] = max(out.get(s, (0.0, 0.0)), (per[0], per[1] if len(per) > 1 else 0.0))
    return out


def minhash_sets(a: Analysis, perms: int = 20, least: float = 0.05) -> Sets:
    """Sets of columns whose upper halves share a band of least hashes, if their conjunction tells a class."""
    cut = percentiles(a.df, a.columns, [0.5]).first()
    found = _masked(a, {c: (c, F.col(c) >= cut[c][0]) for c in a.columns}, perms)
    return sorted(s for s, (v, _) in found.items() if v >= least)


def minhash_refined(a: Analysis, perms: int = 24, keep: int = 80) -> Sets:
    """As `minhash_sets` with an upper and a lower mask of each column, by the best class + .5 of its lead."""
    cut = percentiles(a.df, a.columns, [0.4, 0.6]).first()
    masks = {f"{c} high": (c, F.col(c) > cut[c][1]) for c in a.columns} | {f"{c} low": (c, F.col(c) < cut[c][0]) for c in a.columns}
    return best({s: v + 0.5 * (v - w) for s, (v, w) in _masked(a, masks, perms).items()}, keep)


# --------------------------------------------------------------------------- methods on gradients


def gradients(a: Analysis, columns: list[str], c: float) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices of the standardised columns, weighed by the norm of a logistic regression's gradient and by its
    curvature: one fit and one scan."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = a.df.select(F.col(a.label).cast("double").alias("_y"), *[a.standard(x).alias(x) for x in columns])
    data = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(rows)
    n = data.count()
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / (c * max(1, n)), standardization=False, maxIter=200).fit(data)
    p = vector_to_array("probability")
    scored = model.transform(data).withColumn("_p", p)
    grad = F.sqrt(F.aggregate(F.transform("_p", lambda v, k: F.pow(v - F.when(k == F.col("_y").cast("int"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda x, y: x + y))
    curve = F.aggregate(F.transform("_p", lambda v: v * (1 - v)), F.lit(0.0), lambda x, y: x + y)
    cells = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    weighed = scored.select(*columns, grad.alias("_g"), curve.alias("_h"))
    row = weighed.agg(*[F.sum(F.col(w) * F.col(columns[i]) * F.col(columns[j])).alias(f"{w} {i} {j}") for w in ("_g", "_h") for i, j in cells]).first()
    out = []
    for w in ("_g", "_h"):
        m = np.zeros((len(columns),) * 2)
        for i, j in cells:
            m[i, j] = m[j, i] = row[f"{w} {i} {j}"] or 0.0
        out.append(m)
    return out[0], out[1]


def _synergy(a: Analysis, columns: list[str], score: np.ndarray, gram: np.ndarray, pairs: int, draws: int, tag: str) -> Sets:
    order = sorted(itertools.combinations(range(len(columns)), 2), key=lambda p: (-round(float(score[p]), 6), p))[:pairs]
    out = {tuple(sorted((columns[i], columns[j]))) for i, j in order} if 2 in a.sizes else set()
    for size in (k for k in a.sizes if 2 < k <= len(columns)):
        for i, j in order:
            reach = np.abs(gram[i] + gram[j])
            rest = sorted((k for k in range(len(columns)) if k not in (i, j)), key=lambda k: (-round(float(reach[k]), 6), k))
            out.add(tuple(sorted(columns[k] for k in (i, j, *rest[: size - 2]))))
    return sorted(out | set(draw(a, combos(a, columns), draws, tag)))


def gradient_synergy(a: Analysis, k: int = 40) -> Sets:
    """Pairs by gradient-weighted products of columns, widened by the columns that go with both; and some draws."""
    columns = a.ranked(most=k)
    g, _ = gradients(a, columns, 1.0)
    return _synergy(a, columns, np.abs(g), g, 70, 10, "gradient")


def gradient_hessian(a: Analysis, k: int = 40) -> Sets:
    """As `gradient_synergy`, plus .35 of the curvature-weighted products."""
    columns = a.ranked(most=k)
    g, h = gradients(a, columns, 0.8)
    return _synergy(a, columns, np.abs(g) + 0.35 * np.abs(h), g, 90, 12, "hessian")


#: All methods, by number and name; a letter marks the second form of one idea.
METHODS: dict[str, Callable[[Analysis], Sets]] = {
    "1 topk_random": topk_random, "1b topk_guided": topk_guided, "2 chi2": chi2_sets, "2b chi2_guided": chi2_guided, "3 correlated": correlated, "3b correlated_guided": correlated_guided,
    "4 forest_paths": forest_paths, "4b forest_weighted": forest_weighted, "5 leverage": leverage, "5b leverage_class": leverage_class, "6 sparse_projection": sparse_projection,
    "6b sparse_projection_guided": sparse_projection_guided, "7 greedy": greedy, "7b greedy_refined": greedy_refined, "8 random_trees": random_trees, "8b random_trees_refined": random_trees_refined,
    "9 count_sketch": count_sketch, "9b count_sketch_refined": count_sketch_refined, "10 gradient_synergy": gradient_synergy, "10b gradient_hessian": gradient_hessian, "11 minhash": minhash_sets, "11b minhash_refined": minhash_refined,
}
DEFAULT = "8 random_trees"


def proposed(a: Analysis, methods: Iterable[str] = (DEFAULT,), cap: int | None = None, most: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(features, methods, n_methods) of the sets that the methods propose, and each method's seconds.

    `cap` limits each method and `most` all of them, by a hash. A method that fails on the data (a class missing, say)
    raises: nothing is passed over.
    """
    import time

    sets: dict[tuple[str, ...], list[str]] = {}
    took: dict[str, float] = {}
    for name in methods:
        began = time.perf_counter()
        own = sorted(set(METHODS[name](a)))
        if cap:
            own = sorted(own, key=lambda s: hashlib.md5(f"{a.seed}:{name}:{','.join(s)}".encode()).digest())[:cap]
        for s in own:
            sets.setdefault(s, []).append(name)
        took[name] = time.perf_counter() - began
    chosen = sorted(sets, key=lambda s: (hashlib.md5(f"{a.seed}:{','.join(s)}".encode()).digest() if most else b"", s))[:most]
    rows = [(list(s), sorted(sets[s]), len(sets[s])) for s in sorted(chosen)]
    return a.df.sparkSession.createDataFrame(rows, "features array<string>, methods array<string>, n_methods int"), took
