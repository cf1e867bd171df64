"""Selections of planes built from the data, and the pruning pipeline over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import cells as cell_ops
from . import planes as p
from .cells import HalfSpace
from .quantiles import percentiles


def threshold_selection(samples: DataFrame, features: list[str], pairs: list[tuple[int, int]], count: int = 15) -> DataFrame:
    """(pair_a, pair_b, feature, q, threshold): every quantile cut of every feature for every pair of classes."""
    cuts = p.quantile_cuts(samples, features, count)
    rows = [(a, b, f, q, t) for a, b in pairs for f, own in enumerate(cuts) for q, t in enumerate(own)]
    return samples.sparkSession.createDataFrame(rows, "pair_a int, pair_b int, feature int, q int, threshold double")


def _means(samples: DataFrame, features: list[str], label: str) -> DataFrame:
    wide = samples.groupBy(F.col(label).alias("y")).agg(*[F.avg(f).alias(f) for f in features])
    return wide.select("y", F.posexplode(F.array(*features)).alias("dim", "m"))


def mean_gap_selection(samples: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """For each pair of classes the axis of largest gap of means, cut half-way; side 1 if the first class is below."""
    m = _means(samples, features, label)
    a, b = m.alias("a"), m.alias("b")
    gaps = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.y") < F.col("b.y"))).select(F.col("a.y").alias("pair_a"), F.col("b.y").alias("pair_b"), F.col("a.dim").alias("dim"), F.col("a.m").alias("ma"), F.col("b.m").alias("mb"))
    order = Window.partitionBy("pair_a", "pair_b").orderBy(F.round(F.abs(F.col("ma") - F.col("mb")), 9).desc(), "dim")
    best = gaps.withColumn("rk", F.row_number().over(order)).filter("rk = 1")
    return best.select("pair_a", "pair_b", "dim", ((F.col("ma") + F.col("mb")) / 2).alias("threshold"), F.when(F.col("ma") <= F.col("mb"), 1).otherwise(-1).alias("side"))


def orient_by_means(samples: DataFrame, planes: list[HalfSpace], features: list[str], pairs: list[tuple[int, int]], label: str = "y") -> DataFrame:
    """(plane_id, pair_a, pair_b, side, score): the side with score = mean of a inside + mean of b outside."""
    cells = cell_ops.histogram(samples, [h.column(features) for h in planes], label)
    inside = cell_ops.membership(cells, len(planes))
    pos = cells.groupBy("y").agg(F.sum("cnt").alias("pos"))
    ids = samples.sparkSession.createDataFrame([(k, h.plane_id) for k, h in enumerate(planes)], "k int, plane_id string")
    share = ids.crossJoin(F.broadcast(pos)).join(inside, ["k", "y"], "left").select("plane_id", "y", (F.coalesce("cnt", F.lit(0)) / F.col("pos")).alias("s"))
    which = samples.sparkSession.createDataFrame(pairs, "pair_a int, pair_b int")
    a, b = share.alias("a"), share.alias("b")
    both = which.join(a, F.col("a.y") == F.col("pair_a")).join(b, (F.col("b.y") == F.col("pair_b")) & (F.col("b.plane_id") == F.col("a.plane_id")))
    low = F.col("a.s") + 1 - F.col("b.s")
    high = 1 - F.col("a.s") + F.col("b.s")
    return both.select(F.col("a.plane_id").alias("plane_id"), "pair_a", "pair_b", F.when(low >= high, 1).otherwise(-1).alias("side"), F.greatest(low, high).alias("score"))


def axis_frontier(samples: DataFrame, features: list[str], pairs: list[tuple[int, int]], between: int = 2, digits: int = 4, label: str = "y") -> DataFrame:
    """Distinct cuts per pair and axis: `between` even steps between the class means and the pair's quartiles."""
    m = _means(samples, features, label)
    out = None
    # each row belongs to the pairs of its class: one table of quartiles for all pairs
    which = F.array_compact(F.array(*[F.when(F.col(label).isin(a, b), F.lit(i)) for i, (a, b) in enumerate(pairs)]))
    quartiles = percentiles(samples.select(*features, F.explode(which).alias("pair")), features, [0.25, 0.5, 0.75], ("pair",))
    quartiles = quartiles.select("pair", F.posexplode(F.array(*features)).alias("dim", "q"))
    steps = F.array(*[F.lit((i + 1) / (between + 1)) for i in range(between)])
    for i, (pa, pb) in enumerate(pairs):
        q = quartiles.filter(F.col("pair") == i).drop("pair")
        ma, mb = m.filter(F.col("y") == pa).select("dim", F.col("m").alias("ma")), m.filter(F.col("y") == pb).select("dim", F.col("m").alias("mb"))
        cuts = ma.join(mb, "dim").join(q, "dim").select(F.lit(pa).alias("pair_a"), F.lit(pb).alias("pair_b"), "dim", F.explode(F.concat(F.transform(steps, lambda t: F.col("ma") + (F.col("mb") - F.col("ma")) * t), "q")).alias("t"))
        out = cuts if out is None else out.unionByName(cuts)
    return out.select("pair_a", "pair_b", "dim", F.round("t", digits).alias("threshold")).distinct()


def prune_and_orient(samples: DataFrame, bank: list[HalfSpace], features: list[str], label: str = "y", top_k: int = 200, tau: float = 0.01, **guard) -> DataFrame:
    """The whole selection: one histogram scan, metrics, guardrails, top-K per class, families, best per family and side.

    Returns (hs_id, oriented_id, family, side, target_class, score and metrics) of candidates whose half-space is the
    best of its family and side.
    """
    spark = samples.sparkSession
    cells = stored(cell_ops.histogram(samples, [h.column(features) for h in bank], label), "cells")
    scored = p.with_metrics(p.confusion(cells, len(bank)))
    spaces = p.normalized(p.half_space_table(spark, bank))
    edges = p.family_edges(spaces, p.region_jaccard(cells, len(bank)), tau=tau)
    family = p.families(spaces.select("hs_id"), edges)
    best = p.best_per_family_side(scored, spaces, family)
    top = p.top_per_class(p.guardrails(scored, **guard), top_k)
    return best.select("hs_id", "oriented_id", "family", "side").join(top, "hs_id").withColumnRenamed("y", "target_class")
