"""Tables of column sets: their provenance, the best of each size, and weighted products of columns."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features as f


def top(sets: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each size, ties by name."""
    w = Window.partitionBy(F.size("features")).orderBy(F.round(score, 9).desc(), "features")
    return sets.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


def drawn(sets: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k sets of each size by a hash."""
    key = F.md5(F.concat_ws(",", F.lit(str(seed)), F.concat_ws(",", "features")))
    w = Window.partitionBy(F.size("features")).orderBy(key)
    return sets.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


def weighted_gram(df: DataFrame, columns: list[str], weight: Column) -> DataFrame:
    """(a, b, g): sums of weight times products of standardised columns, one scan after the moments."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = {c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns}
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    row = df.withColumn("_w", weight).agg(*[F.sum(F.col("_w") * z[a] * z[b]).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("g")) for a, b in pairs])).alias("e")).select("e.*")


def gram_pairs(gram: DataFrame, keep: int = 70) -> DataFrame:
    return top(gram.filter("a <> b").select(F.array_sort(F.array("a", "b")).alias("features"), F.abs("g").alias("score")), keep).select("features")


def assembled(methods: dict[str, DataFrame], cap: int | None = None) -> DataFrame:
    """(features, methods, n_methods): union of all methods' sets with their provenance; `cap` limits each method by hash."""
    out = None
    for name, sets in methods.items():
        one = (drawn(sets, cap) if cap else sets).select("features").distinct().withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("features").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.count_distinct("method").alias("n_methods"))


def annotated(sets: DataFrame, reports: DataFrame, best: int = 50) -> DataFrame:
    """(method, candidates, top_hits): sets of each method, and how many of the best reports it proposed."""
    w = Window.orderBy(F.round("score", 9).desc(), "features")
    hot = reports.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= best).select("features", F.lit(1).alias("hit"))
    each = sets.select("features", F.explode("methods").alias("method")).join(hot, "features", "left")
    return each.groupBy("method").agg(F.count("*").alias("candidates"), F.count("hit").alias("top_hits"))


def method_matrix(sets: DataFrame, methods: list[str]) -> DataFrame:
    """One row per set, one yes or no column per method."""
    return sets.select(F.concat_ws(",", "features").alias("features"), *[F.when(F.array_contains("methods", m), "yes").otherwise("no").alias(m) for m in methods])
