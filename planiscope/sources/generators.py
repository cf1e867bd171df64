"""Synthetic labelled samples, generated on the executors from row numbers and seeds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(key: Column, stream: int, seed: int) -> Column:
    """A standard normal number that depends on the row, the stream and the seed alone, whatever the partitioning."""
    uniform = lambda k: (F.pmod(F.xxhash64(key, F.lit(stream), F.lit(k), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def corner_classes(spark: SparkSession, n_per_cluster: int = 150, std_class1: float = 0.4, std_other: float = 0.7, a: float = 3.0, seed: int = 42) -> DataFrame:
    """(row_id, x1..x4, y): eight Gaussian blobs in four dimensions; class 1 sits on six corners of a cube."""
    corners = [(s, t, u) for s in (-a, a) for t in (-a, a) for u in (-a, a)][:6]
    centres = [(0.0, 2.5, 0.5, 0.0, 0, std_other), *[(*c, 0.0, 1, std_class1) for c in corners], (-2.5, -1.5, -0.5, 1.0, 2, std_other)]
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(f"c{i}") for i, v in enumerate(c[:4])], F.lit(c[4]).alias("y"), F.lit(c[5]).alias("sd")) for c in centres])
    rows = spark.range(len(centres) * n_per_cluster).select(F.col("id").alias("row_id"), F.element_at(table, (F.col("id") % len(centres) + 1).cast("int")).alias("c"))
    return rows.select("row_id", *[(F.col(f"c.c{i}") + F.col("c.sd") * _normal(F.col("row_id"), i, seed)).alias(f"x{i + 1}") for i in range(4)], F.col("c.y").alias("y"))


def high_dimensional(spark: SparkSession, n: int = 30_000, features: int = 25, informative: int = 18, redundant: int = 2, classes: int = 3, sep: float = 1.8, seed: int = 42) -> DataFrame:
    """(row_id, f1.., y): two clusters a class on corners of a cube of half-width sep, redundant mixtures, then noise."""
    clusters = 2 * classes
    y = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clusters))
    rows = spark.range(n).select(F.col("id").alias("row_id"), y.cast("int").alias("k"))
    key = F.col("row_id")
    corner = lambda i: F.when(F.pmod(F.xxhash64("k", F.lit(i), F.lit(seed)), F.lit(2)) == 0, -sep).otherwise(sep)
    own = [(corner(i) + _normal(key, i, seed)).alias(f"f{i + 1}") for i in range(informative)]
    rows = rows.select("row_id", (F.col("k") % classes).alias("y"), *own)
    mixes = [reduce(lambda p, q: p + q, [F.col(f"f{i + 1}") * math.cos(1 + i * (r + 1)) for i in range(informative)]).alias(f"f{informative + r + 1}") for r in range(redundant)]
    noise = [_normal(key, 1000 + j, seed).alias(f"f{j + 1}") for j in range(informative + redundant, features)]
    return rows.select("*", *mixes, *noise)


def passengers(spark: SparkSession, n: int = 600, seed: int = 42) -> DataFrame:
    """(row_id, mixed columns, survived): a synthetic passenger list whose survival is logistic in them."""
    key = F.col("id")
    u = lambda s: (F.pmod(F.xxhash64(key, F.lit(s), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = spark.range(n).select(
        key.alias("row_id"), F.when(u(1) < 0.24, 1).when(u(1) < 0.45, 2).otherwise(3).alias("pclass"), F.when(u(2) < 0.65, "male").otherwise("female").alias("sex"), F.greatest(F.lit(1.0), 29 + 14 * _normal(key, 3, seed)).alias("age"),
        F.floor(u(4) * u(4) * 5).cast("int").alias("sibsp"), F.floor(u(5) * u(5) * 4).cast("int").alias("parch"), F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("Q")), (F.floor(u(6) * u(6) * 3) + 1).cast("int")).alias("embarked"), u(7).alias("_u"),
    )
    rows = rows.withColumn("fare", F.exp(4.4 - 0.9 * F.col("pclass") + 0.5 * _normal(F.col("row_id"), 8, seed))).withColumn("alone", (F.col("sibsp") + F.col("parch")) == 0)
    z = 2.2 - 0.8 * F.col("pclass") + F.when(F.col("sex") == "female", 2.4).otherwise(0.0) - 0.02 * F.col("age") - 0.3 * F.col("sibsp")
    return rows.withColumn("survived", (F.col("_u") < 1 / (1 + F.exp(-z + 1))).cast("int")).drop("_u")


def family_pool(spark: SparkSession, families: int = 20, members: int = 10, dims: int = 4, jitter: float = 1e-4, seed: int = 0) -> DataFrame:
    """(hs_id, planted, n, b): planes jittered around planted ones, to test families."""
    rows = spark.range(families * members).select(F.col("id").cast("int").alias("hs_id"), F.floor(F.col("id") / members).cast("int").alias("planted"))
    base = lambda i: _normal(F.col("planted"), i, seed)
    n = F.array(*[base(i) + jitter * _normal(F.col("hs_id"), 50 + i, seed) for i in range(dims)])
    return rows.select("hs_id", "planted", n.alias("n"), (base(dims) + jitter * _normal(F.col("hs_id"), 99, seed)).alias("b"))
