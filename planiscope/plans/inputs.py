"""The standard inputs of the queries: lineitem as a labelled sample matrix with a planted rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["x0", "x1", "x2", "x3"]
CLASSES = [0, 1, 2]
PAIRS = [(0, 1), (0, 2), (1, 2)]

#: The same inputs in SQL.
SAMPLES_SQL = """s AS (SELECT l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3,
  CASE WHEN l_extendedprice > 60000 AND l_discount < 0.05 THEN 1 WHEN l_quantity <= 15 THEN 2 ELSE 0 END AS y FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """(x0..x3, y): quantity, price, discount and tax; class 1 is a conjunction of two cuts, class 2 one cut. And `more`."""
    y = F.when((F.col("l_extendedprice") > 60000) & (F.col("l_discount") < 0.05), 1).when(F.col("l_quantity") <= 15, 2).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), y.alias("y"), *more)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]
