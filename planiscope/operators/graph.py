"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node reachable.

    Large-star and small-star steps take turns until no pair changes; rounds grow with the logarithm of the nodes, however
    long a chain is. Pairs are written after each round, only a count and a sum reach the driver.
    """
    pairs = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "pairs")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # written first, so that a node of very many edges is a skewed join of plain tables, which Spark splits
        least = stored(both.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("m", "hi")), "least")
        large = stored(both.join(least, "hi").filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct(), "large")
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        ends = F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        pairs = stored(large.join(least, "hi").select(ends.alias("p")).select("p.hi", "p.lo").filter("hi != lo").distinct(), "pairs")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = now
