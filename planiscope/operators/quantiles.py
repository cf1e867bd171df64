"""Exact percentiles by bracketing: a sketch says roughly where they lie, a second scan counts only what lies there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of the sketch is one over this; a bracket reaches two errors to either side.
ACCURACY = 2000


def percentiles(df: DataFrame, columns: list[str], at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., columns...): for each group and column the interpolated percentiles `at` as an array, nulls and NaN left out.

    Gives what the exact percentile aggregate gives, whose state holds every distinct value of a column. Here the state
    of the first scan is a sketch, and that of the second the distinct values within its brackets, some 4 / ACCURACY of
    the rows for each percentile. Groups are few: their sketches are sent to every task.
    """
    keys = [F.col(k) for k in by]
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    low, high = ([min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in at] for s in (-1, 1))
    probe = F.array(*[F.lit(p) for p in low + high])
    sketch = df.groupBy(*keys).agg(*[F.percentile_approx(value[c], probe, ACCURACY).alias(f"_s{i}") for i, c in enumerate(columns)], *[F.count(value[c]).alias(f"_n{i}") for i, c in enumerate(columns)])
    k = len(at)
    if not by:
        return _ungrouped(df, columns, at, sketch.first())
    rows = df.select(*keys, *[value[c].alias(f"_v{i}") for i, c in enumerate(columns)]).join(F.broadcast(sketch), list(by))
    return _counted(rows, [F.col(f"_s{i}") for i in range(len(columns))], columns, at, keys)


def _ungrouped(df: DataFrame, columns: list[str], at: list[float], row) -> DataFrame:
    """Percentiles without groups. Where both ends of a bracket are one value, that is the percentile: of columns with few
    values hardly anything is left to count. For the other brackets one scan counts what is below and one what is inside."""
    k, spark = len(at), df.sparkSession
    known: dict[tuple[int, int], float] = {}
    left: list[tuple[int, int, float, float]] = []
    for i in range(len(columns)):
        ends, n = row[f"_s{i}"], row[f"_n{i}"]
        for j in range(k if ends else 0):
            if ends[j] == ends[k + j] and n >= ACCURACY:
                known[i, j] = float(ends[j])
            else:
                left.append((i, j, float(ends[j]), float(ends[k + j])))
    if left:
        value = [F.when(~F.isnan(F.col(columns[i]).cast("double")), F.col(columns[i]).cast("double")) for i in range(len(columns))]
        rows = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(value)])
        v = [F.col(f"_v{i}") for i, _, _, _ in left]
        sums = [(F.sum(F.when(c < lo, 1).otherwise(0)).alias(f"b{m}"), F.max(F.when(c < lo, c)).alias(f"p{m}"), F.min(F.when(c > hi, c)).alias(f"n{m}")) for m, (c, (_, _, lo, hi)) in enumerate(zip(v, left, strict=True))]
        near = rows.agg(*[x for three in sums for x in three]).first()
        inside = [(c >= lo) & (c <= hi) for c, (_, _, lo, hi) in zip(v, left, strict=True)]
        some = rows.filter(reduce(lambda a, b: a | b, inside))
        each = some.select(F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(m).alias("m"), c.alias("x"))) for m, (c, t) in enumerate(zip(v, inside, strict=True))]))).alias("e")).select("e.*")
        order = Window.partitionBy("m").orderBy("x")  # what lies within one bracket
        counts = each.groupBy("m", "x").agg(F.count("*").alias("cnt")).withColumn("after", F.sum("cnt").over(order))
        wanted = []
        for m, (i, j, _, _) in enumerate(left):
            place = at[j] * (row[f"_n{i}"] - 1)
            wanted += [(m, r - near[f"b{m}"]) for r in {math.floor(place), math.ceil(place)}]
        ranks = spark.createDataFrame(wanted, "m int, r long")
        found = {(r["m"], r["r"]): r["x"] for r in counts.join(F.broadcast(ranks), "m").filter((F.col("r") >= F.col("after") - F.col("cnt")) & (F.col("r") < F.col("after"))).select("m", "r", "x").collect()}
        for m, (i, j, _, _) in enumerate(left):
            place = at[j] * (row[f"_n{i}"] - 1)
            ends = []
            for r in (math.floor(place), math.ceil(place)):
                own = r - near[f"b{m}"]
                x = found.get((m, own), near[f"p{m}"] if own == -1 else near[f"n{m}"])
                if x is None:
                    raise ValueError("a percentile lies outside its bracket")
                ends.append(x)
            share = place - math.floor(place)
            known[i, j] = ends[0] if share == 0 else (1 - share) * ends[0] + share * ends[1]
    schema = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns])
    return spark.createDataFrame([tuple([known[i, j] for j in range(k)] if row[f"_s{i}"] else None for i in range(len(columns)))], schema)


def _counted(rows: DataFrame, ends: list[Column], columns: list[str], at: list[float], keys: list[Column]) -> DataFrame:
    """Percentiles from the values within the brackets; `rows` has _v0, _v1 and so on."""
    k = len(at)

    def placed(i: int) -> Column:
        v, e = F.col(f"_v{i}"), ends[i]
        inside = reduce(lambda a, b: a | b, [(v >= e[j]) & (v <= e[k + j]) for j in range(k)])
        gap = reduce(lambda a, b: a + b, [(e[k + j] < v).cast("int") for j in range(k)])
        return F.struct(F.lit(i).alias("_c"), gap.alias("_g"), F.when(inside, v).alias("_x"), v.alias("_v"))

    each = rows.select(*keys, F.explode(F.array(*[placed(i) for i in range(len(columns))])).alias("_e")).select(*keys, "_e.*").filter("_v is not null")
    # values between two brackets fall together: only how many there are, and which come first and last, matters
    counts = each.groupBy(*keys, "_c", "_g", "_x").agg(F.count("*").alias("_cnt"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    group = Window.partitionBy(*keys, "_c")
    counts = counts.withColumn("_after", F.sum("_cnt").over(group.orderBy("_g", F.col("_x").asc_nulls_first()))).withColumn("_n", F.sum("_cnt").over(group))
    before = F.col("_after") - F.col("_cnt")

    def ranked(rank: Column) -> Column:
        here = F.when(F.col("_x").isNotNull() | (rank == before), F.col("_first")).when(rank == F.col("_after") - 1, F.col("_last"))
        return F.max(F.when((rank >= before) & (rank < F.col("_after")), here))

    out = []
    for j, p in enumerate(at):
        place = F.lit(p) * (F.col("_n") - 1)
        r = F.floor(place)
        out += [ranked(r).alias(f"_lo{j}"), ranked(F.ceil(place)).alias(f"_hi{j}"), F.max(place - r).alias(f"_f{j}")]
    found = counts.groupBy(*keys, "_c").agg(*out)
    lost = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    mixed = [F.coalesce(F.when(F.col(f"_f{j}") == 0, F.col(f"_lo{j}")).otherwise((1 - F.col(f"_f{j}")) * F.col(f"_lo{j}") + F.col(f"_f{j}") * F.col(f"_hi{j}")), lost) for j in range(k)]
    found = found.select(*keys, "_c", F.array(*mixed).alias("_q"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(c) for i, c in enumerate(columns)])
