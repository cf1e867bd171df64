"""Feature scores, encodings, sampling, and column-set candidates with their rankings."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles

# --------------------------------------------------------------------------- scores


def majority_macro_f1(df: DataFrame, label: str) -> DataFrame:
    """Macro F1 of always answering the most frequent class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    p = F.max("n") / F.sum("n")
    return counts.agg((2 * p / (1 + p) / F.count("*")).alias("macro_f1"))


def contingency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, code, y, o): counts of each level of each feature by class, one shuffle for all features."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("code")) for f in features]))
    return df.select(each.alias("e"), F.col(label).alias("y")).groupBy("e.feature", "e.code", "y").agg(F.count("*").alias("o"))


def _margins(table: DataFrame) -> DataFrame:
    over = lambda *c: F.sum("o").over(Window.partitionBy(*c))  # noqa: E731  levels times classes, not rows
    return table.select("*", over("feature", "code").alias("r"), over("feature", "y").alias("c"), over("feature").alias("n"))


def mutual_information(table: DataFrame) -> DataFrame:
    """(feature, mi) in nats from a contingency table."""
    m = _margins(table)
    return m.groupBy("feature").agg(F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).alias("mi"))


def chi_square(table: DataFrame) -> DataFrame:
    """(feature, chi2) over all level and class cells, the empty ones included."""
    levels, classes = table.select("feature", "code").distinct(), table.select("feature", "y").distinct()
    full = levels.join(classes, "feature").join(table, ["feature", "code", "y"], "left").na.fill(0, ["o"])
    m = _margins(full).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    return m.groupBy("feature").agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / (F.col("e") + 1e-12)).alias("chi2"))


def _entropy2(o: Column, n: Column) -> Column:
    return F.when(o > 0, -o / n * F.log2(o / n)).otherwise(F.lit(0.0))


def stump_drop(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, drop): entropy lost, in bits, by splitting a numeric feature at its median."""
    med = percentiles(df, features, [0.5]).first()
    halves = df.select(F.col(label).alias("y"), *[(F.col(f) > med[f][0]).cast("int").alias(f) for f in features])
    return _drop(contingency(halves, features, "y"))


def _drop(table: DataFrame) -> DataFrame:
    m = _margins(table)
    inner = m.groupBy("feature").agg(F.sum(F.col("r") / F.col("n") * _entropy2(F.col("o"), F.col("r"))).alias("inside"))
    outer = m.select("feature", "y", "c", "n").distinct().groupBy("feature").agg(F.sum(_entropy2(F.col("c"), F.col("n"))).alias("whole"))
    return outer.join(inner, "feature").select("feature", F.greatest(F.lit(0.0), F.col("whole") - F.col("inside")).alias("drop"))


def stump_drop_levels(table: DataFrame) -> DataFrame:
    """(feature, drop): the best split of one level of a categorical feature from its others."""
    m = _margins(table)
    classes = m.select("feature", "y", "c", "n").distinct()
    per = m.select("feature", "code", "r").distinct().join(classes, "feature").join(table, ["feature", "code", "y"], "left").na.fill(0, ["o"])
    rest, rest_n = F.col("c") - F.col("o"), F.col("n") - F.col("r")
    inside = F.sum(F.col("r") / F.col("n") * _entropy2(F.col("o"), F.col("r")) + F.when(rest_n > 0, rest_n / F.col("n") * _entropy2(rest, rest_n)).otherwise(F.lit(0.0)))
    whole = F.sum(_entropy2(F.col("c"), F.col("n")))
    return per.groupBy("feature", "code").agg(F.greatest(F.lit(0.0), whole - inside).alias("drop")).groupBy("feature").agg(F.max("drop").alias("drop"))


def quantile_bins(df: DataFrame, feature: str, bins: int) -> DataFrame:
    """Adds bin: how many of the inner quantiles lie below the value (right-closed bins)."""
    edges = percentiles(df, [feature], [i / bins for i in range(1, bins)]).first()[feature]
    edges = sorted({round(e, 6) for e in edges})
    return df.withColumn("bin", reduce(lambda a, b: a + b, [(F.lit(e) < F.col(feature)).cast("int") for e in edges], F.lit(0)))


def combined_rank(scores: DataFrame, top: int = 20) -> DataFrame:
    """Adds combined and rank: weights .5/.2/.3 of MI, chi-square and stump for numeric features, .5/.4/.1 for others, each over its maximum."""
    all_rows = Window.partitionBy()
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(all_rows), F.lit(0.0)), F.lit(0.0))
    w = lambda a, b: F.when(F.col("is_numeric"), a).otherwise(b)
    out = scores.withColumn("combined", 0.5 * share("mi") + w(0.2, 0.4) * share("chi2") + w(0.3, 0.1) * share("drop"))
    order = Window.orderBy(F.round("combined", 9).desc(), "feature")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def variance_ratio(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Between-class over within-class sum of squares of the features."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features])
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    whole = per.select("*", *[(F.sum(F.col("n") * F.col(f"m_{f}")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())).alias(f"g_{f}") for f in features])
    between = F.sum(F.col("n") * add([F.pow(F.col(f"m_{f}") - F.col(f"g_{f}"), 2) for f in features]))
    within = F.sum(F.col("n") * add([F.col(f"v_{f}") for f in features]))
    return whole.agg((between / (within + 1e-9)).alias("ratio"))


# --------------------------------------------------------------------------- encodings


def mean_filled(df: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    """Null and NaN become the column's mean, or `default` if nothing else is there."""
    clean = F.when(~F.isnan(column), F.col(column))
    mean = df.agg(F.avg(clean).alias("m")).first()["m"]
    return df.withColumn(column, F.coalesce(clean, F.lit(default if mean is None else mean)))


def codes_by_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """(level, code) in order of first appearance; null has code -1."""
    levels = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min(order).alias("first"))
    out = levels.select("level", (F.row_number().over(Window.orderBy("first", "level")) - 1).alias("code"))
    return out.unionByName(df.filter(F.col(column).isNull()).select(F.col(column).alias("level"), F.lit(-1).alias("code")).limit(1))


def codes_sorted(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    """(level, code) in sorted order, null as a level of its own."""
    levels = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("level")).distinct()
    return levels.select("level", (F.row_number().over(Window.orderBy("level")) - 1).alias("code"))


def mixed_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised numeric columns, a boolean above the median and a quintile label of each."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    cut = percentiles(df, columns, [0.5, 0.2, 0.4, 0.6, 0.8]).first()
    out = []
    for c in columns:
        med, *cuts = cut[c]
        sd = stats[f"s_{c}"] if stats[f"s_{c}"] and stats[f"s_{c}"] > 1e-12 else 1.0
        out += [((F.col(c) - stats[f"m_{c}"]) / sd).alias(f"{c}_std"), (F.col(c) > med).alias(f"{c}_high"), F.concat(F.lit("q"), reduce(lambda a, b: a + b, [(F.col(c) > x).cast("int") for x in cuts]).cast("string")).alias(f"{c}_q")]
    return df.select("*", *out)


# --------------------------------------------------------------------------- sampling


def adaptive_sample_size(n: int, features: int, total: int | None = None) -> int:
    """Rows worth sampling of n: at least 500; three times as many if that is between 0.1 and 5 percent of all cells; n at most."""
    total = n * features if total is None else total
    s = max(500, min(n, math.ceil(n**0.6 * (max(1, features) / 8) ** 0.3)))
    return min(n, 3 * s if 0.001 * total <= 3 * s <= 0.05 * total else s)


def adaptive_sample(df: DataFrame, key: str, features: int, seed: int = 0) -> DataFrame:
    """An exact-size sample without replacement by a hash of the key; all rows where sampling is not worth it."""
    n = df.count()
    size = adaptive_sample_size(n, features)
    if n <= 100 or n * features <= 500 or size >= n:
        return df
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # digests are even over their range: a little more than the share wanted is below a bound, and only that is sorted
    for slack in (1.2, 3.0):
        part = df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int((slack * size + 100) / n * (1 << 32)))
        if part.limit(size).count() == size:
            return part.orderBy(digest, key).limit(size)
    return df.orderBy(digest, key).limit(size)


def representativeness(part: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute differences of the columns' means and standard deviations."""
    agg = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    a, b = part.agg(*agg).toDF(*[f"a_{c}" for c in part.agg(*agg).columns]), whole.agg(*agg)
    mean = lambda k: sum(F.abs(F.col(f"a_{k}_{c}") - F.col(f"{k}_{c}")) for c in columns) / len(columns)
    return a.crossJoin(b).select(mean("m").alias("mean_error"), mean("s").alias("std_error"))  # one row each


# --------------------------------------------------------------------------- column sets


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every two columns, one scan."""
    pairs = list(itertools.combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("e")).select("e.*")


def column_sets(ranked: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(features): all sets of the given sizes of ranked features, names in order."""
    f = ranked.select(F.col("feature").alias("f"))
    level, out = f.select(F.array("f").alias("features")), None
    for k in range(2, max(sizes) + 1):
        level = level.join(f, F.col("f") > F.element_at("features", -1)).select(F.concat("features", F.array("f")).alias("features"))
        if k in sizes:
            out = level if out is None else out.unionByName(level)
    return out


def proxy_scores(sets: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds proxy: the features' mutual information over the root of their number."""
    each = sets.select("features", F.explode("features").alias("feature")).join(F.broadcast(scores.select("feature", "mi")), "feature")
    return each.groupBy("features").agg((F.sum("mi") / F.sqrt(F.count("*"))).alias("proxy"), F.avg("mi").alias("mean_mi"))


def diverse_pick(reports: DataFrame, limit: int) -> DataFrame:
    """Reports in turn by set size, the size of the best report first, until `limit`; columns size and score."""
    w = Window.partitionBy("size").orderBy(F.col("score").desc(), "id")
    rows = reports.select("*", F.row_number().over(w).alias("turn"), F.max("score").over(Window.partitionBy("size")).alias("best"))
    order = Window.orderBy("turn", F.col("best").desc(), "size")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("turn", "best")


def one_hot(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Adds onehot: 1.0 at the label's place among `classes`, all 0.0 for a label that is none of them or null."""
    return df.withColumn("onehot", F.array(*[F.when(F.col(label) == c, 1.0).otherwise(0.0) for c in classes]))


def l1_importance(df: DataFrame, features: list[str], label: str, c: float = 0.8, most: int = 2500, key: str = "row_id") -> list[tuple[str, float]]:
    """Mean absolute weights of an L1-regularised logistic regression on standardised columns of at most `most` rows, drawn
    by a digest of the key; best first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = df.count()
    part = df if n <= most else df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < int(most / n * (1 << 32)))
    stats = part.agg(*[F.avg(x).alias(f"m {x}") for x in features], *[F.stddev_pop(x).alias(f"s {x}") for x in features], F.count("*").alias("n")).first()
    z = [((F.col(x) - (stats[f"m {x}"] or 0.0)) / (stats[f"s {x}"] if stats[f"s {x}"] and stats[f"s {x}"] > 1e-12 else 1.0)).alias(x) for x in features]
    data = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(part.select(F.col(label).cast("double").alias("_y"), *z))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", elasticNetParam=1.0, regParam=1 / (c * max(1, stats["n"])), standardization=False, maxIter=200).fit(data)
    weights = model.coefficientMatrix.toArray()
    return sorted(zip(features, abs(weights).mean(axis=0).tolist(), strict=True), key=lambda r: (-round(r[1], 9), r[0]))
