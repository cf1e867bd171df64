"""Queries over feature scores, encodings, sampling and column sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as f
from .catalog import query
from .inputs import FEATURES, SAMPLES_SQL, r6, samples, table

_CAT = "o AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"
_TAB = """t AS (SELECT 'priority' AS feature, priority AS code, status AS y, count(*) AS o FROM o GROUP BY 2, 3 UNION ALL SELECT 'segment', segment, status, count(*) FROM o GROUP BY 2, 3 UNION ALL SELECT 'nation', nation, status, count(*) FROM o GROUP BY 2, 3),
m AS (SELECT *, sum(o) OVER (PARTITION BY feature, code) AS r, sum(o) OVER (PARTITION BY feature, y) AS c, sum(o) OVER (PARTITION BY feature) AS n FROM t)"""
CAT = ["priority", "segment", "nation"]


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


def table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.contingency(categories(spark, sf_dir), CAT, "status")


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT count(*) AS n FROM s GROUP BY y) SELECT round(2 * (max(n) / sum(n)) / (1 + max(n) / sum(n)) / count(*), 6) AS macro_f1 FROM c")
def x01_majority_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.majority_macro_f1(samples(spark, sf_dir), "y").select(*r6("macro_f1"))


@query(f"WITH {_CAT}, {_TAB} SELECT feature, round(sum(o / n * ln(o * n / (r * c))), 6) AS mi FROM m GROUP BY feature")
def x02_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.mutual_information(table_of(spark, sf_dir)).select("feature", *r6("mi"))


_STUMP = " UNION ALL ".join(f"SELECT 'x{i}' AS feature, CASE WHEN x{i} > (SELECT quantile_cont(x{i}, 0.5) FROM s) THEN '1' ELSE '0' END AS code, y, count(*) AS o FROM s GROUP BY 2, 3" for i in range(4))
_ENT = """e AS (SELECT feature, sum(r / n * CASE WHEN o > 0 THEN -o / r * log2(o / r) ELSE 0 END) AS ins FROM m GROUP BY feature),
w AS (SELECT feature, sum(-c / n * log2(c / n)) AS whole FROM (SELECT DISTINCT feature, y, c, n FROM m) GROUP BY feature)"""
_MARG = "m AS (SELECT *, sum(o) OVER (PARTITION BY feature, code) AS r, sum(o) OVER (PARTITION BY feature, y) AS c, sum(o) OVER (PARTITION BY feature) AS n FROM t)"


@query(f"WITH {SAMPLES_SQL}, t AS ({_STUMP}), {_MARG}, {_ENT} SELECT feature, round(greatest(0, whole - ins), 6) AS drop_bits FROM e JOIN w USING (feature)")
def x03_stump_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.stump_drop(samples(spark, sf_dir), FEATURES, "y").select("feature", F.round("drop", 6).alias("drop_bits"))


@query(f"""WITH {_CAT}, {_TAB}, g AS (SELECT DISTINCT a.feature, a.code, a.r, b.y, b.c, b.n FROM m a JOIN m b ON a.feature = b.feature),
f AS (SELECT g.*, coalesce(t.o, 0) AS o FROM g LEFT JOIN t ON t.feature = g.feature AND t.code = g.code AND t.y = g.y),
d AS (SELECT feature, code, sum(CASE WHEN c > 0 THEN -c / n * log2(c / n) ELSE 0 END) - sum(r / n * CASE WHEN o > 0 THEN -o / r * log2(o / r) ELSE 0 END + (n - r) / n * CASE WHEN c - o > 0 THEN -(c - o) / (n - r) * log2((c - o) / (n - r)) ELSE 0 END) AS v FROM f GROUP BY feature, code)
SELECT feature, round(greatest(0, max(v)), 6) AS drop_bits FROM d GROUP BY feature""")
def x03_stump_drop_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.stump_drop_levels(table_of(spark, sf_dir)).select("feature", F.round("drop", 6).alias("drop_bits"))


@query(f"""WITH {_CAT}, {_TAB}, g AS (SELECT DISTINCT a.feature, a.code, a.r, b.y, b.c, b.n FROM m a JOIN m b ON a.feature = b.feature)
SELECT g.feature, round(sum(pow(coalesce(t.o, 0) - g.r * g.c / g.n, 2) / (g.r * g.c / g.n + 1e-12)), 6) AS chi2 FROM g LEFT JOIN t ON t.feature = g.feature AND t.code = g.code AND t.y = g.y GROUP BY g.feature""")
def x04_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.chi_square(table_of(spark, sf_dir)).select("feature", *r6("chi2"))


@query("WITH e AS (SELECT value FROM events), q AS (" + " UNION ALL ".join(f"SELECT round(quantile_cont(value, {i / 8}), 6) AS t FROM e" for i in range(1, 8)) + ") SELECT bin, count(*) AS n FROM (SELECT (SELECT count(DISTINCT t) FROM q WHERE t < value) AS bin FROM e) GROUP BY bin")
def x05_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.quantile_bins(table(spark, sf_dir, "events"), "value", 8).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CAT}, {_TAB}, mi AS (SELECT feature, sum(o / n * ln(o * n / (r * c))) AS mi FROM m GROUP BY feature), g AS (SELECT DISTINCT a.feature, a.code, a.r, b.y, b.c, b.n FROM m a JOIN m b ON a.feature = b.feature),
ch AS (SELECT g.feature, sum(pow(coalesce(t.o, 0) - g.r * g.c / g.n, 2) / (g.r * g.c / g.n + 1e-12)) AS chi2 FROM g LEFT JOIN t ON t.feature = g.feature AND t.code = g.code AND t.y = g.y GROUP BY g.feature)
SELECT feature, round(0.5 * mi / max(mi) OVER () + 0.4 * chi2 / max(chi2) OVER (), 6) AS combined FROM mi JOIN ch USING (feature)""")
def x06_combined_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(spark, sf_dir).cache()
    scores = f.mutual_information(t).join(f.chi_square(t), "feature").withColumn("drop", F.lit(0.0)).withColumn("is_numeric", F.lit(False))
    return f.combined_rank(scores).select("feature", *r6("combined"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 7 = 0 THEN (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 7 <> 0) ELSE c_acctbal END, 6) AS acctbal FROM customer")
def x07_mean_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("acctbal"))
    return f.mean_filled(c, "acctbal").select("c_custkey", *r6("acctbal"))


@query("SELECT c_mktsegment AS level, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS code FROM customer GROUP BY c_mktsegment")
def x07_codes_by_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.codes_by_appearance(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT coalesce(CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END, 'missing') AS level FROM customer)")
def k18_codes_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("s"))
    return f.codes_sorted(c, "s")


@query(f"""WITH {SAMPLES_SQL}, p AS (SELECT y, count(*) AS n, avg(x0) AS a, avg(x1 / 1000) AS b, var_pop(x0) AS va, var_pop(x1 / 1000) AS vb FROM s GROUP BY y), g AS (SELECT avg(x0) AS ga, avg(x1 / 1000) AS gb FROM s)
SELECT round(sum(n * (pow(a - ga, 2) + pow(b - gb, 2))) / (sum(n * (va + vb)) + 1e-9), 6) AS ratio FROM p, g""")
def x09_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("x1", F.col("x1") / 1000)
    return f.variance_ratio(rows, ["x0", "x1"], "y").select(*r6("ratio"))


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, 0.5) AS md, quantile_cont(p_retailprice, 0.2) AS a, quantile_cont(p_retailprice, 0.4) AS b, quantile_cont(p_retailprice, 0.6) AS c, quantile_cont(p_retailprice, 0.8) AS d, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part)
SELECT p_partkey, round((p_retailprice - m) / sd, 6) AS p_retailprice_std, p_retailprice > md AS p_retailprice_high, 'q' || ((p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT + (p_retailprice > d)::INT) AS p_retailprice_q FROM part, q""")
def s07_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.mixed_types(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return rows.select("p_partkey", *r6("p_retailprice_std"), "p_retailprice_high", "p_retailprice_q")


_SIZED = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "embeddings")


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _SIZED) + "), h AS (SELECT name, n, f FROM g, (VALUES (3), (8), (48), (64)) b(f)), s AS (SELECT *, greatest(500, least(n, CAST(ceil(pow(n, 0.6) * pow(greatest(1, f) / 8.0, 0.3)) AS BIGINT))) AS s FROM h) SELECT name, f, least(n, CASE WHEN 0.001 * n * f <= 3 * s AND 3 * s <= 0.05 * n * f THEN 3 * s ELSE s END) AS size FROM s")
def s14_adaptive_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [(t, table(spark, sf_dir, t).count()) for t in _SIZED]
    return spark.createDataFrame([(t, k, f.adaptive_sample_size(n, k)) for t, n in counts for k in (3, 8, 48, 64)], "name string, f int, size long")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS o FROM orders")
def k02_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.one_hot(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])
    return rows.select("o_orderkey", F.element_at("onehot", 1).alias("f"), F.element_at("onehot", 2).alias("o"))


@query()
def x10_l1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("row_id", F.xxhash64(*FEATURES))
    return spark.createDataFrame(f.l1_importance(rows, FEATURES, "y"), "feature string, importance double")


@query("SELECT a + 5 * b AS cell, round(-1 + a * 0.5, 6) AS x, round(b * 0.25, 6) AS y FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b)")
def p10_surface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reporting

    rows = reporting.surface_grid(spark, [-1.0, 0.0], [1.0, 1.0], 5)
    return rows.select("cell", F.round(F.element_at("x", 1), 6).alias("x"), F.round(F.element_at("x", 2), 6).alias("y"))


@query("WITH c AS (SELECT count(*) AS n FROM orders), z AS (SELECT n, greatest(500, least(n, CAST(ceil(pow(n, 0.6) * pow(1.0, 0.3)) AS BIGINT))) AS s FROM c), k AS (SELECT CASE WHEN n <= 100 THEN n WHEN 0.001 * n * 8 <= 3 * s AND 3 * s <= 0.05 * n * 8 THEN least(n, 3 * s) ELSE least(n, s) END AS size FROM z) SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) <= (SELECT size FROM k)")
def s15_adaptive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.adaptive_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8)


@query(f"WITH {SAMPLES_SQL}, a AS (SELECT avg(x0) AS m0, avg(x3) AS m3, stddev_pop(x0) AS s0, stddev_pop(x3) AS s3 FROM s WHERE x2 <= 0.05), b AS (SELECT avg(x0) AS m0, avg(x3) AS m3, stddev_pop(x0) AS s0, stddev_pop(x3) AS s3 FROM s) SELECT round((abs(a.m0 - b.m0) + abs(a.m3 - b.m3)) / 2, 6) AS mean_error, round((abs(a.s0 - b.s0) + abs(a.s3 - b.s3)) / 2, 6) AS std_error FROM a, b")
def s17_representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return f.representativeness(s.filter("x2 <= 0.05"), s, ["x0", "x3"]).select(*r6("mean_error", "std_error"))


_CORR = " UNION ALL ".join(f"SELECT 'x{a}' AS a, 'x{b}' AS b, corr(x{a}, x{b}) AS corr FROM s" for a in range(4) for b in range(a + 1, 4))


@query(f"WITH {SAMPLES_SQL}, c AS ({_CORR}) SELECT a, b, round(corr, 6) AS corr FROM c")
def g03_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.correlations(samples(spark, sf_dir), FEATURES).select("a", "b", *r6("corr"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 4 + 1 AS size, p_retailprice AS score FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY score DESC, id) AS turn, max(score) OVER (PARTITION BY size) AS best FROM r)
SELECT id, size, score, row_number() OVER (ORDER BY turn, best DESC, size) AS place FROM t QUALIFY place <= 12""")
def e05_diverse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("size"), F.col("p_retailprice").alias("score"))
    return f.diverse_pick(rows, 12)


@query()
def s01_corner_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import generators

    return generators.corner_classes(spark).groupBy("y").agg(F.count("*").alias("n"), *[F.round(F.avg(f"x{i}"), 3).alias(f"m{i}") for i in range(1, 5)])


@query()
def s02_high_dimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import generators

    return generators.high_dimensional(spark).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 3).alias("m1"))


@query()
def s08_passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import generators

    return generators.passengers(spark)


@query(f"WITH {SAMPLES_SQL}, m AS (SELECT avg(x0) AS a, stddev_pop(x0) AS b, avg(x1) AS c, stddev_pop(x1) AS d FROM s) SELECT 'x0' AS a, 'x0' AS b, round(sum(CASE WHEN y = 1 THEN 1 ELSE 0.5 END * pow((x0 - m.a) / m.b, 2)), 3) AS g FROM s, m UNION ALL SELECT 'x0', 'x1', round(sum(CASE WHEN y = 1 THEN 1 ELSE 0.5 END * (x0 - m.a) / m.b * (x1 - m.c) / m.d), 3) FROM s, m UNION ALL SELECT 'x1', 'x1', round(sum(CASE WHEN y = 1 THEN 1 ELSE 0.5 END * pow((x1 - m.c) / m.d, 2)), 3) FROM s, m")
def g10_weighted_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import candidates

    return candidates.weighted_gram(samples(spark, sf_dir), ["x0", "x1"], F.when(F.col("y") == 1, 1.0).otherwise(0.5)).select("a", "b", F.round("g", 3).alias("g"))


