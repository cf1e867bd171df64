"""Queries of column-set methods, their evaluation and the bundle, over six columns of lineitem."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, evaluation
from ..operators import features as f
from ..operators import generators as g
from .catalog import query
from .inputs import r6, samples

#: Quantity, price, discount and tax, price after discount and quantity after tax: two pairs of columns go together.
WIDE = ["d", "p", "pd", "q", "qt", "t"]
_PAIRS = list(itertools.combinations(WIDE, 2))
_TRIPLES = list(itertools.combinations(WIDE, 3))

_W = """w AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_extendedprice * (1 - l_discount) AS pd, l_quantity * (1 + l_tax) AS qt,
  CASE WHEN l_extendedprice > 60000 AND l_discount < 0.05 THEN 1 WHEN l_quantity <= 15 THEN 2 ELSE 0 END AS y FROM lineitem)"""


def _codes(parts: int, name: str = "ed") -> str:
    """A table (feature, l): each column's inner quantiles."""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, list_distinct(list_transform(quantile_cont({c}, [{', '.join(repr(i / parts) for i in range(1, parts))}]), lambda e: round(e, 6))) AS l FROM w" for c in WIDE) + ")"


_LONG = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, y FROM w" for c in WIDE) + ")"
#: (feature, mi, chi2, drop) of every column.
SCORES = f"""WITH {_W}, {_codes(8)}, {_LONG},
o AS (SELECT u.feature, len(list_filter(ed.l, lambda e: e < u.x)) AS code, y, count(*) AS o FROM u JOIN ed ON ed.feature = u.feature GROUP BY 1, 2, 3),
fullo AS (SELECT l.feature, l.code, c.y, coalesce(o.o, 0) AS o FROM (SELECT DISTINCT feature, code FROM o) l JOIN (SELECT DISTINCT feature, y FROM o) c ON c.feature = l.feature LEFT JOIN o ON o.feature = l.feature AND o.code = l.code AND o.y = c.y),
mg AS (SELECT *, sum(o) OVER (PARTITION BY feature, code) AS r, sum(o) OVER (PARTITION BY feature, y) AS c, sum(o) OVER (PARTITION BY feature) AS n FROM fullo),
ms AS (SELECT feature, sum(CASE WHEN o > 0 THEN o / n * ln(o * n / (r * c)) ELSE 0 END) AS mi, sum(pow(o - r * c / n, 2) / (r * c / n + 1e-12)) AS chi2 FROM mg GROUP BY feature),
md AS (SELECT feature, quantile_cont(x, 0.5) AS m FROM u GROUP BY feature),
hv AS (SELECT u.feature, u.x > m AS up, y, count(*) AS o FROM u JOIN md ON md.feature = u.feature GROUP BY 1, 2, 3),
hm AS (SELECT *, sum(o) OVER (PARTITION BY feature, up) AS r, sum(o) OVER (PARTITION BY feature, y) AS c, sum(o) OVER (PARTITION BY feature) AS n FROM hv),
dr AS (SELECT a.feature, greatest(0, whole - inside) AS drop FROM (SELECT feature, sum(r / n * -(o / r) * log2(o / r)) AS inside FROM hm GROUP BY feature) a
  JOIN (SELECT feature, sum(-(c / n) * log2(c / n)) AS whole FROM (SELECT DISTINCT feature, y, c, n FROM hm) GROUP BY feature) b ON a.feature = b.feature),
sc AS (SELECT ms.feature, mi, chi2, drop FROM ms JOIN dr ON ms.feature = dr.feature),
co AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM w" for a, b in _PAIRS)}),
sets AS (SELECT unnest([{', '.join(str(list(s)) for s in _PAIRS + _TRIPLES)}]) AS s),
st AS (SELECT s, array_to_string(s, ',') AS features, len(s) AS size, (SELECT sum(mi) FROM sc WHERE list_contains(s, feature)) AS mi, (SELECT min(mi) FROM sc WHERE list_contains(s, feature)) AS least,
  (SELECT sum(chi2) FROM sc WHERE list_contains(s, feature)) AS chi2, (SELECT sum(r) FROM co WHERE list_contains(s, a) AND list_contains(s, b)) AS r, (SELECT min(r) FROM co WHERE list_contains(s, a) AND list_contains(s, b)) AS rmin, (SELECT avg(r) FROM co WHERE list_contains(s, a) AND list_contains(s, b)) AS ravg FROM sets),
rk AS (SELECT *, row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS place, row_number() OVER (ORDER BY round(chi2, 9) DESC, feature) AS place2 FROM sc)
"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = samples(spark, sf_dir)
    return x.select(F.col("x0").alias("q"), F.col("x1").alias("p"), F.col("x2").alias("d"), F.col("x3").alias("t"), (F.col("x1") * (1 - F.col("x2"))).alias("pd"), (F.col("x0") * (1 + F.col("x3"))).alias("qt"), "y")


def analysis(spark: SparkSession, sf_dir: str) -> g.Analysis:
    return g.analyse(wide(spark, sf_dir), WIDE, "y")


def table_of(spark: SparkSession, sets) -> DataFrame:
    return spark.createDataFrame([(",".join(s),) for s in sorted(set(sets))], "features string")


def scores_of(a: g.Analysis) -> DataFrame:
    return a.df.sparkSession.createDataFrame([(c, float(v["mi"])) for c, v in a.scores.items()], "feature string, mi double")


@query(SCORES + "SELECT feature, round(mi, 6) AS mi, round(chi2, 2) AS chi2, round(drop, 6) AS drop FROM sc")
def x08_precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    rows = [(c, round(v["mi"], 6), round(v["chi2"], 2), round(v["drop"], 6)) for c, v in a.scores.items()]
    return spark.createDataFrame(rows, "feature string, mi double, chi2 double, drop double")


@query(SCORES + """, pool AS (SELECT feature, mi, place FROM rk WHERE place <= 4), near AS (SELECT a.feature AS a, b.feature AS b, a.mi AS ma, b.mi AS mb FROM pool a JOIN pool b ON b.place = a.place + 1),
near3 AS (SELECT list_sort([a.feature, b.feature, c.feature]) AS s, a.mi AS hi, c.mi AS lo FROM pool a JOIN pool b ON b.place = a.place + 1 JOIN pool c ON c.place = a.place + 2)
SELECT features FROM st WHERE list_has_all((SELECT list(feature) FROM pool), s)
UNION SELECT least(a, b) || ',' || greatest(a, b) FROM near WHERE ma > 0 AND (ma - mb) / ma <= 0.15 UNION SELECT array_to_string(s, ',') FROM near3 WHERE hi > 0 AND (hi - lo) / hi <= 0.15""")
def g01_topk_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.topk_random(analysis(spark, sf_dir), k=4))


@query(SCORES + "SELECT features, round(mi - 0.22 * r + 0.18 * least, 6) AS score FROM st QUALIFY row_number() OVER (PARTITION BY size ORDER BY round(mi - 0.22 * r + 0.18 * least, 9) DESC, features) <= 20")
def g01b_topk_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    rows = [(",".join(s), round(sum(a.mi(s)) - 0.22 * sum(a.pairs(s)) + 0.18 * min(a.mi(s)), 6)) for s in g.topk_guided(a)]
    return spark.createDataFrame(rows, "features string, score double")


@query(SCORES + "SELECT features FROM st WHERE list_has_all((SELECT list(feature) FROM rk WHERE place2 <= 4), s)")
def g02_chi2_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.chi2_sets(analysis(spark, sf_dir), k=4))


@query(SCORES + "SELECT features FROM st ORDER BY round(chi2 + 0.45 * mi, 3) DESC, s LIMIT 8")
def g02b_chi2_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.chi2_guided(analysis(spark, sf_dir), keep=8))


@query(SCORES + "SELECT features FROM st WHERE size = 2 AND r >= 0.55")
def g03_correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.correlated(analysis(spark, sf_dir)))


@query(SCORES + "SELECT features FROM st WHERE rmin >= 0.85 * 0.3 ORDER BY round(ravg * (1 + 0.35 * mi), 9) DESC, s LIMIT 60")
def g03b_correlated_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.correlated_guided(analysis(spark, sf_dir), threshold=0.3))


@query(SCORES + """, c2 AS (SELECT a, b, r FROM co UNION ALL SELECT b, a, r FROM co),
one AS (SELECT x.feature AS a, y.feature AS b, y.mi - 0.18 * c2.r AS v, y.place FROM rk x JOIN rk y ON x.feature <> y.feature JOIN c2 ON c2.a = x.feature AND c2.b = y.feature),
two AS (SELECT a, b FROM one QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(v, 9) DESC, place) = 1),
three AS (SELECT two.a, two.b, y.feature AS c FROM two JOIN rk y ON y.feature NOT IN (two.a, two.b) JOIN c2 p ON p.a = two.a AND p.b = y.feature JOIN c2 q ON q.a = two.b AND q.b = y.feature QUALIFY row_number() OVER (PARTITION BY two.a ORDER BY round(y.mi - 0.18 * (p.r + q.r), 9) DESC, y.place) = 1)
SELECT least(a, b) || ',' || greatest(a, b) AS features FROM two UNION SELECT array_to_string(list_sort([a, b, c]), ',') FROM three""")
def g07_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.greedy(analysis(spark, sf_dir), restarts=0))


def _sketch(parts: int, primes: tuple[int, ...]) -> str:
    code = {c: f"(list_reduce([0] || list_transform((SELECT quantile_cont({c}, [{', '.join(repr(i / parts) for i in range(1, parts))}]) FROM w), lambda e: CASE WHEN round(e, 6) < {c} THEN 1 ELSE 0 END), lambda a, b: a + b))" for c in WIDE}
    cc = ", ".join(f"CAST({e} AS INTEGER) AS {c}" for c, e in code.items())

    def h(s: tuple[str, ...]) -> str:
        out = f"({s[0]} + 1) * {primes[0]} % 257"
        for c, p in zip(s[1:], primes[1:], strict=False):
            out = f"xor({out}, ({c} + 1) * {p} % 257)"
        return out

    each = " UNION ALL ".join(f"SELECT '{','.join(s)}' AS features, y, {h(s)} AS h FROM cc" for s in _PAIRS + _TRIPLES)
    return f"WITH {_W}, cc AS (SELECT y, {cc} FROM w), hh AS ({each}), nn AS (SELECT features, y, h, count(*) AS n FROM hh GROUP BY 1, 2, 3), sh AS (SELECT features, y, max(n) / sum(n) AS share FROM nn GROUP BY 1, 2)"


@query(_sketch(4, (3, 5, 7)) + "SELECT features FROM sh GROUP BY features HAVING max(share) >= 0.4")
def g09_count_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, g.count_sketch(analysis(spark, sf_dir), least=0.4))


@query(_sketch(5, (3, 5, 7)) + ", r AS (SELECT features, share, row_number() OVER (PARTITION BY features ORDER BY share DESC) AS k FROM sh) SELECT a.features, round(a.share + 0.6 * (a.share - b.share), 6) AS score FROM r a JOIN r b ON a.features = b.features AND a.k = 1 AND b.k = 2")
def g09b_count_sketch_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    kept = g.count_sketch_refined(a)
    shares = g.sketch_shares(a, kept, 5, (3, 5, 7, 11, 13))
    return spark.createDataFrame([(",".join(s), round(v[0] + 0.6 * (v[0] - v[1]), 6)) for s, v in shares.items()], "features string, score double")


_VEC = [[1.0, 0, 0, -1, 0, 1], [0, 1, -1, 0, 0, 0], [0, 0, 0, 1, 1, -1]]


@query(f"""WITH {_W}, z AS ({' UNION ALL '.join(f"SELECT {i} AS projection, y, {' + '.join(f'{w} * {c}' for w, c in zip(v, WIDE) if w)} AS z FROM w" for i, v in enumerate(_VEC))}), k AS (SELECT projection, y, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1, 2)
SELECT projection, round(var_pop(m) / (avg(v) + 1e-9), 6) AS fisher FROM k GROUP BY projection""")
def g06_fisher_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(g.fisher(a, _VEC))], "projection int, fisher double")


_THREE = ("1b topk_guided", "3 correlated", "3b correlated_guided")
#: The sets of three methods with what proposed them.
_ASM = """, m AS (SELECT features, s, size, mi, '1b topk_guided' AS method FROM st UNION ALL SELECT features, s, size, mi, '3 correlated' FROM st WHERE size = 2 AND r >= 0.55
  UNION ALL SELECT features, s, size, mi, '3b correlated_guided' FROM st WHERE rmin >= 0.85 * 0.55),
pr AS (SELECT features, any_value(s) AS s, any_value(size) AS size, any_value(mi) AS mi, string_agg(method, ',' ORDER BY method) AS methods, count(*) AS n_methods FROM m GROUP BY features),
hot AS (SELECT features, row_number() OVER (ORDER BY round(mi / sqrt(size), 9) DESC, features) AS place FROM pr)
"""


def three(spark: SparkSession, sf_dir: str) -> tuple[g.Analysis, DataFrame]:
    a = analysis(spark, sf_dir)
    return a, g.proposed(a, _THREE)[0]


def reports_of(a: g.Analysis, sets: DataFrame) -> DataFrame:
    return f.proxy_scores(sets.select("features"), scores_of(a)).withColumn("score", F.col("proxy"))


@query(SCORES + _ASM + "SELECT features, methods, CAST(n_methods AS INTEGER) AS n_methods FROM pr")
def e01_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three(spark, sf_dir)[1].select(F.concat_ws(",", "features").alias("features"), F.concat_ws(",", "methods").alias("methods"), "n_methods")


@query(SCORES + "SELECT features, round(mi / sqrt(size), 6) AS proxy, round(mi / size, 6) AS mean_mi FROM st")
def e02_proxy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return f.proxy_scores(f.column_sets(scores_of(a)), scores_of(a)).select(F.concat_ws(",", "features").alias("features"), *r6("proxy", "mean_mi"))


@query(SCORES + ", rr AS (SELECT features, size, round(mi / size, 6) AS score, row_number() OVER (PARTITION BY size ORDER BY mi / size DESC, features) AS turn, max(mi / size) OVER (PARTITION BY size) AS best FROM st) SELECT features, CAST(size AS INTEGER) AS size, score, CAST(row_number() OVER (ORDER BY turn, best DESC, size) AS INTEGER) AS place FROM rr QUALIFY place <= 8")
def e03_ultra_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    return evaluation.explore(a.df, WIDE, analysis=a, methods=("1b topk_guided",), preset="ultra_fast", keep=8).select("features", "size", *r6("score"), F.col("place").cast("int").alias("place"))


@query(SCORES + _ASM + "SELECT method, count(*) AS candidates, count(place) AS top_hits FROM m LEFT JOIN (SELECT * FROM hot WHERE place <= 5) h ON h.features = m.features GROUP BY method")
def e06_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, sets = three(spark, sf_dir)
    return candidates.annotated(sets, reports_of(a, sets), 5)


@query(SCORES + _ASM + "SELECT method, count(*) AS candidates, count(*) AS selected, round(max(mi / size), 6) AS best_score FROM m GROUP BY method")
def e09_bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    sets, took = g.proposed(a, _THREE)
    reports = evaluation.explore(a.df, WIDE, analysis=a, methods=_THREE, preset="ultra_fast", keep=None)
    return evaluation.bundle_summary(sets, reports, took).select("method", "candidates", "selected", *r6("best_score"))


@query(SCORES + ", b AS (SELECT max(n) / sum(n) AS p, count(*) AS c FROM (SELECT count(*) AS n FROM w GROUP BY y)) SELECT features, round(mi / size * (1 + 2 * p / (1 + p) / c) * ln(1 + c), 6) AS calibrated FROM st, b")
def e10_calibrated_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    baseline = f.majority_macro_f1(a.df, "y").first()["macro_f1"]
    return evaluation.calibrated_proxy(f.column_sets(scores_of(a)), scores_of(a), baseline, 3).select(F.concat_ws(",", "features").alias("features"), *r6("calibrated"))


@query(SCORES + _ASM + "SELECT features, CAST(n_methods AS INTEGER) AS n_methods, round(mi / sqrt(size), 6) AS score, CAST(row_number() OVER (ORDER BY n_methods DESC, round(mi / sqrt(size), 9) DESC, features) AS INTEGER) AS place FROM pr")
def e11_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, sets = three(spark, sf_dir)
    reports = reports_of(a, sets).select(F.concat_ws(",", "features").alias("features"), "score")
    return evaluation.set_summary(sets, reports).select("features", "n_methods", *r6("score"), "place")


@query(SCORES + _ASM + "SELECT features, " + ", ".join(f"CASE WHEN contains(',' || methods || ',', ',{m},') THEN 'yes' ELSE 'no' END AS \"{m}\"" for m in _THREE) + " FROM pr")
def k16_method_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.method_matrix(three(spark, sf_dir)[1], list(_THREE))


@query(SCORES + "SELECT features, 'a' AS only_in FROM st WHERE size > 3")
def k19_bundle_equals_single_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    together = g.proposed(a, _THREE)[0]
    out = None
    for m in _THREE:
        alone = g.proposed(a, (m,))[0]
        one = evaluation.differing(together.filter(F.array_contains("methods", m)), alone)
        out = one if out is None else out.unionByName(one)
    return out


@query(SCORES + "SELECT preset, CAST(size AS INTEGER) AS size, count(*) AS reports, CASE WHEN preset = 'ultra_fast' THEN round(max(mi / size), 6) END AS best_score FROM st, (SELECT 'ultra_fast' AS preset UNION ALL SELECT 'high_quality') GROUP BY preset, size")
def k20_preset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    keyed = a.df.withColumn("row_id", F.xxhash64(*WIDE))
    whole = evaluation.g.Analysis(keyed, a.columns, a.label, a.scores, a.corr, a.moments)
    part = evaluation.g.Analysis(f.adaptive_sample(keyed, "row_id", len(WIDE)).cache(), a.columns, a.label, a.scores, a.corr, a.moments)
    out = evaluation.preset_matrix([("ultra_fast", whole), ("high_quality", part)])
    return out.select("preset", "size", "reports", F.when(F.col("preset") == "ultra_fast", F.round("best_score", 6)).alias("best_score"))


def _method_query(name: str, method: str) -> None:
    """A method whose draws or models SQL has no form of: its sets; tests hold plain versions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = wide(spark, sf_dir).withColumn("row_id", F.xxhash64(*WIDE))
        part = f.adaptive_sample(rows, "row_id", len(WIDE)).cache() if "rand" in method or "forest" in method or "gradient" in method else rows
        return table_of(spark, g.METHODS[method](g.analyse(part, WIDE, "y")))

    run.__name__ = name
    query()(run)


for _m in ("4 forest_paths", "4b forest_weighted", "5 leverage", "5b leverage_class", "6 sparse_projection", "6b sparse_projection_guided", "7b greedy_refined", "8 random_trees", "8b random_trees_refined", "10 gradient_synergy", "10b gradient_hessian", "11 minhash", "11b minhash_refined"):
    _number, _name = _m.split()
    _method_query(f"g{int(''.join(c for c in _number if c.isdigit())):02d}{''.join(c for c in _number if c.isalpha())}_{_name}", _m)


@query()
def e04_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = f.adaptive_sample(wide(spark, sf_dir).withColumn("row_id", F.xxhash64(*WIDE)), "row_id", len(WIDE))
    return evaluation.cross_validated(part, [["p", "q"], ["d", "p"], ["d", "p", "q"]])


@query()
def e07_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.explore(wide(spark, sf_dir).withColumn("row_id", F.xxhash64(*WIDE)), WIDE, keep=5)


@query()
def e08_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bundle(wide(spark, sf_dir).withColumn("row_id", F.xxhash64(*WIDE)), WIDE, keep=10)[0]
