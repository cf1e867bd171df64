"""Queries over boundary sampling, with a closed-form linear model on the first dimensions of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boundary as b
from ..storage import stored
from .catalog import query
from .inputs import r6, table

W = [[4.0, -2.0, 1.0], [-3.0, 3.0, 0.5], [0.5, 1.0, -4.0]]
B = [0.1, 0.0, -0.1]
MODEL = b.linear_softmax(W, B)
PREDICT = b.numpy_softmax(W, B)

_Z = ", ".join(f"exp({w[0]} * v[1] + {w[1]} * v[2] + {w[2]} * v[3] + {c}) AS z{i}" for i, (w, c) in enumerate(zip(W, B, strict=True)))
_BASE = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:3] AS v FROM embeddings), z AS (SELECT vec_id, v, {_Z} FROM e),
p AS (SELECT vec_id, v, [z0 / (z0 + z1 + z2), z1 / (z0 + z1 + z2), z2 / (z0 + z1 + z2)] AS p FROM z),
l AS (SELECT *, list_position(p, list_max(p)) - 1 AS label FROM p)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return b.scored(e.select(F.col("vec_id").alias("row_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("features")), MODEL)


@query(f"WITH {_BASE} SELECT vec_id, CAST(label AS INTEGER) AS label, round(p[1], 6) AS p0, round(p[3], 6) AS p2 FROM l")
def b01_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select(F.col("row_id").alias("vec_id"), "label", F.round(F.element_at("p", 1), 6).alias("p0"), F.round(F.element_at("p", 3), 6).alias("p2"))


@query(f"WITH {_BASE} SELECT vec_id, CAST(label AS INTEGER) AS label FROM l")
def b03_scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("features"))
    return b.scored_once(e, MODEL, digits=12).select("vec_id", "label")


@query(f"""WITH {_BASE}, m AS (SELECT 0 AS c, avg(p[1]) AS m FROM p UNION ALL SELECT 1, avg(p[2]) FROM p UNION ALL SELECT 2, avg(p[3]) FROM p),
w AS (SELECT x.c AS a, y.c AS b, x.m * y.m AS w FROM m x JOIN m y ON x.c < y.c), s AS (SELECT a, b, w / sum(w) OVER () AS weight FROM w), f AS (SELECT *, round(weight * 750, 9) AS ex, floor(round(weight * 750, 9)) AS base FROM s)
SELECT a, b, CAST(base + CASE WHEN row_number() OVER (ORDER BY ex - base DESC, a DESC, b DESC) <= 750 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def b05_pair_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.pair_quotas(rows(spark, sf_dir), 750).select("a", "b", "quota")


_SEEDS = """, mg AS (SELECT *, abs(p[1] - p[2]) AS margin FROM l WHERE label IN (0, 1)), ct AS (SELECT label, quantile_cont(margin, 0.25) AS cut FROM mg GROUP BY label),
seeds AS (SELECT mg.* FROM mg JOIN ct ON ct.label = mg.label WHERE margin <= cut + 1e-12 QUALIFY row_number() OVER (PARTITION BY mg.label ORDER BY round(margin, 9), vec_id) <= 48)"""


@query(f"WITH {_BASE}{_SEEDS} SELECT vec_id, round(margin, 6) AS margin FROM seeds")
def b06_margin_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.margin_seeds(rows(spark, sf_dir), 0, 1).select(F.col("row_id").alias("vec_id"), *r6("margin"))


_PAIRS = """, pr AS (SELECT x.vec_id AS i, y.vec_id AS j, x.v AS vi, y.v AS vj, x.p AS pi, y.p AS pj, sqrt(pow(x.v[1] - y.v[1], 2) + pow(x.v[2] - y.v[2], 2) + pow(x.v[3] - y.v[3], 2)) AS d FROM seeds x JOIN seeds y ON x.label = 0 AND y.label = 1),
nr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rk FROM pr), near AS (SELECT * FROM nr WHERE rk <= 5 AND d <= (SELECT quantile_cont(d, 0.35) FROM pr) + 1e-12)"""


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.nearest_pairs(stored(b.margin_seeds(rows(spark, sf_dir), 0, 1), "seeds"), 0, 1)  # at most 96 rows


@query(f"WITH {_BASE}{_SEEDS}{_PAIRS} SELECT i, j, round(d, 6) AS d FROM near")
def b07_nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).select("i", "j", *r6("d"))


_H = "-({0}[1] * ln({0}[1] + 1e-12) + {0}[2] * ln({0}[2] + 1e-12) + {0}[3] * ln({0}[3] + 1e-12))"


@query(f"WITH {_BASE}{_SEEDS}{_PAIRS} SELECT i, j, round(0.45 * (1 - (abs(pi[1] - pi[2]) + abs(pj[1] - pj[2])) / 2) + 0.35 * ({_H.format('pi')} + {_H.format('pj')}) / 2 + 0.2 * (1 - d / sqrt(3)), 6) AS score FROM near")
def b09_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda p: F.element_at(p, 1) - F.element_at(p, 2)
    score = b.candidate_score(m("pi"), m("pj"), g.entropy(F.col("pi")), g.entropy(F.col("pj")), F.col("d"), 3)
    return near(spark, sf_dir).select("i", "j", F.round(score, 6).alias("score"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = near(spark, sf_dir)
    return n.select(F.concat_ws("-", "i", "j").alias("seg_id"), F.col("xi").alias("x0"), F.col("xj").alias("xb"), F.lit(0).alias("y0"), F.lit(1).alias("yb"), F.col("pi").alias("s0"))


@query()
def b12_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.flips(segments(spark, sf_dir), PREDICT).select("seg_id", "t", "y0", "y1")


_REC = ", q AS (SELECT x.vec_id, x.v AS x0, y.v AS x1, x.p AS s0, y.p AS s1, x.label AS y0, y.label AS y1 FROM l x JOIN l y ON y.vec_id = x.vec_id + 1 WHERE x.label <> y.label)"
_MET = """, d0 AS (SELECT *, s0[y0 + 1] - s0[y1 + 1] AS m0, s1[y0 + 1] - s1[y1 + 1] AS m1, ln(s1[y1 + 1] + 1e-12) - ln(s1[y0 + 1] + 1e-12) - (ln(s0[y1 + 1] + 1e-12) - ln(s0[y0 + 1] + 1e-12)) AS logit_gain,
 0.5 * (greatest(0, s0[y0 + 1] - s1[y0 + 1]) + greatest(0, s1[y1 + 1] - s0[y1 + 1])) AS prob_swing, sqrt(pow(x1[1] - x0[1], 2) + pow(x1[2] - x0[2], 2) + pow(x1[3] - x0[3], 2)) AS delta_l2, greatest(abs(x1[1] - x0[1]), abs(x1[2] - x0[2]), abs(x1[3] - x0[3])) AS delta_linf,
 0.5 * (s0[1] * log2(2 * s0[1] / (s0[1] + s1[1])) + s0[2] * log2(2 * s0[2] / (s0[2] + s1[2])) + s0[3] * log2(2 * s0[3] / (s0[3] + s1[3]))) + 0.5 * (s1[1] * log2(2 * s1[1] / (s0[1] + s1[1])) + s1[2] * log2(2 * s1[2] / (s0[2] + s1[2])) + s1[3] * log2(2 * s1[3] / (s0[3] + s1[3]))) AS jsd FROM q),
d1 AS (SELECT *, y1 <> y0 AND m1 <= -0.02 AND logit_gain >= 0.25 AS success, 0.7 * prob_swing + 0.3 * greatest(0, -m1) + 0.2 * jsd AS score_change FROM d0)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rows(spark, sf_dir)
    y = x.select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("x1"), F.col("p").alias("s1"), F.col("label").alias("y1"))
    q = x.select("row_id", F.col("features").alias("x0"), F.col("p").alias("s0"), F.col("label").alias("y0")).join(y, "row_id").filter("y0 <> y1")
    return b.delta_metrics(q)


@query(f"WITH {_BASE}{_REC}{_MET} SELECT vec_id, success, round(m1, 6) AS m1, round(logit_gain, 6) AS logit_gain, round(jsd, 6) AS jsd, round(delta_l2, 6) AS delta_l2, round(delta_linf, 6) AS delta_linf, round(score_change, 6) AS score_change FROM d1")
def b13_delta_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("row_id").alias("vec_id"), "success", *r6("m1", "logit_gain", "jsd", "delta_l2", "delta_linf", "score_change"))


_FIN = """, q5 AS (SELECT y0, y1, quantile_cont(delta_l2, 0.95) AS d95, quantile_cont(score_change, 0.95) AS c95 FROM d1 WHERE success GROUP BY 1, 2),
fin AS (SELECT d1.*, CASE WHEN success THEN 0.6 * greatest(0, least(1, score_change / greatest(c95, 1e-12))) + 0.4 * (1 - greatest(0, least(1, delta_l2 / greatest(d95, 1e-12)))) ELSE 0 END AS final_score FROM d1 LEFT JOIN q5 ON q5.y0 = d1.y0 AND q5.y1 = d1.y1)"""


@query(f"WITH {_BASE}{_REC}{_MET}{_FIN} SELECT vec_id, round(final_score, 6) AS final_score FROM fin")
def b14_final_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.final_scores(records(spark, sf_dir)).select(F.col("row_id").alias("vec_id"), *r6("final_score"))


@query(f"WITH {_BASE}{_REC}{_MET}{_FIN}, t AS (SELECT vec_id, y0, y1, row_number() OVER (PARTITION BY y0, y1 ORDER BY round(final_score, 9) DESC, vec_id) AS turn FROM fin) SELECT vec_id, row_number() OVER (ORDER BY turn, y0, y1) AS place FROM t QUALIFY place <= 40")
def b11_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.final_scores(records(spark, sf_dir)).select("row_id", F.col("y0").alias("a"), F.col("y1").alias("b"), F.round("final_score", 9).alias("score"))
    return b.round_robin(r, 40, "row_id").select(F.col("row_id").alias("vec_id"), "place")


@query(f"WITH {_BASE}{_REC}{_MET}{_FIN} SELECT vec_id, round(final_score, 6) AS final_score FROM fin ORDER BY round(final_score, 9) DESC, vec_id LIMIT 10")
def b19_top_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.final_scores(records(spark, sf_dir)).orderBy(F.round("final_score", 9).desc(), "row_id").limit(10)
    return r.select(F.col("row_id").alias("vec_id"), *r6("final_score"))


@query()
def b15_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.change_points(segments(spark, sf_dir), PREDICT)


@query(f"WITH {_BASE}{_REC} SELECT vec_id AS rec_id, CAST(least(y0, y1) AS INTEGER) AS y0, CAST(greatest(y0, y1) AS INTEGER) AS y1, y0 > y1 AS swapped, round(CASE WHEN y0 > y1 THEN x1[1] ELSE x0[1] END, 6) AS first FROM q")
def b20_ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.ordered_pairs(records(spark, sf_dir).withColumnRenamed("row_id", "rec_id")).select("rec_id", "y0", "y1", "swapped", F.round(F.element_at("x0", 1), 6).alias("first"))


@query("WITH u AS (SELECT unnest(range(64)) AS dim), e AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT dim, round(var_pop(v[dim + 1]), 6) AS variance FROM e, u GROUP BY dim QUALIFY row_number() OVER (ORDER BY round(var_pop(v[dim + 1]), 9) DESC, dim) <= 3")
def b23_top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return b.top_variance(e, "v", 64).select(F.col("dim").cast("long").alias("dim"), *r6("variance"))


_WT = ", pw AS (SELECT vec_id, y0, y1, x1 AS x, pow(greatest(0, least(1, final_score)), 2) AS raw FROM fin WHERE success), wt AS (SELECT *, raw / sum(raw) OVER (PARTITION BY y0, y1) AS w FROM pw)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.weighted_points(b.final_scores(records(spark, sf_dir)).filter("success").withColumn("x", F.col("x1")))


@query(f"WITH {_BASE}{_REC}{_MET}{_FIN}{_WT} SELECT vec_id, round(w, 6) AS w FROM wt")
def f01_frontier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("row_id").alias("vec_id"), *r6("w"))


@query(f"WITH {_BASE}{_REC}{_MET}{_FIN}{_WT} SELECT CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1, count(*) AS n, round(sum(w * x[1]), 6) AS m0, round(sum(w * x[1] * x[2]) - sum(w * x[1]) * sum(w * x[2]), 6) AS c01 FROM wt GROUP BY y0, y1")
def f02_weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.weighted_moments(points(spark, sf_dir), 3)
    return m.select("y0", "y1", "n", F.round(F.element_at("mean", 1), 6).alias("m0"), F.round(F.element_at(F.element_at("cov", 1), 2), 6).alias("c01"))


@query()
def f03_tls_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.tls_planes(b.weighted_moments(points(spark, sf_dir), 3))


@query()
def f23_frontier_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import surfaces

    return surfaces.frontier_planes(points(spark, sf_dir).select("y0", "y1", "x", "x0"), subspaces=[[0, 1]])


@query()
def f04_quadrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import surfaces

    return surfaces.surfaces(points(spark, sf_dir).select("y0", "y1", "x", "w"), 2)


@query()
def f05_cubics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import surfaces

    return surfaces.surfaces(points(spark, sf_dir).select("y0", "y1", "x", "w"), 3)


@query(f"WITH {_BASE}{_SEEDS}{_PAIRS}, ft AS (SELECT i, j, d FROM pr WHERE d >= (SELECT quantile_cont(d, 0.8) FROM pr) - 1e-12 QUALIFY row_number() OVER (PARTITION BY i ORDER BY md5('0:' || i || ':' || j)) <= 2) SELECT i, j, round(d, 6) AS d FROM ft")
def b08_far_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.far_pairs(b.margin_seeds(rows(spark, sf_dir), 0, 1), 0, 1).select("i", "j", *r6("d"))


@query(f"WITH {_BASE}{_REC} SELECT 'frontier' AS kind, CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1, count(DISTINCT [round(x1[1] / 1e-6), round(x1[2] / 1e-6), round(x1[3] / 1e-6)]) AS n FROM q GROUP BY y0, y1")
def b21_frontier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.frontier_sets(records(spark, sf_dir)).groupBy("kind", "y0", "y1").agg(F.count("*").alias("n"))


@query(f"WITH {_BASE}{_REC}{_MET} SELECT count(*) AS n, round(avg(delta_l2), 6) AS mean_length, round(avg((x0[1] + x1[1]) / 2), 6) AS mid0, round(avg((x1[1] - x0[1]) / delta_l2), 6) AS u0 FROM d1 WHERE delta_l2 > 1e-12")
def f12_segment_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.segment_arrays(records(spark, sf_dir))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.round(F.avg(F.element_at("mid", 1)), 6).alias("mid0"), F.round(F.avg(F.element_at("u", 1)), 6).alias("u0"))


@query(f"WITH {_BASE}, r AS (SELECT abs(v[1] - 0.5 * v[2] + 0.02) AS r FROM e), m AS (SELECT quantile_cont(r, 0.5) AS med FROM r) SELECT round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(abs(r - med), 0.5), 6) AS mad, round(sqrt(avg(r * r)), 6) AS rmse FROM r, m")
def f15_residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.residual_stats(rows(spark, sf_dir).select(F.col("features").alias("x")), [1.0, -0.5, 0.0], 0.02).select(*r6("mean", "median", "mad", "rmse"))


@query(f"WITH {_BASE} SELECT vec_id, round(v[1] * 0.6 + v[2] * 0.8 - 0.1, 6) AS residual FROM e")
def k01_plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.round(g.residual(F.slice("features", 1, 2), g.vector([0.6, 0.8]), F.lit(-0.1)), 6).alias("residual"))


@query(f"WITH {_BASE} SELECT vec_id, CAST(label AS INTEGER) AS label, round(p[1], 6) AS p0 FROM l")
def b02_scored_once_by_a_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("features"))
    return models.scored_once_by(e, PREDICT, digits=12).select("vec_id", "label", F.round(F.element_at("p", 1), 6).alias("p0"))


_SPLITS = [(0, -0.1), (0, 0.0), (0, 0.1), (1, -0.05), (1, 0.05), (2, 0.0)]
_CROSS = f""", sp(feature, threshold) AS (VALUES {', '.join(map(str, _SPLITS))}), sg AS (SELECT vec_id, x0, x1 FROM q),
cr AS (SELECT vec_id, (threshold - x0[feature + 1]) / (x1[feature + 1] - x0[feature + 1]) AS t FROM sg JOIN sp ON threshold > least(x0[feature + 1], x1[feature + 1]) AND threshold < greatest(x0[feature + 1], x1[feature + 1]))"""


@query(f"WITH {_BASE}{_REC}{_CROSS} SELECT vec_id, count(DISTINCT round(t / 1e-9)) AS crossings, round(min(t), 6) AS first FROM cr GROUP BY vec_id")
def b16_split_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = records(spark, sf_dir).select(F.col("row_id").alias("seg_id"), "x0", F.col("x1").alias("xb"))
    splits = spark.createDataFrame(_SPLITS, "feature int, threshold double")
    t = b.split_crossings(segs, splits)
    return t.groupBy(F.col("seg_id").alias("vec_id")).agg(F.count("*").alias("crossings"), F.round(F.min("t"), 6).alias("first"))


@query()
def b19_sample_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("features"))
    return b.sample_boundary(e, (MODEL, PREDICT), target=60).select("rec_id", "a", "b", "place", *r6("final_score"))


_DIMS = 64


@query("WITH u AS (SELECT unnest(range(64)) AS dim), e AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT round(sum(x), 4) AS total FROM (SELECT var_pop(v[dim + 1]) AS x FROM e, u GROUP BY dim)")
def b22_principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 axes of the embeddings; what they explain together is the columns' total variance."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return b.principal_axes(e, "v", _DIMS, _DIMS).agg(F.round(F.sum("variance"), 4).alias("total"))


@query(f"""WITH {_BASE}{_REC}{_MET}{_FIN}, pt AS (SELECT vec_id, y0, y1, x1 AS x, pow(greatest(0, least(1, final_score)), 2) AS raw FROM fin WHERE success),
ds AS (SELECT a.vec_id, a.y0, a.y1, sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2) + pow(a.x[3] - b.x[3], 2)) AS d, b.vec_id AS o, count(*) OVER (PARTITION BY a.vec_id) AS m FROM pt a JOIN pt b ON a.y0 = b.y0 AND a.y1 = b.y1),
nb AS (SELECT vec_id, greatest(avg(d), 1e-12) AS spacing FROM (SELECT * FROM ds WHERE m > 8 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), o) <= 9) GROUP BY vec_id),
rw AS (SELECT pt.vec_id, y0, y1, raw / coalesce(spacing, 1) AS r FROM pt LEFT JOIN nb ON nb.vec_id = pt.vec_id)
SELECT vec_id, round(r / sum(r) OVER (PARTITION BY y0, y1), 6) AS w FROM rw""")
def f01_density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.final_scores(records(spark, sf_dir)).filter("success").select(F.col("row_id").alias("rec_id"), "y0", "y1", "final_score", F.col("x1").alias("x"))
    return b.weighted_points(stored(own, "points"), density_k=8).select(F.col("rec_id").alias("vec_id"), *r6("w"))


_QUAD = {"coef": [0.5, 1.0, -2.0, 0.25, 0.5, -1.5], "mu": [0.1, -0.2], "sd": [0.5, 2.0]}


@query(f"WITH {_BASE}, z2 AS (SELECT vec_id, (v[1] - 0.1) / 0.5 AS a, (v[2] + 0.2) / 2.0 AS b FROM e) SELECT vec_id, round(0.5 + a - 2 * b + 0.25 * a * a + 0.5 * a * b - 1.5 * b * b, 6) AS value FROM z2")
def f06_surface_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import surfaces

    model = _QUAD | {"terms": surfaces.monomials(2, 2)}
    return rows(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.round(surfaces.surface_value("features", model), 6).alias("value"))


@query()
def f08_separating_quadrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import surfaces

    return surfaces.surfaces(points(spark, sf_dir).select("y0", "y1", "x", "x0", "w"), 2, "logistic")
