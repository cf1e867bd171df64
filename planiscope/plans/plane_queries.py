"""Queries over planes and half-spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cells as cell_ops
from ..operators import planes as p
from ..operators import selection
from ..storage import stored
from .catalog import query
from .inputs import FEATURES, PAIRS, SAMPLES_SQL, r6, samples, table

#: Quantile steps of the standard bank: 5 per feature, 40 half-spaces.
STEPS = 5

_TH = "\n UNION ALL ".join(f"SELECT {f} AS feature, {q} AS q, round(quantile_cont(x{f}, {0.2 + 0.6 * q / (STEPS - 1)!r}), 6) AS t FROM s" for f in range(4) for q in range(STEPS))
#: One chain of common tables; every oracle reads from its own place in it and counts raw rows, not cells.
CHAIN = f"""WITH {SAMPLES_SQL},
th AS ({_TH}),
hs AS (SELECT CAST((feature * {STEPS} + q) * 2 + d.k AS INTEGER) AS hs_id, 'pl' || lpad(CAST(feature * {STEPS} + q AS VARCHAR), 4, '0') AS plane_id,
  feature, t AS threshold, CASE WHEN d.k = 0 THEN 1 ELSE -1 END AS side FROM th, (SELECT 0 AS k UNION ALL SELECT 1) d),
v AS (SELECT y, 0 AS feature, x0 AS x FROM s UNION ALL SELECT y, 1, x1 FROM s UNION ALL SELECT y, 2, x2 FROM s UNION ALL SELECT y, 3, x3 FROM s),
classes AS (SELECT y, count(*) AS pos FROM s GROUP BY y),
inside AS (SELECT hs_id, y, count(*) AS c FROM hs JOIN v ON hs.feature = v.feature AND CASE WHEN side > 0 THEN x - threshold <= 0 ELSE x - threshold >= 0 END GROUP BY hs_id, y),
conf AS (SELECT hs.hs_id, c.y, coalesce(i.c, 0) AS tp, CAST(coalesce(sum(i2.c), 0) AS BIGINT) - coalesce(i.c, 0) AS fp, c.pos - coalesce(i.c, 0) AS fn,
  (SELECT count(*) FROM s) - CAST(coalesce(sum(i2.c), 0) AS BIGINT) - (c.pos - coalesce(i.c, 0)) AS tn
  FROM hs CROSS JOIN classes c LEFT JOIN inside i ON i.hs_id = hs.hs_id AND i.y = c.y LEFT JOIN inside i2 ON i2.hs_id = hs.hs_id GROUP BY hs.hs_id, c.y, i.c, c.pos),
met0 AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS acc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS tnr,
  (tp + fn) / (tp + fp + fn + tn)::DOUBLE AS baseline, tp + fp AS region_size, (tp + fp) / (tp + fp + fn + tn)::DOUBLE AS region_frac FROM conf),
met1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, 0.5 * (recall + tnr) AS balacc, precision / baseline AS lift FROM met0),
met AS (SELECT *, 0.5 * balacc + 0.4 * lift * pow(recall, 0.6) + 0.1 * precision AS score FROM met1),
guard AS (SELECT * FROM met WHERE region_size >= 20 AND (lift >= 1.05 OR precision - baseline >= 0.01) AND precision >= 0),
top AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(score, 9) DESC, hs_id) AS rank FROM guard)
"""


def bank(spark: SparkSession, sf_dir: str):
    s = samples(spark, sf_dir)
    return s, p.axis_half_spaces(p.quantile_cuts(s, FEATURES, STEPS))


def scored(spark: SparkSession, sf_dir: str):
    s, hs = bank(spark, sf_dir)
    cells = stored(cell_ops.histogram(s, [h.column(FEATURES) for h in hs]), "cells")  # one scan, then a few thousand rows
    return hs, cells, p.with_metrics(p.confusion(cells, len(hs)))


_TH15 = " UNION ALL ".join(f"SELECT {f} AS feature, {q} AS q, round(quantile_cont(x{f}, {0.2 + 0.6 * q / 14!r}), 6) AS t FROM s" for f in range(4) for q in range(15))


@query(f"WITH {SAMPLES_SQL}, th AS ({_TH15}) SELECT a.pa AS pair_a, a.pb AS pair_b, feature, q, t AS threshold FROM th, (SELECT 0 AS pa, 1 AS pb UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 2) a")
def s05_threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.threshold_selection(samples(spark, sf_dir), FEATURES, PAIRS)


@query(f"""WITH {SAMPLES_SQL}, m AS (SELECT y, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM s GROUP BY y),
g AS (SELECT a.y AS pair_a, b.y AS pair_b, d.k AS dim, CASE d.k WHEN 0 THEN a.m0 WHEN 1 THEN a.m1 WHEN 2 THEN a.m2 ELSE a.m3 END AS ma, CASE d.k WHEN 0 THEN b.m0 WHEN 1 THEN b.m1 WHEN 2 THEN b.m2 ELSE b.m3 END AS mb
  FROM m a JOIN m b ON a.y < b.y, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) d),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_a, pair_b ORDER BY round(abs(ma - mb), 9) DESC, dim) AS rk FROM g)
SELECT pair_a, pair_b, dim, round((ma + mb) / 2, 6) AS threshold, CASE WHEN ma <= mb THEN 1 ELSE -1 END AS side FROM r WHERE rk = 1""")
def s03_mean_gap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.mean_gap_selection(samples(spark, sf_dir), FEATURES).select("pair_a", "pair_b", "dim", F.round("threshold", 6).alias("threshold"), "side")


@query(CHAIN + """, sc AS (SELECT plane_id, p.a AS pair_a, p.b AS pair_b, avg(CASE WHEN v.y = p.a THEN CASE WHEN x <= threshold THEN 1.0 ELSE 0.0 END END) AS in_a, avg(CASE WHEN v.y = p.b THEN CASE WHEN x <= threshold THEN 1.0 ELSE 0.0 END END) AS in_b
  FROM hs JOIN v ON hs.feature = v.feature AND side = 1 JOIN (SELECT 0 AS a, 1 AS b UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 2) p ON v.y IN (p.a, p.b) GROUP BY plane_id, p.a, p.b)
SELECT plane_id, pair_a, pair_b, CASE WHEN in_a + 1 - in_b >= 1 - in_a + in_b THEN 1 ELSE -1 END AS side, round(greatest(in_a + 1 - in_b, 1 - in_a + in_b), 6) AS score FROM sc""")
def s04_frontier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hs = bank(spark, sf_dir)
    return selection.orient_by_means(s, [h for h in hs if h.side > 0], FEATURES, PAIRS).select("plane_id", "pair_a", "pair_b", "side", *r6("score"))


@query(f"""WITH {SAMPLES_SQL}, u AS (SELECT y, 0 AS dim, x0 AS x FROM s UNION ALL SELECT y, 1, x1 FROM s UNION ALL SELECT y, 2, x2 FROM s UNION ALL SELECT y, 3, x3 FROM s),
m AS (SELECT y, dim, avg(x) AS m FROM u GROUP BY y, dim),
c AS (SELECT a.y AS pair_a, b.y AS pair_b, a.dim, a.m + (b.m - a.m) / 3 AS t1, a.m + (b.m - a.m) * 2 / 3 AS t2 FROM m a JOIN m b ON a.dim = b.dim AND a.y < b.y),
q AS (SELECT c.pair_a, c.pair_b, c.dim, quantile_cont(u.x, 0.25) AS q1, quantile_cont(u.x, 0.5) AS q2, quantile_cont(u.x, 0.75) AS q3 FROM c JOIN u ON u.dim = c.dim AND u.y IN (c.pair_a, c.pair_b) GROUP BY 1, 2, 3)
SELECT DISTINCT pair_a, pair_b, dim, round(t, 4) AS threshold FROM (SELECT pair_a, pair_b, dim, t1 AS t FROM c UNION ALL SELECT pair_a, pair_b, dim, t2 FROM c UNION ALL SELECT pair_a, pair_b, dim, q1 FROM q UNION ALL SELECT pair_a, pair_b, dim, q2 FROM q UNION ALL SELECT pair_a, pair_b, dim, q3 FROM q)""")
def s06_axis_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.axis_frontier(samples(spark, sf_dir), FEATURES, PAIRS)


@query(f"WITH {SAMPLES_SQL} SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS share FROM s GROUP BY y")
def h01_class_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.class_baseline(samples(spark, sf_dir)).select("y", "n", *r6("share"))


_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def embedded(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.slice(v, 1, dims) if dims else v).alias("v"))


@query(f"WITH {_EMB} SELECT vec_id, round(v[1] / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12), 6) AS u0, round(0.5 / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12), 6) AS b_norm FROM e")
def h02_plane_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.normalized(embedded(spark, sf_dir).withColumn("b", F.lit(0.5)), "v")
    return rows.select("vec_id", F.round(F.element_at("u", 1), 6).alias("u0"), *r6("b_norm"))


@query(f"""WITH {_EMB}, h AS (SELECT vec_id, v[1] - 2 * v[2] + 0.5 * v[3] + 0.01 AS r FROM e) SELECT vec_id, round(r, 6) AS residual, r <= 0 AS below, r >= 0 AS above FROM h""")
def h03_half_space_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = g.residual(F.slice("v", 1, 3), g.vector([1, -2, 0.5]), F.lit(0.01))
    rows = embedded(spark, sf_dir).select("vec_id", r.alias("r"))
    return rows.select("vec_id", F.round("r", 6).alias("residual"), g.inside(F.col("r"), F.lit(1)).alias("below"), g.inside(F.col("r"), F.lit(-1)).alias("above"))


@query(f"""WITH {SAMPLES_SQL}, pr AS (SELECT 0 AS plane, x0 / 50 - x1 / 100000 AS h FROM s UNION ALL SELECT 1, x2 * 10 - x3 * 10 + 0.05 FROM s UNION ALL SELECT 2, x0 / 50 + x2 * 10 - 1 FROM s)
SELECT plane, count(*) AS n, round(avg(h), 6) AS mean, round(min(h), 6) AS low, round(max(h), 6) AS high FROM pr GROUP BY plane""")
def h04_batched_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = [([0.02, -1e-5, 0, 0], 0.0), ([0, 0, 10, -10], 0.05), ([0.02, 0, 10, 0], -1.0)]
    rows = samples(spark, sf_dir).select(F.posexplode(F.array(*[g.linear(FEATURES, n, b) for n, b in normals])).alias("plane", "h"))
    return rows.groupBy("plane").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("mean"), F.round(F.min("h"), 6).alias("low"), F.round(F.max("h"), 6).alias("high"))


@query(CHAIN + "SELECT hs_id, y, tp, fp, fn, tn FROM conf")
def h05_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)[2].select("hs_id", "y", "tp", "fp", "fn", "tn")


_M = ("acc", "precision", "recall", "f1", "balacc", "baseline", "lift", "region_frac")


@query(CHAIN + f"SELECT hs_id, y, region_size, {', '.join(f'round({m}, 6) AS {m}' for m in _M)} FROM met")
def h06_ovr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)[2].select("hs_id", "y", "region_size", *r6(*_M))


@query(CHAIN + "SELECT hs_id, y AS best_class, round(score, 6) AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY hs_id ORDER BY round(score, 9) DESC, y) AS rk FROM met) WHERE rk = 1")
def h07_class_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.best_class(scored(spark, sf_dir)[2]).select("hs_id", "best_class", *r6("best_score"))


@query(CHAIN + "SELECT hs_id, round(coalesce(sum(CASE WHEN tp > 0 THEN -(tp / (tp + fp)::DOUBLE) * ln(tp / (tp + fp)::DOUBLE + 1e-12) END), 0), 6) AS entropy FROM conf GROUP BY hs_id")
def h08_region_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.region_entropy(scored(spark, sf_dir)[2]).select("hs_id", *r6("entropy"))


@query(CHAIN + "SELECT hs_id, plane_id, plane_id || CASE WHEN side > 0 THEN ':≤' ELSE ':≥' END AS oriented_id, feature, threshold, side FROM hs")
def h09_plane_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.half_space_table(spark, bank(spark, sf_dir)[1]).select("hs_id", "plane_id", "oriented_id", "feature", "threshold", "side")


_REG = """, vv AS (SELECT hs.hs_id, r.rid FROM hs JOIN (SELECT row_number() OVER () AS rid, * FROM s) r ON CASE WHEN side > 0 THEN (CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END) - threshold <= 0 ELSE (CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END) - threshold >= 0 END),
sz AS (SELECT hs_id, count(*) AS n FROM vv GROUP BY hs_id),
pr AS (SELECT a.hs_id AS a, b.hs_id AS b FROM hs a JOIN hs b ON a.hs_id < b.hs_id AND a.feature = b.feature AND abs(a.threshold - b.threshold) <= 0.015),
bo AS (SELECT pr.a, pr.b, count(y.rid) AS n FROM pr LEFT JOIN vv x ON x.hs_id = pr.a LEFT JOIN vv y ON y.hs_id = pr.b AND y.rid = x.rid GROUP BY pr.a, pr.b),
edges AS (SELECT bo.a, bo.b FROM bo JOIN sz sa ON sa.hs_id = bo.a JOIN sz sb ON sb.hs_id = bo.b JOIN hs ha ON ha.hs_id = bo.a JOIN hs hb ON hb.hs_id = bo.b
  WHERE ha.side <> hb.side OR bo.n / (sa.n + sb.n - bo.n)::DOUBLE >= 0.8)
"""
_FAM = """, walk AS (SELECT hs_id, hs_id AS seen FROM hs UNION SELECT w.hs_id, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN edges e ON w.seen IN (e.a, e.b)),
fam AS (SELECT hs_id, min(seen) AS family FROM walk GROUP BY hs_id)
"""
RCHAIN = CHAIN.replace("WITH ", "WITH RECURSIVE ", 1) + _REG + _FAM


def edges_of(spark: SparkSession, hs, cells) -> DataFrame:
    spaces = p.normalized(p.half_space_table(spark, hs))
    return p.family_edges(spaces, p.region_jaccard(cells, len(hs)), tau=0.015)


@query(CHAIN + _REG + "SELECT a, b FROM edges")
def h10_family_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, _ = scored(spark, sf_dir)
    return edges_of(spark, hs, cells)


@query(CHAIN + _REG + "SELECT x.hs_id AS a, y.hs_id AS b, e.a IS NOT NULL AS similar FROM hs x JOIN hs y ON x.hs_id < y.hs_id LEFT JOIN edges e ON e.a = x.hs_id AND e.b = y.hs_id")
def h11_similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, _ = scored(spark, sf_dir)
    ids = spark.range(len(hs)).select(F.col("id").cast("int").alias("a"))
    edges = edges_of(spark, hs, cells).withColumn("similar", F.lit(True))
    return ids.join(ids.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).join(edges, ["a", "b"], "left").na.fill(False)


def families_of(spark: SparkSession, hs, cells) -> DataFrame:
    return p.families(spark.range(len(hs)).select(F.col("id").cast("int").alias("hs_id")), edges_of(spark, hs, cells))


@query(RCHAIN + "SELECT hs_id, family FROM fam")
def h12_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, _ = scored(spark, sf_dir)
    return families_of(spark, hs, cells)


@query(CHAIN + "SELECT hs_id, y, round(score, 6) AS score FROM guard")
def h14_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.guardrails(scored(spark, sf_dir)[2]).select("hs_id", "y", *r6("score"))


@query(CHAIN + "SELECT hs_id, y, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY hs_id ORDER BY round(score, 9) DESC, y) AS rk FROM met) m WHERE rk = 1 AND EXISTS (SELECT 1 FROM guard g WHERE g.hs_id = m.hs_id AND g.y = m.y)")
def h15_best_class_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)[2]
    best = p.best_class(rows).select("hs_id", F.col("best_class").alias("y"))
    return p.guardrails(rows).join(best, ["hs_id", "y"], "left_semi").select("hs_id", "y", *r6("score"))


@query(CHAIN + "SELECT y, rank, hs_id, round(score, 6) AS score, round(lift, 6) AS lift, round(f1, 6) AS f1 FROM top WHERE rank <= 200")
def h16_top_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.top_per_class(p.guardrails(scored(spark, sf_dir)[2]))
    return rows.select("y", "rank", "hs_id", *r6("score", "lift", "f1"))


_BEST = """, gl AS (SELECT hs_id, max(round(score, 9)) AS score_global FROM met GROUP BY hs_id),
bfs AS (SELECT * FROM (SELECT g.hs_id, hs.side, f.family, score_global, row_number() OVER (PARTITION BY f.family, hs.side ORDER BY score_global DESC, g.hs_id) AS rk FROM gl g JOIN hs ON hs.hs_id = g.hs_id JOIN fam f ON f.hs_id = g.hs_id) WHERE rk = 1)
"""


@query(RCHAIN + _BEST + "SELECT family, side, hs_id, round(score_global, 6) AS score_global FROM bfs")
def h17_best_per_family_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, rows = scored(spark, sf_dir)
    best = p.best_per_family_side(rows, p.half_space_table(spark, hs), families_of(spark, hs, cells))
    return best.select("family", "side", "hs_id", *r6("score_global"))


@query(RCHAIN + _BEST + "SELECT 'rg' || lpad(CAST(row_number() OVER (ORDER BY hs_id, turn DESC) - 1 AS VARCHAR), 5, '0') AS region_id, hs_id, CAST(side * turn AS INTEGER) AS region_side FROM bfs, (SELECT 1 AS turn UNION ALL SELECT -1)")
def h18_region_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, rows = scored(spark, sf_dir)
    best = p.best_per_family_side(rows, p.half_space_table(spark, hs), families_of(spark, hs, cells))
    return p.emit_regions(best, "both").select("region_id", "hs_id", "region_side")


_PAIR = """, pairs AS (SELECT 0 AS pa, 1 AS pb UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 2),
pc AS (SELECT pa, pb, hs.hs_id, c.y, coalesce(i.c, 0) AS tp, c.pos, (SELECT coalesce(sum(c), 0) FROM inside z WHERE z.hs_id = hs.hs_id AND z.y IN (pa, pb)) AS region, (SELECT sum(pos) FROM classes k WHERE k.y IN (pa, pb)) AS n
  FROM pairs JOIN classes c ON c.y IN (pa, pb) CROSS JOIN hs LEFT JOIN inside i ON i.hs_id = hs.hs_id AND i.y = c.y),
pm AS (SELECT *, CASE WHEN region > 0 THEN tp / region::DOUBLE ELSE 0 END AS precision, tp / pos::DOUBLE AS recall, (n - region - (pos - tp)) / (n - pos)::DOUBLE AS tnr, pos / n::DOUBLE AS baseline FROM pc),
ps AS (SELECT *, 0.5 * (recall + tnr) AS balacc, precision / baseline AS lift, 0.5 * 0.5 * (recall + tnr) + 0.4 * (precision / baseline) * pow(recall, 0.6) + 0.1 * precision AS score FROM pm)
"""


def pairs_of(spark: SparkSession, sf_dir: str):
    hs, cells, _ = scored(spark, sf_dir)
    return hs, cells, p.pair_metrics(cells, len(hs), PAIRS)


@query(CHAIN + _PAIR + "SELECT pa AS pair_a, pb AS pair_b, hs_id, y, round(balacc, 6) AS balacc, round(lift, 6) AS lift, round(score, 6) AS score FROM ps")
def h19_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(spark, sf_dir)[2].select("pair_a", "pair_b", "hs_id", "y", *r6("balacc", "lift", "score"))


_REP = """, pb0 AS (SELECT pa, pb, hs_id, max(CASE WHEN y = pa THEN round(score, 9) END) AS score_a, max(round(score, 9)) AS score_pair, arg_max(lift, round(score, 9) - y * 1e-12) AS best_lift FROM ps GROUP BY pa, pb, hs_id),
rep AS (SELECT pb0.*, f.family, row_number() OVER (PARTITION BY pa, pb, f.family ORDER BY score_a DESC, score_pair DESC, pb0.hs_id) AS rk FROM pb0 JOIN fam f ON f.hs_id = pb0.hs_id)
"""


@query(RCHAIN + _PAIR + _REP + "SELECT pa AS pair_a, pb AS pair_b, family, hs_id, round(score_a, 6) AS score_a FROM rep WHERE rk = 1")
def h20_pair_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, rows = pairs_of(spark, sf_dir)
    return p.pair_representatives(rows, families_of(spark, hs, cells)).filter("rk = 1").select("pair_a", "pair_b", "family", "hs_id", *r6("score_a"))


@query(RCHAIN + _PAIR + _REP + "SELECT pa AS pair_a, pb AS pair_b, hs_id, (rk = 1 AND round(best_lift, 9) > 1) AS wins FROM rep")
def h21_lift_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, rows = pairs_of(spark, sf_dir)
    return p.winners(p.pair_representatives(rows, families_of(spark, hs, cells))).select("pair_a", "pair_b", "hs_id", "wins")


@query(f"WITH {SAMPLES_SQL}, t AS (SELECT round(quantile_cont(x0, 0.35), 6) AS a, round(quantile_cont(x1, 0.65), 6) AS b FROM s) SELECT y, count(*) AS pos, count(*) FILTER (WHERE x0 - a >= 0 AND x1 - b >= 0) AS inside FROM s, t GROUP BY y")
def h22_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, _ = scored(spark, sf_dir)
    return p.conjunction_counts(cells, [1 * 2 + 1, (STEPS + 3) * 2 + 1])


@query(RCHAIN + _PAIR + _REP + "SELECT pa AS pair_a, pb AS pair_b, CASE WHEN rk = 1 AND round(best_lift, 9) > 1 THEN 'winner' ELSE 'other' END AS kind, count(*) AS n FROM rep GROUP BY 1, 2, 3")
def h23_candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, rows = pairs_of(spark, sf_dir)
    w = p.winners(p.pair_representatives(rows, families_of(spark, hs, cells)))
    return w.groupBy("pair_a", "pair_b", F.when(F.col("wins"), "winner").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT hs_id, 'x' || feature || CASE WHEN side > 0 THEN ' ≤ ' ELSE ' ≥ ' END || printf('%.6f', threshold) AS inequality FROM hs")
def h25_inequality_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.half_space_table(spark, bank(spark, sf_dir)[1])
    return rows.select("hs_id", p.inequality_column(F.col("feature"), F.col("threshold"), F.col("side")).alias("inequality"))


@query(RCHAIN + _BEST + """SELECT b.hs_id, b.family, g.y AS target_class, round(g.score, 6) AS score FROM bfs b JOIN top g ON g.hs_id = b.hs_id WHERE g.rank <= 200""")
def h26_prune_and_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hs = bank(spark, sf_dir)
    return selection.prune_and_orient(s, hs, FEATURES, tau=0.015).select("hs_id", "family", "target_class", *r6("score"))


_KEYED = SAMPLES_SQL.replace("ELSE 0 END AS y FROM", "ELSE 0 END AS y, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS rid FROM")
_PART = CHAIN.replace(SAMPLES_SQL, _KEYED.replace("s AS", "whole AS", 1) + ", s AS (SELECT * FROM whole WHERE ('0x' || substr(md5(rid), 1, 8))::BIGINT < 429496729)").replace(_TH, _TH.replace("FROM s", "FROM whole"))
_FULL = CHAIN.replace(SAMPLES_SQL, _KEYED)


@query(f"SELECT hs_id, y, round(score, 6) AS score FROM ({_FULL} SELECT hs_id, y, score FROM guard) WHERE hs_id IN ({_PART} SELECT hs_id FROM guard)")
def h13_sketch_then_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hs = bank(spark, sf_dir)
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("rid")
    return p.sketched(samples(spark, sf_dir, rid), hs, FEATURES, "rid").select("hs_id", "y", *r6("score"))


@query()
def h24_greedy_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, cells, _ = scored(spark, sf_dir)
    rows = [(t, i, k) for t in (0, 1, 2) for i, k in enumerate(p.greedy_conjunction(cells, len(hs), t))]
    return spark.createDataFrame(rows, "target int, place int, hs_id int")


@query(f"WITH {SAMPLES_SQL} SELECT round(0.02 * 0 + 3 + 10 * avg(x2), 6) AS b_eff FROM s WHERE y = 1")
def r06_sliced_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = samples(spark, sf_dir).filter("y = 1").agg(*[F.avg(f).alias(f) for f in FEATURES]).first()
    n, b = p.sliced([0.02, -1e-5, 10.0, 0.0], 3.0, [0, 1], [mu[f] for f in FEATURES])
    assert n == [0.02, -1e-5, 0.0, 0.0]
    return spark.createDataFrame([(round(b, 6),)], "b_eff double")


@query(CHAIN + ", c AS (SELECT hs.plane_id, m.y, hs.side, m.precision, m.lift AS priority FROM guard m JOIN hs ON hs.hs_id = m.hs_id) SELECT plane_id, y, CAST(side AS INTEGER) AS side, round(priority, 6) AS priority, false AS is_clone FROM c UNION ALL SELECT plane_id, y, CAST(-side AS INTEGER), round(priority - 1e-6, 6), true FROM c WHERE precision >= 0.999")
def r03_perfect_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, _, rows = scored(spark, sf_dir)
    c = p.guardrails(rows).join(p.half_space_table(spark, hs).select("hs_id", "plane_id", "side"), "hs_id").select("plane_id", "y", "side", "precision", F.col("lift").alias("priority"))
    return p.with_perfect_clones(c).select("plane_id", "y", "side", *r6("priority"), "is_clone")


@query(CHAIN + "SELECT hs_id, y, round(CASE WHEN hs_id % 3 = 0 THEN 0.5 ELSE precision END, 6) AS precision, round(recall, 6) AS recall FROM met")
def k09_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)[2]
    null = F.lit(None).cast("double")
    lacking = rows.select("hs_id", "y", F.when(F.col("hs_id") % 3 == 0, 0.5).alias("precision"), null.alias("recall"), null.alias("f1"), null.alias("lift"))
    return p.enriched(lacking, rows).select("hs_id", "y", *r6("precision", "recall"))


@query(CHAIN + ", o AS (SELECT plane_id || CASE WHEN side > 0 THEN ':≤' ELSE ':≥' END AS oriented_id, hs_id FROM hs) SELECT oriented_id FROM o WHERE hs_id < 6 UNION ALL SELECT * FROM (SELECT oriented_id FROM o WHERE hs_id >= 6 ORDER BY oriented_id LIMIT 9)")
def k10_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = p.half_space_table(spark, bank(spark, sf_dir)[1])
    return p.augmented(t.filter("hs_id < 6"), t, 15).select("oriented_id")
