"""Queries over mined rules. The bank has 40 half-spaces, so a rule's mask is one long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import planes as p
from ..operators import rules as r
from ..storage import stored
from .catalog import query
from .inputs import r6
from .plane_queries import CHAIN, scored

_X = "CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END"
_RULES = f""", cand AS (SELECT m.y AS target, m.hs_id AS k, hs.feature, hs.side, hs.threshold, m.precision AS pr0, m.lift AS li0 FROM guard m JOIN hs ON hs.hs_id = m.hs_id
  QUALIFY row_number() OVER (PARTITION BY m.y, hs.feature ORDER BY round(m.precision, 9) DESC, round(m.lift, 9) DESC, m.hs_id) <= 4),
combo AS (SELECT target, [k] AS ks FROM cand UNION ALL SELECT a.target, [a.k, b.k] FROM cand a JOIN cand b ON a.target = b.target AND a.k < b.k AND NOT (a.feature = b.feature AND a.side = b.side)),
s1 AS (SELECT row_number() OVER () AS rid, * FROM s),
hit AS (SELECT hs_id AS k, rid, y FROM hs JOIN s1 ON CASE WHEN side > 0 THEN {_X} - threshold <= 0 ELSE {_X} - threshold >= 0 END WHERE hs_id IN (SELECT k FROM cand)),
hits AS (SELECT c.target, c.ks, a.rid, a.y FROM combo c JOIN hit a ON a.k = c.ks[1] WHERE len(c.ks) = 1 UNION ALL SELECT c.target, c.ks, a.rid, a.y FROM combo c JOIN hit a ON a.k = c.ks[1] JOIN hit b ON b.k = c.ks[2] AND b.rid = a.rid WHERE len(c.ks) = 2),
ev0 AS (SELECT target, ks, count(*) AS size, count(*) FILTER (WHERE y = target) AS tp FROM hits GROUP BY target, ks),
ev1 AS (SELECT e.*, c.pos AS positives, (SELECT count(*) FROM s) AS n, tp / size::DOUBLE AS precision, tp / c.pos::DOUBLE AS recall, c.pos / (SELECT count(*) FROM s)::DOUBLE AS baseline FROM ev0 e JOIN classes c ON c.y = e.target),
ev AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1, precision / baseline AS lift_precision, list_sort(list_distinct([k // {10} for k in ks])) AS dims, len(ks) AS num_planes,
  len(list_distinct([k // {10} for k in ks])) AS num_dims, len(list_distinct([k // {10} for k in ks])) + 0.5 * len(ks) AS cost, array_to_string([lpad(CAST(k AS VARCHAR), 3, '0') for k in ks], ',') AS rule_key FROM ev1),
pool AS (SELECT * FROM ev WHERE size >= 8 AND lift_precision >= 1),
acc AS (SELECT * FROM pool WHERE f1 >= greatest(baseline * 1.01, baseline + 0.05) OR precision >= greatest(baseline * 1.05, baseline + 0.05)),
sig AS (SELECT target, ks, md5(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid)) AS signature FROM hits GROUP BY target, ks),
ded AS (SELECT a.*, signature FROM acc a JOIN sig USING (target, ks) QUALIFY row_number() OVER (PARTITION BY target, signature ORDER BY cost, round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, rule_key) = 1)
"""
RCHAIN = CHAIN + _RULES

#: The same search with up to three predicates, over rows counted by the bits of all 40 predicates.
_BITS = " + ".join(f"(CASE WHEN x{k // 10} {'<=' if k % 2 == 0 else '>='} (SELECT threshold FROM hs WHERE hs_id = {k}) THEN {1 << k} ELSE 0 END)" for k in range(40))
_WIDE = f""", cand AS (SELECT m.y AS target, m.hs_id AS k, hs.feature, hs.side, m.precision AS pr0, m.lift AS li0 FROM guard m JOIN hs ON hs.hs_id = m.hs_id
  QUALIFY row_number() OVER (PARTITION BY m.y, hs.feature ORDER BY round(m.precision, 9) DESC, round(m.lift, 9) DESC, m.hs_id) <= 4),
mc AS (SELECT m, y, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT CAST({_BITS} AS BIGINT) AS m, y FROM s) GROUP BY m, y),
tot AS (SELECT y, sum(cnt) AS positives, sum(sum(cnt)) OVER () AS n FROM mc GROUP BY y),
"""
_THREE = _WIDE + """c2 AS (SELECT a.target, [a.k, b.k] AS ks, [a.feature || ':' || a.side, b.feature || ':' || b.side] AS used FROM cand a JOIN cand b ON a.target = b.target AND a.k < b.k AND NOT (a.feature = b.feature AND a.side = b.side)),
combo AS (SELECT target, [k] AS ks FROM cand UNION ALL SELECT target, ks FROM c2 UNION ALL SELECT c2.target, list_append(ks, c.k) FROM c2 JOIN cand c ON c.target = c2.target AND c.k > ks[2] AND NOT list_contains(used, c.feature || ':' || c.side)),
rl AS (SELECT target, ks, CAST(list_sum(list_transform(ks, lambda k: 1::BIGINT << k)) AS BIGINT) AS mask FROM combo),
ev0 AS (SELECT target, ks, mask, sum(cnt) AS size, sum(CASE WHEN mc.y = target THEN cnt ELSE 0 END) AS tp FROM rl JOIN mc ON (mc.m & mask) = mask GROUP BY target, ks, mask),
ev1 AS (SELECT e.*, positives, n, tp / size::DOUBLE AS precision, tp / positives::DOUBLE AS recall, positives / n::DOUBLE AS baseline FROM ev0 e JOIN tot ON tot.y = e.target),
ev AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1, precision / baseline AS lift_precision, list_sort(list_distinct([k // 10 for k in ks])) AS dims, len(ks) AS num_planes,
  len(list_distinct([k // 10 for k in ks])) AS num_dims, len(list_distinct([k // 10 for k in ks])) + 0.5 * len(ks) AS cost, array_to_string([lpad(CAST(k AS VARCHAR), 3, '0') for k in ks], ',') AS rule_key FROM ev1),
pool AS (SELECT * FROM ev WHERE size >= 8 AND lift_precision >= 1),
acc AS (SELECT *, false AS is_floor FROM pool WHERE f1 >= greatest(baseline * 1.01, baseline + 0.05) OR precision >= greatest(baseline * 1.05, baseline + 0.05)),
fl AS (SELECT *, true AS is_floor FROM pool p WHERE NOT EXISTS (SELECT 1 FROM acc h WHERE h.target = p.target AND h.num_dims = p.num_dims) QUALIFY row_number() OVER (PARTITION BY target, num_dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key) <= 3),
kept AS (SELECT * FROM acc UNION ALL SELECT * FROM fl),
sig AS (SELECT target, ks, md5(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m)) AS signature FROM (SELECT DISTINCT target, ks, m FROM kept JOIN mc ON (mc.m & mask) = mask) GROUP BY target, ks),
ded AS (SELECT a.* FROM kept a JOIN sig USING (target, ks) QUALIFY row_number() OVER (PARTITION BY target, signature ORDER BY cost, round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, rule_key) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY target, dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key) AS rk FROM ded),
pr AS (SELECT a.target, a.dims, a.rule_key AS key_a, b.rule_key AS key_b, a.mask AS ma, b.mask AS mb, a.num_planes + b.num_planes AS num_planes, a.num_dims, greatest(a.f1, b.f1) AS bf, greatest(a.recall, b.recall) AS br, a.baseline, a.positives, a.n FROM best a JOIN best b ON a.target = b.target AND a.dims = b.dims AND a.rk < b.rk AND b.rk <= 10),
un AS (SELECT pr.target, pr.key_a, pr.key_b, sum(cnt) AS size, sum(CASE WHEN (m & ma) = ma AND (m & mb) = mb THEN cnt ELSE 0 END) AS n_both, sum(CASE WHEN mc.y = target THEN cnt ELSE 0 END) AS tp FROM pr JOIN mc ON (m & ma) = ma OR (m & mb) = mb GROUP BY 1, 2, 3),
um AS (SELECT pr.*, size, n_both, tp, tp / size::DOUBLE AS precision, tp / positives::DOUBLE AS recall, 2 * (tp / size::DOUBLE) * (tp / positives::DOUBLE) / (tp / size::DOUBLE + tp / positives::DOUBLE + 1e-12) AS f1 FROM un JOIN pr USING (target, key_a, key_b)),
alls AS (SELECT target, 'and' AS kind, rule_key, dims, num_dims, num_planes, cost, is_floor, size, tp, precision, recall, f1, baseline, lift_precision, mask, NULL::BIGINT AS mask_b FROM ded
  UNION ALL SELECT target, 'or', key_a || ' | ' || key_b, dims, num_dims, num_planes, num_dims + 0.5 * num_planes, false, size, tp, precision, recall, f1, baseline, precision / baseline, ma, mb FROM um
  WHERE n_both / size::DOUBLE <= 0.25 AND size >= 8 AND (f1 >= bf + 0.01 OR (recall >= br + 0.03 AND precision >= baseline)) AND precision / baseline >= 1),
fin AS (SELECT * FROM alls QUALIFY row_number() OVER (PARTITION BY num_dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key, target) <= 50),
pz AS (SELECT target, dims, rule_key, cost, round(f1, 9) AS f, round(precision, 9) AS p, round(recall, 9) AS q FROM fin),
par AS (SELECT a.target, a.rule_key, NOT EXISTS (SELECT 1 FROM pz b WHERE b.target = a.target AND b.dims = a.dims AND b.cost <= a.cost AND b.f >= a.f AND b.p >= a.p AND b.q >= a.q AND (b.cost < a.cost OR b.f > a.f OR b.p > a.p OR b.q > a.q)) AS is_pareto FROM pz a),
dh AS (SELECT DISTINCT target, rule_key, m FROM fin JOIN (SELECT DISTINCT m FROM mc) ON (m & mask) = mask OR coalesce((m & mask_b) = mask_b, false)),
dn AS (SELECT target, rule_key, count(*) AS n FROM dh GROUP BY 1, 2),
sh AS (SELECT a.target, a.rule_key AS general, b.rule_key AS special, count(*) AS c FROM dh a JOIN dh b ON a.target = b.target AND a.m = b.m AND a.rule_key <> b.rule_key GROUP BY 1, 2, 3),
pa AS (SELECT sh.target, general, special, row_number() OVER (PARTITION BY sh.target, special ORDER BY f.cost, general) AS rk, f.f1, f.precision, f.recall FROM sh JOIN dn g ON g.target = sh.target AND g.rule_key = general JOIN dn p ON p.target = sh.target AND p.rule_key = special JOIN fin f ON f.target = sh.target AND f.rule_key = general WHERE sh.c = p.n AND g.n > p.n)
"""
WCHAIN = CHAIN + _THREE


def prepared(spark: SparkSession, sf_dir: str):
    hs, cells, rows = scored(spark, sf_dir)
    spaces = p.half_space_table(spark, hs).select("hs_id", "feature", "side")
    cand = stored(r.candidates(p.guardrails(rows).join(spaces, "hs_id")), "candidates")
    return cand, cells, spaces.select(F.col("hs_id").alias("k"), "feature")


def pool_of(spark: SparkSession, sf_dir: str, most: int = 2):
    cand, cells, features = prepared(spark, sf_dir)
    return stored(r.described(r.supported(r.evaluate(r.conjunctions(cand, most), cells)), features), "pool"), cells


def accepted_of(spark: SparkSession, sf_dir: str):
    pool, cells = pool_of(spark, sf_dir)
    return stored(r.accepted(pool), "accepted"), cells


@query(CHAIN + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT m) AS BIGINT) AS masks FROM (SELECT " + " + ".join(f"(CASE WHEN x{k // 10} {'<=' if k % 2 == 0 else '>='} (SELECT threshold FROM hs WHERE hs_id = {k}) THEN {1 << k} ELSE 0 END)" for k in range(40)) + " AS m FROM s)")
def r01_row_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scored(spark, sf_dir)[1]
    return cells.agg(F.sum("cnt").alias("rows"), F.count_distinct("m0").alias("masks"))


@query(CHAIN + f""", a AS (SELECT {_X} >= threshold AS i, rid FROM (SELECT row_number() OVER () AS rid, * FROM s), hs WHERE hs_id = 3), b AS (SELECT {_X} >= threshold AS i, rid FROM (SELECT row_number() OVER () AS rid, * FROM s), hs WHERE hs_id = 17)
SELECT count(*) FILTER (WHERE a.i AND b.i) AS both, count(*) FILTER (WHERE a.i OR b.i) AS either, round(count(*) FILTER (WHERE a.i AND b.i) / count(*) FILTER (WHERE a.i OR b.i)::DOUBLE, 6) AS iou FROM a JOIN b USING (rid)""")
def r02_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cells import holds

    cells = scored(spark, sf_dir)[1]
    a, b = holds(3), holds(17)
    return cells.agg(F.sum(F.when(a & b, F.col("cnt")).otherwise(0)).alias("both"), F.sum(F.when(a | b, F.col("cnt")).otherwise(0)).alias("either")).withColumn("iou", F.round(F.col("both") / F.greatest("either", F.lit(1)), 6))


@query(RCHAIN + "SELECT target, k, feature, side FROM cand")
def r04_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir)[0].select(F.col("y").alias("target"), F.col("hs_id").alias("k"), "feature", "side")


@query("WITH f AS (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT CAST(d AS VARCHAR) AS dims FROM f UNION ALL SELECT a.d || ',' || b.d FROM f a JOIN f b ON a.d < b.d UNION ALL SELECT a.d || ',' || b.d || ',' || c.d FROM f a JOIN f b ON a.d < b.d JOIN f c ON b.d < c.d")
def r05_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.range(4).select(F.col("id").cast("int").alias("d"))
    level = f.select(F.array("d").alias("ds"))
    out = level
    for _ in range(2):
        level = level.join(f, F.col("d") > F.element_at("ds", -1)).select(F.concat("ds", F.array("d")).alias("ds"))
        out = out.unionByName(level)
    return out.select(F.concat_ws(",", F.col("ds").cast("array<string>")).alias("dims"))


@query(WCHAIN + "SELECT target, rule_key, CAST(size AS BIGINT) AS size, CAST(tp AS BIGINT) AS tp, round(f1, 6) AS f1, round(lift_precision, 6) AS lift_precision FROM pool")
def r07_conjunction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_of(spark, sf_dir, 3)[0].select("target", "rule_key", "size", "tp", *r6("f1", "lift_precision"))


@query(RCHAIN + "SELECT target, rule_key FROM acc")
def r08_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_of(spark, sf_dir)[0].select("target", "rule_key")


@query(RCHAIN + "SELECT a.target, a.rule_key, h.y, count(*) AS pos, round(count(*) / a.size::DOUBLE, 6) AS precision FROM acc a JOIN hits h ON h.target = a.target AND h.ks = a.ks GROUP BY a.target, a.rule_key, a.size, h.y")
def r09_multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    hit = rules.select("target", "rule_key", "mask", "size").join(cells, r.holds(F.col("mask"), F.col("m0")))
    return hit.groupBy("target", "rule_key", "size", "y").agg(F.sum("cnt").alias("pos")).select("target", "rule_key", "y", "pos", F.round(F.col("pos") / F.col("size"), 6).alias("precision"))


@query(RCHAIN + """, strict AS (SELECT * FROM pool WHERE precision >= 0.8), have AS (SELECT DISTINCT target, num_dims FROM strict),
fl AS (SELECT * FROM pool p WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.target = p.target AND h.num_dims = p.num_dims) QUALIFY row_number() OVER (PARTITION BY target, num_dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key) <= 3)
SELECT target, rule_key, false AS is_floor FROM strict UNION ALL SELECT target, rule_key, true FROM fl""")
def r10_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, _ = pool_of(spark, sf_dir)
    return r.with_floor(pool, pool.filter("precision >= 0.8")).select("target", "rule_key", "is_floor")


@query(RCHAIN + """, best AS (SELECT *, row_number() OVER (PARTITION BY target, dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key) AS rk FROM ded),
pr AS (SELECT a.target, a.rule_key AS key_a, b.rule_key AS key_b, a.ks AS ka, b.ks AS kb, greatest(a.f1, b.f1) AS bf, greatest(a.recall, b.recall) AS br, a.baseline, a.positives FROM best a JOIN best b ON a.target = b.target AND a.dims = b.dims AND a.rk < b.rk AND b.rk <= 10),
un AS (SELECT target, key_a, key_b, rid, y, count(*) AS c FROM (SELECT pr.target, key_a, key_b, h.rid, h.y FROM pr JOIN hits h ON h.target = pr.target AND h.ks = pr.ka UNION ALL SELECT pr.target, key_a, key_b, h.rid, h.y FROM pr JOIN hits h ON h.target = pr.target AND h.ks = pr.kb) GROUP BY 1, 2, 3, 4, 5),
ua AS (SELECT target, key_a, key_b, count(*) AS size, count(*) FILTER (WHERE c = 2) AS n_both, count(*) FILTER (WHERE y = target) AS tp FROM un GROUP BY 1, 2, 3),
um AS (SELECT ua.*, bf, br, baseline, tp / size::DOUBLE AS precision, tp / positives::DOUBLE AS recall, 2 * (tp / size::DOUBLE) * (tp / positives::DOUBLE) / (tp / size::DOUBLE + tp / positives::DOUBLE + 1e-12) AS f1 FROM ua JOIN pr USING (target, key_a, key_b))
SELECT target, key_a, key_b, size, tp, round(n_both / size::DOUBLE, 6) AS iou FROM um WHERE n_both / size::DOUBLE <= 0.25 AND size >= 8 AND (f1 >= bf + 0.01 OR (recall >= br + 0.03 AND precision >= baseline)) AND precision / baseline >= 1""")
def r11_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    return r.unions(stored(r.deduplicated(rules, cells), "rules"), cells).select("target", "key_a", "key_b", "size", "tp", *r6("iou"))


@query(RCHAIN + "SELECT target, rule_key FROM ded")
def r12_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    return r.deduplicated(rules, cells).select("target", "rule_key")


@query(RCHAIN + "SELECT num_dims, target, rule_key FROM ded QUALIFY row_number() OVER (PARTITION BY num_dims ORDER BY round(f1, 9) DESC, round(lift_precision, 9) DESC, size DESC, cost, rule_key, target) <= 15")
def r13_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    return r.truncated(r.deduplicated(rules, cells), 15).select("num_dims", "target", "rule_key")


_PARETO = """, pz AS (SELECT target, dims, rule_key, cost, round(f1, 9) AS f, round(precision, 9) AS p, round(recall, 9) AS q FROM ded),
par AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM pz b WHERE b.target = a.target AND b.dims = a.dims AND b.cost <= a.cost AND b.f >= a.f AND b.p >= a.p AND b.q >= a.q AND (b.cost < a.cost OR b.f > a.f OR b.p > a.p OR b.q > a.q)) AS is_pareto FROM pz a)
"""


@query(RCHAIN + _PARETO + "SELECT target, rule_key, is_pareto FROM par")
def r14_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    return r.pareto(stored(r.deduplicated(rules, cells), "rules")).select("target", "rule_key", "is_pareto")


_INCL = """, dh AS (SELECT d.target, d.rule_key, h.rid FROM ded d JOIN hits h ON h.target = d.target AND h.ks = d.ks),
dn AS (SELECT target, rule_key, count(*) AS n FROM dh GROUP BY 1, 2),
sh AS (SELECT a.target, a.rule_key AS general, b.rule_key AS special, count(*) AS c FROM dh a JOIN dh b ON a.target = b.target AND a.rid = b.rid AND a.rule_key <> b.rule_key GROUP BY 1, 2, 3),
incl AS (SELECT sh.target, general, special FROM sh JOIN dn g ON g.target = sh.target AND g.rule_key = general JOIN dn p ON p.target = sh.target AND p.rule_key = special WHERE sh.c = p.n AND g.n > p.n)
"""


@query(RCHAIN + _INCL + "SELECT target, general, special FROM incl")
def r15_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    return r.inclusion(stored(r.deduplicated(rules, cells), "rules"), cells)


@query(RCHAIN + _INCL + """, pa AS (SELECT i.target, i.special, i.general, g.f1, g.precision, g.recall, row_number() OVER (PARTITION BY i.target, i.special ORDER BY g.cost, i.general) AS rk FROM incl i JOIN ded g ON g.target = i.target AND g.rule_key = i.general)
SELECT d.target, d.rule_key, pa.general AS parent, round(d.f1 - pa.f1, 6) AS d_f1, round(d.precision - pa.precision, 6) AS d_precision, round(d.recall - pa.recall, 6) AS d_recall FROM ded d LEFT JOIN pa ON pa.target = d.target AND pa.special = d.rule_key AND pa.rk = 1""")
def r16_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    rules = stored(r.deduplicated(rules, cells), "rules")
    return r.parents(rules, r.inclusion(rules, cells)).select("target", "rule_key", "parent", *r6("d_f1", "d_precision", "d_recall"))


@query(RCHAIN + _PARETO + "SELECT d.target, d.rule_key, row_number() OVER (PARTITION BY d.num_dims ORDER BY par.is_pareto DESC, round(d.f1, 9) DESC, round(d.lift_precision, 9) DESC, d.size DESC, d.cost, d.rule_key, d.target) AS place FROM ded d JOIN par ON par.target = d.target AND par.rule_key = d.rule_key")
def r17_final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cells = accepted_of(spark, sf_dir)
    w = Window.partitionBy("num_dims").orderBy(F.col("is_pareto").desc(), *r.order_key(), "target")
    return r.pareto(stored(r.deduplicated(rules, cells), "rules")).select("target", "rule_key", F.row_number().over(w).alias("place"))


@query(RCHAIN + """, ez AS (SELECT a.target, a.rule_key, hs.feature, max(CASE WHEN hs.side < 0 THEN threshold END) AS low, min(CASE WHEN hs.side > 0 THEN threshold END) AS up FROM acc a, unnest(a.ks) u(k) JOIN hs ON hs.hs_id = u.k
  WHERE (SELECT sum(c) FROM inside i WHERE i.hs_id = u.k) < (SELECT count(*) FROM s) GROUP BY 1, 2, 3)
SELECT target, rule_key, string_agg(CASE WHEN low IS NULL THEN 'x' || feature || ' ≤ ' || printf('%.4f', up) WHEN up IS NULL THEN 'x' || feature || ' ≥ ' || printf('%.4f', low) ELSE printf('%.4f', low) || ' ≤ x' || feature || ' ≤ ' || printf('%.4f', up) END, '  AND  ' ORDER BY feature) AS rule_text FROM ez GROUP BY target, rule_key""")
def r18_rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plane_queries import bank

    rules, cells = accepted_of(spark, sf_dir)
    spaces = p.half_space_table(spark, bank(spark, sf_dir)[1]).select(F.col("hs_id").alias("k"), "feature", "side", "threshold")
    return r.rule_text(rules, spaces, cells, digits=4)


@query(WCHAIN + """SELECT f.num_dims, f.target, f.kind, f.rule_key, CAST(f.size AS BIGINT) AS size, CAST(f.tp AS BIGINT) AS tp, f.is_floor, par.is_pareto, round(f.f1, 6) AS f1, pa.general AS parent, round(f.f1 - pa.f1, 6) AS d_f1,
  row_number() OVER (PARTITION BY f.num_dims ORDER BY par.is_pareto DESC, round(f.f1, 9) DESC, round(f.lift_precision, 9) DESC, f.size DESC, f.cost, f.rule_key, f.target) AS place
  FROM fin f JOIN par ON par.target = f.target AND par.rule_key = f.rule_key LEFT JOIN pa ON pa.target = f.target AND pa.special = f.rule_key AND pa.rk = 1""")
def r20_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .inputs import FEATURES
    from .plane_queries import bank

    s, hs = bank(spark, sf_dir)
    rules = r.search(s, hs, FEATURES)
    return rules.select("num_dims", "target", "kind", "rule_key", "size", "tp", "is_floor", "is_pareto", *r6("f1"), "parent", *r6("d_f1"), "place")


_MEASURE = "tp / size::DOUBLE AS precision, tp / positives::DOUBLE AS recall, CASE WHEN tp > 0 THEN 2 * (tp / size::DOUBLE) * (tp / positives::DOUBLE) / (tp / size::DOUBLE + tp / positives::DOUBLE) ELSE 0 END AS f1, size / n::DOUBLE AS frac, (tp / size::DOUBLE) / (positives / n::DOUBLE) AS lift, size / n::DOUBLE * (tp / size::DOUBLE - positives / n::DOUBLE) AS wracc"


def _rank(metric: str) -> str:
    return f"round({metric}, 9) DESC, round(wracc, 9) DESC, round(frac, 9) DESC, round(lift, 9) DESC, places"


def beam_sql(depth: int, metric: str = "precision", tag: str = "") -> str:
    """Common tables l1<tag>.. and beam<tag>: the search level by level, over rows counted by predicate bits."""

    def level(d: int) -> str:
        wider = "SELECT target, [pos] AS places, [k] AS ks, 1::BIGINT << k AS mask FROM bp" if d == 1 else f"SELECT l.target, list_append(l.places, b.pos) AS places, list_append(l.ks, b.k) AS ks, l.mask | (1::BIGINT << b.k) AS mask FROM l{d - 1}{tag} l JOIN bp b ON b.target = l.target AND b.pos > l.places[-1]"
        seed = "WHERE anyl = 0 OR round(lift, 9) > 1" if d == 1 else ""
        return f"""w{d}{tag} AS ({wider}),
e{d}{tag} AS (SELECT target, places, ks, mask, CAST(sum(cnt) AS BIGINT) AS size, CAST(sum(CASE WHEN mc.y = target THEN cnt ELSE 0 END) AS BIGINT) AS tp FROM w{d}{tag} JOIN mc ON (m & mask) = mask GROUP BY 1, 2, 3, 4 HAVING sum(cnt) >= 5),
m{d}{tag} AS (SELECT e.*, {_MEASURE}, positives, n FROM e{d}{tag} e JOIN tot ON tot.y = e.target),
l{d}{tag} AS (SELECT * FROM (SELECT *, max(CASE WHEN round(lift, 9) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS anyl FROM m{d}{tag}) {seed} QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_rank(metric)}) <= 16)"""

    union = " UNION ALL ".join(f"SELECT {d} AS depth, target, places, ks, mask, size, tp, precision, recall, f1, frac, lift, wracc FROM l{d}{tag}" for d in range(1, depth + 1))
    return ",\n".join(level(d) for d in range(1, depth + 1)) + f",\nbeam{tag} AS ({union})\n"


DEPTH = 7
_BP = _WIDE + "bp AS (SELECT target, k, row_number() OVER (PARTITION BY target ORDER BY round(pr0, 9) DESC, round(li0, 9) DESC, k) AS pos FROM cand),\n"
BCHAIN = CHAIN + _BP + beam_sql(DEPTH)


def ranked(cand: DataFrame) -> DataFrame:
    w = Window.partitionBy("y").orderBy(F.round("precision", 9).desc(), F.round("lift", 9).desc(), "hs_id")
    return cand.withColumn("pos", F.row_number().over(w))


def beam_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, cells, _ = prepared(spark, sf_dir)
    return r.beam(ranked(cand), cells, depth=DEPTH)


_KEY = "array_to_string(ks, ',')"


def keyed(c: str = "ks"):
    return F.concat_ws(",", F.col(c).cast("array<string>"))


@query(BCHAIN + "SELECT target, k, pos FROM bp")
def c06_plane_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(prepared(spark, sf_dir)[0]).select(F.col("y").alias("target"), F.col("hs_id").alias("k"), "pos")


@query(BCHAIN + f"SELECT depth, target, {_KEY} AS rule, size, tp, round(precision, 6) AS precision FROM beam")
def c07_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam_of(spark, sf_dir).select("depth", "target", keyed().alias("rule"), "size", "tp", *r6("precision"))


@query(BCHAIN + f"SELECT target, {_KEY} AS rule FROM beam a WHERE NOT EXISTS (SELECT 1 FROM beam b WHERE b.target = a.target AND round(b.precision, 9) >= round(a.precision, 9) AND round(b.recall, 9) >= round(a.recall, 9) AND b.size >= a.size AND (round(b.precision, 9) > round(a.precision, 9) OR round(b.recall, 9) > round(a.recall, 9) OR b.size > a.size))")
def c08_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.skyline(beam_of(spark, sf_dir)).select("target", keyed().alias("rule"))


@query(BCHAIN + f"""SELECT a.target, array_to_string(a.ks, ',') AS rule, (SELECT array_to_string(b.ks, ',') FROM beam b WHERE b.target = a.target AND len(b.ks) < len(a.ks) AND list_has_all(a.ks, b.ks) ORDER BY len(b.ks) DESC, b.places LIMIT 1) AS parent FROM beam a""")
def c10_plane_set_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.plane_set_parents(beam_of(spark, sf_dir)).select("target", keyed().alias("rule"), F.when(F.col("parent").isNotNull(), keyed("parent")).alias("parent"))


def _found(tag: str, metric: str, depth: int) -> str:
    """The final table of a beam: skyline flags, one rule for each region, 60 of a class, dimensions and floors."""
    return f""", sk{tag} AS (SELECT *, NOT EXISTS (SELECT 1 FROM beam{tag} b WHERE b.target = a.target AND round(b.precision, 9) >= round(a.precision, 9) AND round(b.recall, 9) >= round(a.recall, 9) AND b.size >= a.size AND (round(b.precision, 9) > round(a.precision, 9) OR round(b.recall, 9) > round(a.recall, 9) OR b.size > a.size)) AS is_skyline FROM beam{tag} a),
sg{tag} AS (SELECT target, ks, md5(string_agg(CAST(m AS VARCHAR), ',' ORDER BY m)) AS signature FROM (SELECT DISTINCT target, ks, m FROM sk{tag} JOIN mc ON (mc.m & mask) = mask) GROUP BY target, ks),
onr{tag} AS (SELECT k.* FROM sk{tag} k JOIN sg{tag} USING (target, ks) QUALIFY row_number() OVER (PARTITION BY target, signature ORDER BY {_rank(metric)}) = 1),
tp{tag} AS (SELECT * FROM onr{tag} QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_rank(metric)}) <= 60),
fd{tag} AS (SELECT *, CAST(len(list_distinct([k // 10 for k in ks])) AS INTEGER) AS num_dims, row_number() OVER (PARTITION BY target, len(list_distinct([k // 10 for k in ks])) ORDER BY {_rank(metric)}) <= 12 AS is_floor,
  (SELECT array_to_string(b.ks, ',') FROM tp{tag} b WHERE b.target = a.target AND len(b.ks) < len(a.ks) AND list_has_all(a.ks, b.ks) ORDER BY len(b.ks) DESC, b.places LIMIT 1) AS parent FROM tp{tag} a)
"""


@query(BCHAIN + _found("", "precision", DEPTH) + f"SELECT target, {_KEY} AS rule, depth, num_dims, is_floor, is_skyline, parent, round(precision, 6) AS precision FROM fd")
def c12_found_by_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, cells, features = prepared(spark, sf_dir)
    found = r.found_by_beam(cand, cells, features)
    return found.select("target", keyed().alias("rule"), "depth", "num_dims", "is_floor", "is_skyline", F.when(F.col("parent").isNotNull(), keyed("parent")).alias("parent"), *r6("precision"))


@query(CHAIN + _BP + beam_sql(3, "precision", "_p") + ", " + beam_sql(3, "f1", "_f") + _found("_p", "precision", 3) + _found("_f", "f1", 3) + f"SELECT target, {_KEY} AS rule, 'precision' AS found_by, num_dims FROM fd_p UNION ALL SELECT target, {_KEY}, 'f1', num_dims FROM fd_f f WHERE NOT EXISTS (SELECT 1 FROM fd_p p WHERE p.target = f.target AND p.ks = f.ks)")
def k11_beams_by_several_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, cells, features = prepared(spark, sf_dir)
    found = r.found_by_beams(cand, cells, features, ("precision", "f1"), depth=3)
    return found.select("target", keyed().alias("rule"), "found_by", "num_dims")


@query(CHAIN.replace("WITH ", "WITH RECURSIVE ", 1) + _BP + beam_sql(3) + f""", od AS (SELECT target, ks, len(ks) AS n, row_number() OVER (PARTITION BY target ORDER BY round(precision, 9) DESC, round(lift, 9) DESC, size DESC, ks) AS i FROM beam),
pick AS (SELECT target, 0::BIGINT AS i, 0::BIGINT AS used, NULL::INTEGER[] AS ks FROM (SELECT DISTINCT target FROM od) UNION ALL SELECT o.target, o.i, CASE WHEN used + n <= 7 THEN used + n ELSE used END, CASE WHEN used + n <= 7 THEN o.ks END FROM pick p JOIN od o ON o.target = p.target AND o.i = p.i + 1)
SELECT target, {_KEY} AS rule FROM pick WHERE ks IS NOT NULL""")
def c13_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, cells, _ = prepared(spark, sf_dir)
    rows = r.beam(ranked(cand), cells, depth=3).collect()  # a few rules for each class and depth
    chosen = [(t, ",".join(map(str, x["ks"]))) for t in sorted({q["target"] for q in rows}) for x in r.ruleset([q.asDict() for q in rows if q["target"] == t])]
    return spark.createDataFrame(chosen, "target int, rule string")


@query(CHAIN + ", a AS (SELECT y, hs_id, lift AS priority, 0 AS source FROM top WHERE rank <= 5 UNION ALL SELECT y, hs_id, precision, 1 FROM guard) SELECT y, plane_id || CASE WHEN side > 0 THEN ':≤' ELSE ':≥' END AS oriented_id, CAST(source AS INTEGER) AS source, round(priority, 6) AS priority FROM a JOIN hs USING (hs_id) QUALIFY row_number() OVER (PARTITION BY y, plane_id, side ORDER BY source, round(priority, 9) DESC, hs_id) = 1")
def c01_extracted_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, _, rows = scored(spark, sf_dir)
    guarded = p.guardrails(rows).cache()
    sources = [p.top_per_class(guarded, 5).withColumn("priority", F.col("lift")), guarded.withColumn("priority", F.col("precision"))]
    return p.extracted(sources, p.half_space_table(spark, hs)).select("y", "oriented_id", "source", *r6("priority"))


@query(CHAIN + "SELECT plane_id || CASE WHEN side > 0 THEN ':≤' ELSE ':≥' END AS oriented_id, CAST(side AS INTEGER) AS side, round(-threshold / (1 + 1e-12), 6) AS b_norm FROM hs WHERE hs_id % 5 <> 0 OR hs_id % 2 = 0")
def k12_completed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs, _, _ = scored(spark, sf_dir)
    t = p.normalized(p.half_space_table(spark, hs)).withColumnRenamed("u", "n_norm")
    lacking = t.select("oriented_id", F.when(F.col("hs_id") % 5 != 0, F.col("n_norm")).alias("n_norm"), F.when(F.col("hs_id") % 5 != 0, F.col("b_norm")).alias("b_norm"), F.lit(None).cast("int").alias("side"))
    return p.completed(lacking, t.filter("hs_id % 2 = 0 or hs_id % 5 <> 0")).select("oriented_id", "side", *r6("b_norm"))
