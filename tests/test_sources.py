import pytest
from pyspark.sql import functions as F

from planiscope.operators import planes
from planiscope.sources import generators, tables


def test_corner_classes(spark):
    rows = generators.corner_classes(spark, 200)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert counts == {0: 200, 1: 1200, 2: 200}
    m = rows.filter("y = 2").agg(*[F.avg(f"x{i}") for i in range(1, 5)]).first()
    assert all(abs(a - b) < 0.25 for a, b in zip(m, (-2.5, -1.5, -0.5, 1.0), strict=True))
    assert rows.repartition(3).exceptAll(rows).count() == 0


def test_high_dimensional_and_passengers(spark):
    rows = generators.high_dimensional(spark, 3000)
    assert len(rows.columns) == 27 and rows.select("y").distinct().count() == 3
    noise = rows.agg(F.avg("f25"), F.stddev("f25")).first()
    assert abs(noise[0]) < 0.1 and abs(noise[1] - 1) < 0.1
    p = generators.passengers(spark, 2000)
    rate = {r.sex: r.s for r in p.groupBy("sex").agg(F.avg("survived").alias("s")).collect()}
    assert rate["female"] > rate["male"] + 0.2


def test_planted_families_are_found(spark):
    pool = planes.normalized(generators.family_pool(spark, 6, 5)).withColumn("side", F.lit(1))
    edges = planes.family_edges(pool, None, tau=0.01)
    got = planes.families(pool.select("hs_id"), edges).join(pool.select("hs_id", "planted"), "hs_id").collect()
    assert all((a.family == b.family) == (a.planted == b.planted) for a in got for b in got)


def test_tables_and_sinks(spark, tmp_path):
    df = tables.from_matrix(spark, [[1, 2], [3, 4]], [0, 1])
    assert df.columns == ["row_id", "x0", "x1", "y"] and tables.shape(df) == (2, 4, 8)
    with pytest.raises(ValueError):
        tables.from_matrix(spark, [[1], [1, 2]])
    tables.write_csv(df, str(tmp_path / "a.csv"), ["y"])
    back = tables.read(spark, str(tmp_path / "a.csv"))
    assert back.columns[0] == "y" and back.count() == 2
    with pytest.raises(ValueError):
        tables.write_csv(df.filter("false"), str(tmp_path / "b.csv"))
    tables.stage_timings(spark, [{"stage": "a", "s": 1.5}, {"stage": "b", "n": 2}], str(tmp_path / "t.csv"))
    assert {r.s for r in spark.read.option("header", True).csv(str(tmp_path / "t.csv")).collect()} == {"1.500000", None}
    assert tables.taken(df, df.filter("y = 1"), "row_id").count() == 1
