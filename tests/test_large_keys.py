"""Queries over parts whose keys have more digits than their region ids, against their SQL."""

from collections import Counter

import duckdb
import pytest

from planiscope.plans import catalog


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Keys about 100 000 and 1 000 000: region ids keep six digits, so several parts share one."""
    top = tmp_path_factory.mktemp("large_keys")
    duckdb.sql(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, CAST(k * 7 % 50 + 1 AS INTEGER) AS p_size FROM (SELECT unnest(range(99990, 100020)) AS k UNION ALL SELECT unnest(range(999950, 1000200)))) TO '{top}/part.parquet'")
    return str(top)


def rows_and_sql(spark, name, top):
    df = catalog.QUERIES[name](spark, top)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{top}/part.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    return Counter(map(tuple, df.collect())), Counter(want)


@pytest.mark.parametrize("name", ["p01_rank_key", "p02_metrics_table"])
def test_region_ids_of_large_keys(spark, large_keys, name):
    got, want = rows_and_sql(spark, name, large_keys)
    assert got == want


def test_merged_rows_of_shared_region_ids_stay(spark, large_keys):
    got, want = rows_and_sql(spark, "p09_merged", large_keys)
    assert got == want and sum(got.values()) == 280
