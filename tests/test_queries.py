"""Every registered query against its SQL over the smallest tables, and the contract's shape."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SLOW = {"grouped_trees", "grouped_ridge"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, name):
    import verify

    df = registry.QUERIES[name](spark, SF)
    got = verify.rows_of(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = verify.connect(SF).execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == verify.rows_of(columns, rel.fetchall())


def compared(spark, folder, name):
    import verify

    df = registry.QUERIES[name](spark, str(folder))
    rel = verify.connect(str(folder)).execute(registry.ORACLE_SQL[name])
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of([d[0] for d in rel.description], rel.fetchall())


def test_kernel_support_at_almost_equal_weights(spark, tmp_path):
    """Pairs of rows as far to the left as to the right of a query: their weights differ in the last bit or not at all."""
    import duckdb

    duckdb.sql("SELECT i * 20 AS s_suppkey, CAST(i % 5 AS INT) AS s_nationkey, round(i * 37.01::DOUBLE, 2) AS s_acctbal FROM range(300) r(i)").write_parquet(str(tmp_path / "supplier.parquet"))
    duckdb.sql("SELECT i AS c_custkey, CAST(i % 3 AS INT) AS c_nationkey, round(i // 3 * 37.01::DOUBLE, 2) AS c_acctbal FROM range(901) r(i)").write_parquet(str(tmp_path / "customer.parquet"))
    compared(spark, tmp_path, "kernel_baseline")


def test_kernel_baseline_of_odd_rows(spark, tmp_path):
    """Missing numbers on both sides, a query told twice, and many rows of one weight."""
    import duckdb

    duckdb.sql("SELECT * REPLACE (s_acctbal::DOUBLE AS s_acctbal) FROM (VALUES (0, 1, 5.0), (20, NULL, 5.0), (40, 2, 7.5), (40, 2, 7.5), (60, 3, -900.0), (60, 4, 12.5), (NULL, 1, 1.0), (7, 1, 1.0)) t(s_suppkey, s_nationkey, s_acctbal)").write_parquet(str(tmp_path / "supplier.parquet"))
    duckdb.sql("SELECT CASE WHEN i % 50 > 0 THEN i END AS c_custkey, CASE WHEN i % 41 > 0 THEN 1 END AS c_nationkey, CASE WHEN i % 2 = 0 THEN 5.0::DOUBLE WHEN i % 31 > 0 THEN i * 1.5::DOUBLE END AS c_acctbal FROM range(9000) r(i)").write_parquet(str(tmp_path / "customer.parquet"))
    compared(spark, tmp_path, "kernel_baseline")


def test_residual_folds_of_odd_rows(spark, tmp_path):
    """Missing keys, sizes and prices, rows told twice, one key with two sizes, and a size of its own far off."""
    import duckdb

    rows = "SELECT CASE WHEN i % 37 > 0 THEN i END AS p_partkey, CASE WHEN i % 23 > 0 THEN CAST(i * 7 % 40 AS INT) END AS p_size, CASE WHEN i % 19 > 0 THEN 900.0::DOUBLE + i * 13 % 101 END AS p_retailprice FROM range(400) r(i)"
    duckdb.sql(f"{rows} UNION ALL ({rows} WHERE i % 8 = 3) UNION ALL SELECT 5, 18, 1000.5::DOUBLE UNION ALL SELECT 5, 19, 990.25::DOUBLE UNION ALL SELECT 1000, 150, 1.5::DOUBLE").write_parquet(str(tmp_path / "part.parquet"))
    compared(spark, tmp_path, "residual_folds")


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
