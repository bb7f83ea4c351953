"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import connectors, detectors, pool, postings, registry  # noqa: F401  (they register their queries)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        path = f"{SMALL}/{name}"
        con.sql(f"create view {name[:-8]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = registry.queries()[name](spark, SMALL)
    want = db.sql(registry.oracle_sql()[name])
    rows = [tuple(r[want.columns.index(c)] for c in df.columns) for r in want.fetchall()]
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, rows))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_resolve_country_keeps_customers_of_many_nations(spark, tmp_path):
    spark.range(1500).selectExpr("id AS n_nationkey", "concat('NATION_', id % 25) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1500).selectExpr("id AS c_custkey", "id AS c_nationkey", "'X' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert registry.queries()["resolve_country"](spark, str(tmp_path)).count() == 1500


@pytest.mark.parametrize("far", [(1 << 20) + 6, 5_000_000_000])
def test_english_first_dedupe_with_keys_far_apart(spark, tmp_path, far):
    keys = [(1, "O", 5, "german"), (1, "F", far, "english"), (1, "F", far + 1, "late"), (2, "P", far, "last"), (2, "O", 7, "first")]
    spark.createDataFrame(keys, "o_custkey long, o_orderstatus string, o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in registry.queries()["english_first_dedupe"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == set(con.sql(registry.oracle_sql()["english_first_dedupe"]).fetchall()) == {("1", "english"), ("2", "first")}
