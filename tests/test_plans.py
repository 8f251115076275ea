"""Every registered query outside the corpus operators against its SQL."""

import pytest
from conftest import DATA, same_rows

from barflow import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert same_rows(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, DATA).count()


def test_pbo_takes_all_bars(spark):
    """720 bars of each instrument, all in both."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.1/events.parquet')")
    assert same_rows(registry.queries()["a26_pbo"](spark, "/root/testdata/sf0.1"), con, registry.oracle_sql()["a26_pbo"])


def test_features_of_very_small_and_large_balances(spark, tmp_path):
    """JSON numbers have no exponents where the SQL writes none; nulls stay."""
    import duckdb

    from barflow.plans.scalars import P

    balances = [0.0, 0.003, -0.0001, -0.00001, 0.0069, 0.007, 1070.49, 6.9e7, 7e7, 123456789.123, 1e16, 7e21, None]
    rows = [(i, f"Customer#{i}", 1, x, "BUILDING") for i, x in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    name = "p6_p9_p12_p15_projections"
    got = sorted((r.c_custkey, r.safe_log, r.side, r.feature) for r in P.queries[name](spark, str(tmp_path)).collect())
    assert got == con.sql(f"SELECT c_custkey, safe_log, side, feature FROM ({P.sql[name]}) ORDER BY 1").fetchall()
    assert [r[3] for r in got[1:4]] == ['{"bal":0.00043}', '{"bal":-0.00001}', '{"bal":-0.0}']
