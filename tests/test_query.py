"""Query layer: views, cap rule, NaN, errors, result summary (Q1-Q8)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.functions.nulls import nan_to_null
from quarry.functions.sqltext import has_limit
from quarry.plans.query import QueryError, dataset_views, run_sql
from quarry.plans.registry import table_refs


@pytest.mark.parametrize("sql,expected", [
    ("SELECT * FROM t LIMIT 5", True),
    ("select * from t limit 5", True),
    ("SELECT credit_limit FROM t", False),
    ("SELECT 'LIMIT' AS w FROM t", False),
    ("SELECT x FROM t -- LIMIT 3\n", False),
    ("SELECT x FROM t /* LIMIT 3 */", False),
    ('SELECT "limit" FROM t', False),
    ("SELECT x FROM t LIMIT 10;", True),
])
def test_has_limit(sql, expected):
    assert has_limit(sql) is expected


def test_cap_applied_without_limit(spark):
    refs = table_refs(SF001, "orders")
    res = run_sql(spark, refs, "SELECT o_orderkey, 1 AS credit_limit FROM orders ORDER BY o_orderkey;",
                  cap=7)
    assert res.df.count() == 7
    res2 = run_sql(spark, refs, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3", cap=7)
    assert res2.df.count() == 3


def test_literal_limit_does_not_disable_cap(spark):
    res = run_sql(spark, table_refs(SF001, "orders"),
                  "SELECT o_orderkey, 'LIMIT' AS w FROM orders", cap=4)
    assert res.df.count() == 4


def test_query_error_is_wrapped(spark):
    with pytest.raises(QueryError, match="Query execution failed"):
        run_sql(spark, table_refs(SF001, "orders"), "SELECT nope FROM orders")


def test_view_name_clash_and_empty(spark):
    p = table_refs(SF001, "orders")["orders"]
    with pytest.raises(QueryError, match="already used"):
        dataset_views(spark, {"My Data": p, "my-data": p})
    with pytest.raises(QueryError, match="empty view name"):
        dataset_views(spark, {"@@": p})


def test_views_are_isolated_per_query(spark):
    refs = table_refs(SF001, "orders", "nation")
    a = run_sql(spark, {"t": refs["orders"]}, "SELECT count(*) AS n FROM t", cap=None)
    b = run_sql(spark, {"t": refs["nation"]}, "SELECT count(*) AS n FROM t", cap=None)
    assert a.df.first().n != b.df.first().n
    assert "t" not in [t.name for t in spark.catalog.listTables()]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    out = [r.x for r in nan_to_null(df).collect()]
    assert out[0] == 1.0 and out[1] is None and out[2] is None
    assert nan_to_null(df).where(F.col("x").isNull()).count() == 2


def test_result_summary_and_hints(spark):
    res = run_sql(spark, table_refs(SF001, "orders"),
                  "SELECT o_orderkey FROM orders WHERE o_orderkey < 0")
    out = res.collect()
    assert out["row_count"] == 0 and out["columns"] == ["o_orderkey"] and out["hints"]
    assert out["views"] == {"orders": "orders"}


def test_double_quotes_are_identifiers(spark):
    res = run_sql(spark, table_refs(SF001, "nation"),
                  'SELECT "n_name" AS "Nation" FROM nation ORDER BY "n_name" LIMIT 1')
    row = res.df.first()
    assert row["Nation"] != "n_name"


def test_float_nan_in_result(spark):
    res = run_sql(spark, table_refs(SF001, "nation"),
                  "SELECT CAST('NaN' AS DOUBLE) AS x FROM nation LIMIT 1")
    v = res.df.first().x
    assert v is None or not (isinstance(v, float) and math.isnan(v))


def test_all_pairs_guard(spark):
    from quarry.plans.query import QueryError, run_sql
    from quarry.plans.registry import table_refs
    refs = table_refs("/root/testdata/sf0.001", "customer", "orders")
    with pytest.raises(QueryError, match="all pairs"):
        run_sql(spark, refs, "SELECT count(*) FROM customer CROSS JOIN orders")
    with pytest.raises(QueryError, match="all pairs"):
        run_sql(spark, refs, "SELECT count(*) FROM customer c JOIN orders o "
                             "ON o.o_totalprice > c.c_acctbal")
    # opt-in, and sides with a proven bound (one-row aggregate, LIMIT) run
    n = run_sql(spark, refs, "SELECT count(*) AS n FROM customer CROSS JOIN orders",
                allow_all_pairs=True).df.first().n
    assert n == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count() * \
        spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    run_sql(spark, refs, "SELECT count(*) FROM customer c CROSS JOIN "
                         "(SELECT avg(o_totalprice) AS a FROM orders) s WHERE c.c_acctbal > s.a")
    run_sql(spark, refs, "SELECT count(*) FROM customer c JOIN (SELECT * FROM orders LIMIT 50) o "
                         "ON o.o_totalprice > c.c_acctbal")


def test_own_limit_is_honoured_in_full(spark, tmp_dir):
    spark.range(30_000).write.parquet(tmp_dir)
    res = run_sql(spark, {"t": tmp_dir}, "SELECT id FROM t LIMIT 12000").collect()
    assert res["row_count"] == 12000 and not res["truncated"]


def test_only_queries_run_and_failures_are_wrapped(spark, tmp_dir):
    spark.range(3).write.parquet(tmp_dir)
    for sql in ("DROP VIEW t", f"INSERT OVERWRITE DIRECTORY '{tmp_dir}-x' USING csv SELECT * FROM t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
                "SET a=b", "CREATE TEMP VIEW v AS SELECT 1"):
        with pytest.raises(QueryError):
            run_sql(spark, {"t": tmp_dir}, sql)
    with pytest.raises(QueryError):
        run_sql(spark, {"t": tmp_dir}, "SELECT id / 0 AS x FROM t").collect()
