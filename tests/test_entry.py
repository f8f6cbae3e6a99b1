"""Driver contract: entry smoke, registry shape, oracle keys."""

import re

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["c_mktsegment", "n_orders", "n_lines", "revenue"]


def test_registry_shape():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 100
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    no_oracle = {k for k in set(q) - set(o) if k != "pipeline" and not re.match(r"op\d+_", k)}  # those have tests of their own
    assert no_oracle == {"sql_sample"}  # a seeded sample: row count only


def test_some_checks_run_on_smallest_data(spark):
    q = entry.queries()
    for key in ("transform_asof", "join_suggestions", "run_rollup", "sql_range_join"):
        assert q[key](spark, "/root/testdata/sf0.001").count() >= 0
