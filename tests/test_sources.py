"""Sources: synthetic, CSV, JSON, envelopes, JDBC (opt-in), dispatch,
catalog import (S1-S10)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.sources.files import scan_csv, scan_json
from quarry.sources.jdbc import redact, scan_jdbc
from quarry.sources.records import drop_envelope_fields, unwrap_records
from quarry.sources.registry import preview_source, read_source, supported_types
from quarry.sources.synthetic import COUNTRIES, FIRST_NAMES, LAST_NAMES, synthetic_table


def _local(path):
    return path.replace("file:", "")


def test_supported_types_sorted():
    t = supported_types()
    assert t == sorted(t)
    for k in ("csv", "json", "parquet", "synthetic", "jdbc", "postgres", "mysql", "dataset"):
        assert k in t


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="Unsupported source type: unknown_type"):
        read_source(spark, {"type": "unknown_type"})


def test_synthetic_batch(spark):
    df = read_source(spark, {"type": "synthetic", "row_count": 50,
                             "schema": {"id": "uuid", "name": "first_name", "amount": "currency"}})
    assert df.count() == 50 and df.columns == ["id", "name", "amount"]


def test_synthetic_chunked_ids_distinct(spark):
    df = synthetic_table(spark, {"id": "uuid"}, 25, num_partitions=3)
    assert df.count() == 25 and df.select("id").distinct().count() == 25


def test_synthetic_ranges_membership_determinism(spark):
    schema = {"e": "email", "f": "first_name", "l": "last_name", "c": "country",
              "d": "date", "m": "currency", "b": "boolean", "i": "integer:5:7",
              "j": "integer", "s": "string:6", "u": "uuid", "x": "whatever"}
    a = synthetic_table(spark, schema, 400, seed=7, num_partitions=4)
    b = synthetic_table(spark, schema, 400, seed=7, num_partitions=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    rows = a.collect()
    assert {r.f for r in rows} <= set(FIRST_NAMES)
    assert {r.l for r in rows} <= set(LAST_NAMES)
    assert {r.c for r in rows} <= set(COUNTRIES)
    assert all(r.e.endswith("@example.com") and r.e == r.e.lower() for r in rows)
    assert all(10 <= r.m <= 10000 and round(r.m, 2) == r.m for r in rows)
    assert {r.i for r in rows} == {5, 6, 7}
    assert all(r.j.startswith("value_") for r in rows)  # no colon: falls to value_<i>
    assert all(len(r.s) == 6 and r.s.isalpha() for r in rows)
    assert all(len(r.u) == 36 for r in rows)
    assert sorted(r.x for r in rows)[:2] == ["value_0", "value_1"]
    span = a.agg(F.datediff(F.max("d"), F.min("d"))).first()[0]
    assert span <= 5 * 365
    c = synthetic_table(spark, schema, 400, seed=8)
    assert sorted(map(tuple, c.collect())) != sorted(map(tuple, rows))


def test_csv_text(spark, tmp_dir):
    os.makedirs(_local(tmp_dir))
    with open(os.path.join(_local(tmp_dir), "x.csv"), "w") as f:
        f.write("a,b\n1,2\n3,4\n")
    df = scan_csv(spark, tmp_dir)
    assert df.columns == ["a", "b"] and df.count() == 2
    assert dict(df.dtypes) == {"a": "int", "b": "int"}


def test_json_list_payload(spark, tmp_dir):
    os.makedirs(_local(tmp_dir))
    with open(os.path.join(_local(tmp_dir), "x.json"), "w") as f:
        f.write('[{"id":1},{"id":2}]')
    assert scan_json(spark, tmp_dir, array=True).count() == 2


def _docs(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc int, body string")


def test_envelopes(spark):
    docs = [
        '{"data":[{"id":1}]}',                              # one record
        '{"results":[{"id":2},{"id":3}]}',
        '{"items":[{"id":4}]}',
        '{"records":[{"id":5}]}',
        '{"items":[{"id":6}],"data":[{"id":7}]}',           # data wins (key order)
        '{"data":"not a list","records":[{"id":8}]}',       # non-list key skipped
        '{"id":9,"name":"bare"}',                           # bare object: one row
        '[{"id":10},{"id":11}]',                            # top-level list
        '42',                                               # scalar: rejected
        'not json',                                         # invalid: rejected
    ]
    recs, rej = unwrap_records(_docs(spark, docs), "body", schema="id bigint", keep=["doc"])
    got = sorted((r.doc, r.id) for r in recs.collect())
    assert got == [(0, 1), (1, 2), (1, 3), (2, 4), (3, 5), (4, 7), (5, 8), (6, 9), (7, 10), (7, 11)]
    assert sorted(r.doc for r in rej.collect()) == [8, 9]


def test_envelope_schema_inferred(spark):
    recs, _ = unwrap_records(_docs(spark, ['{"data":[{"a":1,"b":"x"}]}', '[{"a":2}]']), "body",
                             keep=["doc"])
    assert set(recs.columns) >= {"a", "b"}
    assert sorted(r.a for r in recs.collect()) == [1, 2]


def test_drop_envelope_fields(spark):
    df = spark.createDataFrame([(1, "meta", "x")], "id int, attributes string, v string")
    assert drop_envelope_fields(df).columns == ["id", "v"]
    s = spark.sql("SELECT named_struct('attributes', 1, 'Id', 2) AS r")
    assert drop_envelope_fields(s, struct_col="r").schema["r"].dataType.fieldNames() == ["Id"]


# The JDBC reader / writer needs a database.  Tests start none (no server,
# no embedded engine): set QUARRY_TEST_JDBC_URL (and QUARRY_TEST_JDBC_DRIVER
# when the URL alone does not name it) to run this against your own.
_JDBC_URL = os.environ.get("QUARRY_TEST_JDBC_URL")
_JDBC_DRIVER = os.environ.get("QUARRY_TEST_JDBC_DRIVER")


@pytest.mark.skipif(not _JDBC_URL, reason="no JDBC database given (QUARRY_TEST_JDBC_URL)")
def test_jdbc_roundtrip(spark):
    from quarry.sinks.writers import write_jdbc
    url, drv = _JDBC_URL, _JDBC_DRIVER
    nation = spark.read.parquet(f"{SF001}/nation.parquet")
    write_jdbc(nation, url, "QUARRY_NATION", mode="replace", driver=drv)
    assert scan_jdbc(spark, url, table="QUARRY_NATION", driver=drv).count() == 25
    write_jdbc(nation, url, "QUARRY_NATION", mode="append", driver=drv)
    assert scan_jdbc(spark, url, table="QUARRY_NATION", driver=drv).count() == 50
    with pytest.raises(Exception):
        write_jdbc(nation, url, "QUARRY_NATION", mode="fail", driver=drv)
    part = scan_jdbc(spark, url, table="QUARRY_NATION", driver=drv,
                     partition_column="n_nationkey", lower_bound=0, upper_bound=25,
                     num_partitions=4)
    assert part.rdd.getNumPartitions() == 4 and part.count() == 50
    write_jdbc(nation.where("n_regionkey = 1"), url, "QUARRY_NATION", mode="replace", driver=drv)
    assert scan_jdbc(spark, url, table="QUARRY_NATION", driver=drv).count() == 5


def test_jdbc_spec_builds_url_and_hides_secrets():
    from quarry.sources.jdbc import jdbc_url
    assert jdbc_url({"type": "postgres", "host": "h", "database": "d"}) == \
        "jdbc:postgresql://h:5432/d"
    assert jdbc_url({"type": "mysql", "host": "h", "database": "d", "port": 1}) == \
        "jdbc:mysql://h:1/d"
    r = redact({"type": "postgres", "password": "pw", "auth": {"token": "t", "user": "u"}})
    assert r["password"] == "***" and r["auth"] == {"token": "***", "user": "u"}


def test_redact():
    r = redact({"type": "postgres", "password": "s3cret", "auth": {"token": "t"}, "host": "h"})
    assert r["password"] == "***" and r["auth"]["token"] == "***" and r["host"] == "h"


def test_preview(spark):
    p = preview_source(spark, {"type": "parquet", "path": f"{SF001}/customer.parquet"},
                       order_by=["c_custkey"])
    assert p.columns[0] == "c_custkey" and p.row_count > 3
    assert [r.c_custkey for r in p.sample.collect()] == sorted(r.c_custkey for r in p.sample.collect())
    assert p.sample.count() == 3


def test_catalog_json_import(spark, tmp_dir):
    from quarry.catalog import load_catalog_json
    os.makedirs(_local(tmp_dir))
    doc = {"pipelines": [
        {"id": "p1", "name": "Sales", "runs": [{"run_id": "r1", "status": "success"},
                                               {"run_id": "r2", "status": "failed"}]},
        {"id": "p2", "name": "Empty", "runs": []}],
        "verified_columns": {"email": {"description": "Email address of the user",
                                       "business_meaning": "Primary contact",
                                       "verified_by": "admin"}}}
    with open(os.path.join(_local(tmp_dir), "catalog.json"), "w") as f:
        json.dump(doc, f)
    with open(os.path.join(_local(tmp_dir), "broken.json"), "w") as f:
        f.write("{not json")
    out = load_catalog_json(spark, tmp_dir)
    assert sorted(r.id for r in out["datasets"].collect()) == ["p1", "p2"]
    assert sorted((r.dataset_id, r.run_id) for r in out["runs"].collect()) == \
        [("p1", "r1"), ("p1", "r2")]
    k = out["knowledge"].collect()
    assert k[0].column_key == "email" and k[0].description == "Email address of the user"
    assert out["corrupt"].count() == 1
