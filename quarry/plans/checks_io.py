"""Checked queries for sources (S1-S10) and sinks.

Round trips write under the cluster's shared folder (``spark.checkpoint.dir``)
in a fresh directory per call, then read the result back with Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import Catalog
from quarry.plans.query import EXPORT_CAP, run_sql
from quarry.plans.registry import check, table, table_path, table_refs
from quarry.session import scratch_path
from quarry.sinks.writers import (export_result, write_chunked, write_combined, write_csv,
                                  write_json, write_parquet)
from quarry.sources.files import CSV_SNAPSHOT_READ, scan_csv, scan_json, scan_parquet
from quarry.sources.records import unwrap_records
from quarry.sources.registry import preview_source, read_source
from quarry.sources.synthetic import synthetic_columns


@check("scan_parquet", oracle="""
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 25""")
def s_parquet(spark, sf_dir):
    # filter and projection reach the Parquet reader (PushedFilters / ReadSchema)
    return scan_parquet(spark, table_path(sf_dir, "lineitem"),
                        columns=["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"],
                        where=F.col("l_quantity") > 25)


@check("scan_csv", oracle="SELECT * FROM orders")
def s_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = scratch_path(spark, "csv")
    write_csv(orders, out)
    return scan_csv(spark, out, schema=orders.schema, **CSV_SNAPSHOT_READ)


@check("scan_json", oracle="SELECT * FROM orders")
def s_json(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = scratch_path(spark, "json")
    write_json(orders, out)
    return scan_json(spark, out, schema=orders.schema)


@check("unwrap_records", oracle="""
SELECT event_id, CAST(0 AS INTEGER) AS record_pos, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""")
def s_unwrap(spark, sf_dir):
    # every props document is an object without an envelope: one record each
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    records, _rejects = unwrap_records(ev, "props", keep=["event_id"])
    return records


@check("read_source", oracle="SELECT * FROM part")
def s_read_source(spark, sf_dir):
    return read_source(spark, {"type": "parquet", "path": table_path(sf_dir, "part")})


@check("read_dataset", oracle="SELECT * FROM supplier")
def s_read_dataset(spark, sf_dir):
    # runs: success (positive balances only), success (all), failed -> the
    # newest good one, which holds every supplier
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    src = {"type": "parquet", "path": table_path(sf_dir, "supplier")}
    did = cat.create_dataset("Suppliers", src, options={"profile": False})
    cat.ingest(did, source_df=table(spark, sf_dir, "supplier").where("s_acctbal > 0"))
    cat.ingest(did)
    bad = cat.create_dataset("broken", {"type": "parquet", "path": table_path(sf_dir, "nope")})
    cat.ingest(bad)
    cat.log_run(dataset_id=did, run_id="failed-run", run_seq=2 ** 62, status="failed",
                error="simulated failure")
    return read_source(spark, {"type": "pipeline", "pipeline_id": did, "catalog": cat.root})


@check("preview_source", oracle="SELECT * FROM customer ORDER BY c_custkey LIMIT 3")
def s_preview(spark, sf_dir):
    p = preview_source(spark, {"type": "parquet", "path": table_path(sf_dir, "customer")},
                       n=3, order_by=["c_custkey"])
    return p.sample


# One synthetic row per customer.  The values come from xxhash64, which
# DuckDB lacks, so the oracle checks the rules every value must satisfy
# (formats, ranges, pick lists) and the one deterministic text column.
_SYNTH_SPEC = {"uid": "uuid", "email": "email", "first": "first_name", "last": "last_name",
               "signup": "date", "amount": "currency", "vip": "boolean", "country": "country",
               "age": "integer:18:90", "code": "string:8", "other": "text"}


@check("synthetic_table", oracle="""
SELECT c_custkey AS id, 'value_' || CAST(c_custkey AS VARCHAR) AS other, true AS rules_hold
FROM customer""")
def s_synthetic(spark, sf_dir):
    from quarry.sources.synthetic import COUNTRIES, DAYS_BACK, FIRST_NAMES, LAST_NAMES
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    df = synthetic_columns(ids, _SYNTH_SPEC)
    today = F.current_date()
    rules = (F.col("uid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$")
             & F.col("email").rlike(r"^[a-z]+\.[a-z]+@example\.com$")
             & F.col("first").isin(FIRST_NAMES) & F.col("last").isin(LAST_NAMES)
             & F.col("signup").between(F.date_sub(today, DAYS_BACK), today)
             & F.col("amount").between(10.0, 10000.0)
             & (F.round(F.col("amount"), 2) == F.col("amount"))
             & F.col("vip").isNotNull() & F.col("country").isin(COUNTRIES)
             & F.col("age").between(18, 90) & F.col("code").rlike("^[A-Za-z]{8}$"))
    return df.select("id", "other", F.coalesce(rules, F.lit(False)).alias("rules_hold"))


@check("write_parquet", oracle="SELECT * FROM lineitem")
def k_parquet(spark, sf_dir):
    out = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "lineitem"), out)  # gzip by default
    return spark.read.parquet(out)


@check("write_csv", oracle="SELECT * FROM orders")
def k_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = scratch_path(spark, "csvgz")
    write_csv(orders, out, compression="gzip")
    return scan_csv(spark, out, schema=orders.schema, **CSV_SNAPSHOT_READ)


@check("write_json", oracle="SELECT * FROM customer")
def k_json(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    out = scratch_path(spark, "jsongz")
    write_json(cust, out, compression="gzip")
    return scan_json(spark, out, schema=cust.schema)


@check("write_chunked", oracle="SELECT * FROM lineitem")
def k_chunked(spark, sf_dir):
    # many files of at most 10,000 rows; the snapshot is the whole directory
    out = scratch_path(spark, "chunked")
    write_chunked(table(spark, sf_dir, "lineitem"), out, chunk_rows=10000)
    return spark.read.parquet(out)


@check("write_combined", oracle="SELECT * FROM supplier")
def k_combined(spark, sf_dir):
    out = scratch_path(spark, "combined")
    write_combined(table(spark, sf_dir, "supplier"), out)
    return spark.read.parquet(out)


@check("export_result", oracle=f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
ORDER BY o_orderkey LIMIT {EXPORT_CAP}""")
def k_export(spark, sf_dir):
    res = run_sql(spark, table_refs(sf_dir, "orders"),
                  "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders "
                  "ORDER BY o_orderkey", cap=EXPORT_CAP)
    out = scratch_path(spark, "export")
    export_result(res.df, out, "csv")
    return scan_csv(spark, out, schema=res.df.schema, **CSV_SNAPSHOT_READ)


@check("coerce_mixed_types", oracle="SELECT vec_id, embedding, label FROM embeddings")
def k_coerce(spark, sf_dir):
    # CSV cannot hold an array: the writer turns it into JSON text (K4);
    # reading the text back with the array type restores every vector
    from quarry.sources.files import scan_csv as _scan_csv
    emb = table(spark, sf_dir, "embeddings")
    out = scratch_path(spark, "csv-nested")
    write_csv(emb, out)
    text = _scan_csv(spark, out, schema="vec_id bigint, embedding string, label int", **CSV_SNAPSHOT_READ)
    return text.select("vec_id", F.from_json("embedding", "array<float>").alias("embedding"),
                       "label")


@check("drop_envelope_fields", oracle="""
SELECT event_id, CAST(0 AS INTEGER) AS record_pos, event_type, value FROM events""")
def s_drop_envelope(spark, sf_dir):
    # every event as an API-style payload: {"records": [{..., "attributes": {...}}]};
    # unwrapping finds the envelope, the bookkeeping field is dropped
    from quarry.sources.records import drop_envelope_fields
    ev = table(spark, sf_dir, "events")
    rec = F.struct(F.struct(F.lit("Event").alias("type"), F.col("user_id").alias("owner"))
                   .alias("attributes"), "event_type", "value")
    docs = ev.select("event_id", F.to_json(F.struct(F.array(rec).alias("records"))).alias("doc"))
    records, _rejects = unwrap_records(
        docs, "doc", schema="attributes struct<type: string, owner: bigint>, "
                            "event_type string, value double", keep=["event_id"])
    return drop_envelope_fields(records)
