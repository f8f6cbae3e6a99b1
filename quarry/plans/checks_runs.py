"""Checked queries for the run log and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import Catalog, dataset_rollup, run_totals
from quarry.plans.registry import check, table, table_path
from quarry.session import scratch_path
from quarry.streaming.datasets import commit_batch
from quarry.streaming.ingest import read_ingested, stream_ingest


@check("ingest", oracle="SELECT * FROM orders")
def r_ingest(spark, sf_dir):
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Orders", {"type": "parquet", "path": table_path(sf_dir, "orders")},
                             options={"format": "parquet", "profile": False})
    res = cat.ingest(did)
    if res["status"] != "success":
        raise RuntimeError(res)
    return cat.read_snapshot(did)


def _through_catalog(name: str, fmt: str):
    """Ingest a whole table in a text format and read it back by its id."""
    def run(spark, sf_dir):
        cat = Catalog(spark, scratch_path(spark, "catalog"))
        did = cat.create_dataset(name, {"type": "parquet", "path": table_path(sf_dir, name)},
                                 options={"format": fmt, "profile": False})
        res = cat.ingest(did)
        if res["status"] != "success":
            raise RuntimeError(res)
        return cat.read_snapshot(did)
    return run


# texts with newlines, quotes and blanks, and dates and numbers, come back as they were
for _name, _table, _fmt in (("csv_text_round_trip", "documents", "csv"), ("csv_pages_round_trip", "pages", "csv"),
                            ("csv_types_round_trip", "orders", "csv"), ("json_text_round_trip", "documents", "json"),
                            ("json_pages_round_trip", "pages", "json"), ("json_types_round_trip", "orders", "json")):
    check(_name, oracle=f"SELECT * FROM {_table}")(_through_catalog(_table, _fmt))


@check("register_transformation", oracle="""
SELECT o.o_orderpriority AS o_orderpriority, CAST(count(*) AS BIGINT) AS n_lines,
       round(sum(l.l_quantity), 2) AS qty
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority""")
def r_register_transformation(spark, sf_dir):
    # the transformation is logged as a dataset with a run, then read back
    # through the catalog like any ingested dataset
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    res = cat.register_transformation("priority mix", {
        "sources": [{"alias": "o", "type": "parquet", "path": table_path(sf_dir, "orders")},
                    {"alias": "l", "type": "parquet", "path": table_path(sf_dir, "lineitem")}],
        "join": {"left": "o", "right": "l", "on": "o.o_orderkey = l.l_orderkey", "how": "inner"},
        "aggregate": {"group_by": ["o.o_orderpriority"], "metrics": {
            "n_lines": "CAST(count(*) AS BIGINT)", "qty": "round(sum(l.l_quantity), 2)"}}})
    return cat.read_snapshot(res["dataset_id"])


def _rollup(spark, sf_dir):
    # customers play datasets, their orders play runs (newest by date, key)
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_acctbal") >= 0, "active").otherwise("paused").alias("status"))
    runs = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("rows_processed"),
        F.struct("o_orderdate", "o_orderkey").alias("_order"))
    return dataset_rollup(cust, runs, "c_custkey", "o_custkey", "_order")


_ROLLUP_ORACLE = """
WITH r AS (
  SELECT o_custkey, o_orderkey, o_orderstatus,
         CAST(round(o_totalprice * 100) AS BIGINT) AS rows_processed,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
         count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders)
SELECT c.c_custkey AS c_custkey, c.c_name AS c_name,
       CASE WHEN c.c_acctbal >= 0 THEN 'active' ELSE 'paused' END AS status,
       r.o_orderkey AS last_orderkey, r.o_orderstatus AS last_status,
       CAST(coalesce(r.n, 0) AS BIGINT) AS total_runs
FROM customer c LEFT JOIN r ON r.o_custkey = c.c_custkey AND r.rn = 1"""


@check("run_rollup", oracle=_ROLLUP_ORACLE)
def r_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir).select(
        "c_custkey", "c_name", "status", F.col("last_run.o_orderkey").alias("last_orderkey"),
        F.col("last_run.o_orderstatus").alias("last_status"), "total_runs")


@check("run_totals", oracle=f"""
WITH roll AS (
  WITH r AS (
    SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS rows_processed,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
           count(*) OVER (PARTITION BY o_custkey) AS n
    FROM orders)
  SELECT CASE WHEN c.c_acctbal >= 0 THEN 'active' ELSE 'paused' END AS status,
         coalesce(r.n, 0) AS total_runs, r.rows_processed
  FROM customer c LEFT JOIN r ON r.o_custkey = c.c_custkey AND r.rn = 1)
SELECT CAST(count(*) AS BIGINT) AS n_datasets,
       CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS n_active,
       CAST(coalesce(sum(total_runs), 0) AS BIGINT) AS total_runs,
       CAST(coalesce(sum(rows_processed), 0) AS BIGINT) AS last_run_rows
FROM roll""")
def r_totals(spark, sf_dir):
    return run_totals(_rollup(spark, sf_dir))


@check("stream_ingest", oracle="SELECT * FROM events")
def r_stream(spark, sf_dir):
    # the events file arrives in the source directory; an availableNow stream
    # ingests it; a second run with the same checkpoint adds nothing
    events = table(spark, sf_dir, "events")
    target = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    for _ in range(2):
        stream_ingest(spark, sf_dir, target, events.schema, checkpoint=ckpt,
                      glob="events.parquet")
    return read_ingested(spark, target)


@check("stream_dataset_query", oracle="""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
       min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type""")
def r_stream_dataset(spark, sf_dir):
    # the events stream into a dataset; a half-written batch, a replay of a
    # committed one and a second ingest change nothing; queried by its id
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Live Events", {"type": "parquet", "path": table_path(sf_dir, "events")},
                             options={"streaming": True, "profile": False})
    res = cat.ingest(did)
    if res["status"] != "success":
        raise RuntimeError(res)
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{res['output_path']}/batches/half-written")
    commit_batch(events, res["output_path"], 0)
    cat.ingest(did)
    return cat.query([did], """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id, max(event_id) AS last_id
FROM live_events GROUP BY event_type""", limit=None).df


_SCHEMA_COLS = ["doc_id", "lang", "n_chars", "l_doc_id", "quality", "toxic"]


@check("dataset_schemas", oracle=f"""
WITH t AS (SELECT d.doc_id, d.lang, d.n_chars, l.doc_id AS l_doc_id, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""" + " UNION ALL ".join(
    f"""SELECT 'Docs & Labels' AS name, 'docs__labels' AS table_alias, '{c}' AS column_name,
       round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_percentage
       FROM t""" for c in _SCHEMA_COLS))
def r_dataset_schemas(spark, sf_dir):
    # a dataset ingested from documents ⟕ labels (NULLs in the label columns),
    # listed with its profile; an unknown id is skipped
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc_id")
    joined = d.join(lab, d.doc_id == lab.l_doc_id, "left")
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Docs & Labels", {"type": "derived"})
    cat.ingest(did, source_df=joined)
    return cat.dataset_schemas([did, "pipe-none"]).select(
        "name", "table_alias", "column_name", "null_percentage")


@check("run_status", oracle="""
SELECT 'success' AS status, CAST(count(*) AS BIGINT) AS rows_processed, 'parquet' AS format
FROM lineitem""")
def r_run_status(spark, sf_dir):
    # one run's newest state (R5): the success row replaces the running one
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Line items", {"type": "parquet",
                                            "path": table_path(sf_dir, "lineitem")},
                             options={"profile": False})
    res = cat.ingest(did)
    return cat.run_status(did, res["run_id"]).select("status", "rows_processed", "format")


@check("write_metrics", oracle="""
SELECT CAST(count(*) AS BIGINT) AS total_rows, true AS files_within_cap,
       CAST(count(*) AS BIGINT) AS rows_read_back FROM lineitem""")
def k_write_metrics(spark, sf_dir):
    # write accounting (K9): rows counted by an Observation on the write, no
    # file above the 10,000-row chunk cap, every row read back
    from quarry.sinks.writers import write_chunked
    out = scratch_path(spark, "metrics")
    m = write_chunked(table(spark, sf_dir, "lineitem"), out, chunk_rows=10000)
    per_file = (spark.read.parquet(out).groupBy(F.input_file_name().alias("f"))
                .agg(F.count(F.lit(1)).alias("n")))
    return per_file.agg(
        F.lit(m["total_rows"]).cast("bigint").alias("total_rows"),
        (F.max("n") <= 10000).alias("files_within_cap"),
        F.sum("n").cast("bigint").alias("rows_read_back"))


@check("approve_column", oracle="""
SELECT column_name,
       CASE column_name WHEN 'c_name' THEN 'Customer name' WHEN 'c_acctbal' THEN 'Balance, USD'
       END AS description,
       round(100.0 * count(*) FILTER (WHERE c IS NULL) / count(*), 2) AS null_percentage
FROM (SELECT 'c_custkey' AS column_name, c_custkey::VARCHAR AS c FROM customer
      UNION ALL SELECT 'c_name', c_name FROM customer
      UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer
      UNION ALL SELECT 'c_acctbal', c_acctbal::VARCHAR FROM customer
      UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) t
GROUP BY column_name""")
def r_approve(spark, sf_dir):
    # approvals are upserts by column key (the newest wins) and show in the
    # schema listing at once, next to the profile of the ingested snapshot
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Customers", {"type": "parquet",
                                           "path": table_path(sf_dir, "customer")})
    cat.ingest(did)
    cat.approve_column("c_name", "Name", "Who bought")
    cat.approve_column(" C_Name ", "Customer name", "Who bought")  # same key: replaces
    cat.approve_column("c_acctbal", "Balance, USD", "Credit position")
    return cat.dataset_schemas([did]).select("column_name", "description", "null_percentage")


def _two_datasets(spark, sf_dir, profile=True):
    cat = Catalog(spark, scratch_path(spark, "by-id"))
    ids = []
    for name, tab, fmt in (("Customer List", "customer", "csv"), ("Sales Orders", "orders", "json")):
        did = cat.create_dataset(name, {"type": "parquet", "path": table_path(sf_dir, tab)},
                                 options={"format": fmt, "profile": profile})
        res = cat.ingest(did)
        assert res["status"] == "success", res
        ids.append(did)
    return cat, ids


@check("query_by_dataset_id", oracle="""
SELECT c.c_mktsegment AS c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders,
       min(o.o_orderdate) AS first_order, max(o.o_orderkey) AS last_key
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""")
def r_query_by_id(spark, sf_dir):
    # only ids are given: snapshots are a CSV and a JSON one
    cat, ids = _two_datasets(spark, sf_dir, profile=False)
    return cat.query(ids, """
        SELECT c.c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders,
               min(o.o_orderdate) AS first_order, max(o.o_orderkey) AS last_key
        FROM customer_list c JOIN sales_orders o ON c.c_custkey = o.o_custkey
        GROUP BY c.c_mktsegment""").df


@check("catalog_pending_reviews", oracle="""
SELECT table_name AS tab, column_name AS column_name FROM information_schema.columns
WHERE table_name IN ('customer', 'orders') AND column_name <> 'o_custkey'""")
def r_catalog_pending(spark, sf_dir):
    cat, ids = _two_datasets(spark, sf_dir)
    cat.approve_column("O_CustKey ", "The buying customer")
    tab = F.when(F.col("dataset_id") == ids[0], "customer").otherwise("orders").alias("tab")
    return cat.pending_reviews().select(tab, "column_name")
