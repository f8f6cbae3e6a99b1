"""Checked queries for the query layer (Q1-Q8) and the flagship join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.names import sanitize_col
from quarry.functions.nulls import nan_to_null
from quarry.operators.snapshot import latest_per_key
from quarry.plans.query import run_sql
from quarry.plans.registry import check, table, table_refs

# Revenue per market segment over customer ⋈ orders ⋈ lineitem.  Lineitem is
# reduced to one row per order *before* the join: the aggregate's shuffle on
# l_orderkey is the join's partitioning, so the big side is exchanged once
# and the join input shrinks from line items to orders.
FLAGSHIP_SQL = """
WITH li AS (
  SELECT l_orderkey,
         sum(l_extendedprice * (1 - l_discount)) AS rev,
         count(*) AS n
  FROM lineitem
  GROUP BY l_orderkey
)
SELECT c.c_mktsegment AS c_mktsegment,
       CAST(count(*) AS BIGINT) AS n_orders,
       CAST(sum(li.n) AS BIGINT) AS n_lines,
       round(sum(li.rev), 2) AS revenue
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN li ON li.l_orderkey = o.o_orderkey
GROUP BY c.c_mktsegment
ORDER BY revenue DESC NULLS LAST
"""


def flagship(spark, sf_dir):
    return run_sql(spark, table_refs(sf_dir, "customer", "orders", "lineitem"),
                   FLAGSHIP_SQL, cap=None).df


@check("run_sql", oracle=FLAGSHIP_SQL)
def q_run_sql(spark, sf_dir):
    return flagship(spark, sf_dir)


@check("dataset_views", oracle="""
SELECT n.n_name AS n_name, r.r_name AS r_name, CAST(count(*) AS BIGINT) AS n_customers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY n.n_name, r.r_name
""")
def q_dataset_views(spark, sf_dir):
    # Dataset names with blanks and capitals bind as normalised view names.
    refs = table_refs(sf_dir, "customer", "nation", "region")
    named = {"Customer": refs["customer"], "Nation ": refs["nation"], "REGION": refs["region"]}
    return run_sql(spark, named, """
        SELECT n.n_name AS n_name, r.r_name AS r_name, CAST(count(*) AS BIGINT) AS n_customers
        FROM customer c JOIN nation_ n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        GROUP BY n.n_name, r.r_name""", cap=None).df


@check("latest_snapshot", oracle="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'F') t
WHERE rn = 1
""")
def q_latest_snapshot(spark, sf_dir):
    # Orders play the run log: per customer, the newest order whose status
    # is 'F' (the "successful" run), ties broken by key.
    orders = table(spark, sf_dir, "orders")
    return latest_per_key(orders, key="o_custkey", order=["o_orderdate", "o_orderkey"],
                          where=F.col("o_orderstatus") == "F").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_CLEAN_PNAME = "regexp_replace(replace(replace(lower(p_name), ' ', '_'), '-', '_'), '[^a-z0-9_]', '', 'g')"


@check("sanitize_names", oracle=f"""
SELECT p_partkey,
       CASE WHEN regexp_matches({_CLEAN_PNAME}, '^[0-9]') THEN 't_' || {_CLEAN_PNAME}
            ELSE {_CLEAN_PNAME} END AS view_name
FROM part
""")
def q_sanitize_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", sanitize_col("p_name").alias("view_name"))


@check("capped_query", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000
""")
def q_capped_query(spark, sf_dir):
    # No LIMIT in the text (credit_limit-like names do not count): cap 1000.
    return run_sql(spark, table_refs(sf_dir, "orders"), """
        SELECT o_orderkey, o_custkey, o_totalprice AS o_totalprice
        FROM orders -- no limit here
        ORDER BY o_totalprice DESC, o_orderkey;""").df


@check("nan_to_null", oracle="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS disc
FROM lineitem
""")
def q_nan_to_null(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
                   .otherwise(F.col("l_discount")).alias("disc"))
    return nan_to_null(df)
