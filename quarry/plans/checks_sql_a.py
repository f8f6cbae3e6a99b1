"""SQL surface, group A (the advertised features, A1-A19).

Each key is one Spark SQL statement run through ``run_sql`` over views of
the driver tables, next to its DuckDB oracle.  Where the dialects differ
(see README "SQL dialect"), the oracle text carries the DuckDB form and
the casts that make result types agree.
"""

from __future__ import annotations

from quarry.plans.query import run_sql
from quarry.plans.registry import check, table_refs


def sql_check(key: str, spark_sql: str, duck_sql: str | None = None, *tables: str):
    """Register ``spark_sql`` (uncapped) with ``duck_sql`` (default: same text)."""
    def run(spark, sf_dir):
        return run_sql(spark, table_refs(sf_dir, *tables), spark_sql, cap=None).df
    run.__name__ = f"sql_{key}"
    check(key, oracle=duck_sql if duck_sql is not None else spark_sql)(run)


sql_check("sql_filter_project", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_shipdate
FROM lineitem WHERE l_shipdate >= '1998-01-01' AND l_quantity < 10""", None, "lineitem")

sql_check("sql_inner_join3", """
SELECT c.c_mktsegment AS c_mktsegment, o.o_orderpriority AS o_orderpriority,
       CAST(count(*) AS BIGINT) AS n_lines, round(sum(l.l_extendedprice), 2) AS gross
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_mktsegment, o.o_orderpriority""", None, "customer", "orders", "lineitem")

sql_check("sql_left_join", """
SELECT d.doc_id AS doc_id, d.lang AS lang, l.quality AS quality, l.toxic AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", None, "documents", "labels")

sql_check("sql_right_join", """
SELECT l.doc_id AS label_doc, d.doc_id AS doc_id, d.lang AS lang
FROM (SELECT * FROM documents WHERE lang = 'en') d
RIGHT JOIN labels l ON d.doc_id = l.doc_id""", None, "documents", "labels")

sql_check("sql_full_join", """
SELECT d.doc_id AS doc_id, l.doc_id AS label_doc
FROM (SELECT * FROM documents WHERE lang = 'en') d
FULL OUTER JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""",
          None, "documents", "labels")

sql_check("sql_cte", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
seg AS (SELECT c.c_mktsegment AS seg, s.total FROM spend s JOIN customer c ON c.c_custkey = s.o_custkey)
SELECT seg, CAST(count(*) AS BIGINT) AS n_customers, round(avg(total), 2) AS avg_total
FROM seg GROUP BY seg""", None, "customer", "orders")

sql_check("sql_row_number", """
SELECT o_custkey, o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn
FROM orders""", None, "orders")

sql_check("sql_rank", """
SELECT c_custkey, c_mktsegment,
       CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -3) DESC) AS BIGINT) AS rnk
FROM customer""", None, "customer")

sql_check("sql_lag_lead", """
SELECT conv_id, turn, role,
       lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
       lead(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
FROM conversations""", None, "conversations")

sql_check("sql_aggregates", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
       CAST(count(*) AS BIGINT) AS n, min(l_shipdate) AS first_ship, max(l_discount) AS max_disc,
       CAST(sum(l_linenumber) AS BIGINT) AS sum_lines
FROM lineitem GROUP BY l_returnflag""", None, "lineitem")

sql_check("sql_group_concat", """
SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names
FROM nation GROUP BY n_regionkey""", """
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names
FROM nation GROUP BY n_regionkey""", "nation")

sql_check("sql_scalar_subquery", """
SELECT c_custkey, c_acctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
  AND c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = customer.c_nationkey)""",
          None, "customer")

sql_check("sql_in_subquery", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
          None, "orders", "customer")

sql_check("sql_exists", """
SELECT d.doc_id, d.source FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""",
          None, "documents", "labels")

sql_check("sql_case", """
SELECT CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid'
            ELSE 'low' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1""", None, "orders")

sql_check("sql_string_functions", """
SELECT p_partkey, substring(p_name, 1, 5) AS head, upper(p_brand) AS ub, lower(p_type) AS lt,
       concat_ws('', p_brand, '/', p_type) AS bt, trim(concat_ws('', '  ', p_name, '  ')) AS trimmed
FROM part""", None, "part")

sql_check("sql_extract", """
SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y,
       CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m,
       CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d,
       CAST(EXTRACT(DAYOFWEEK FROM o_orderdate) - 1 AS BIGINT) AS dow
FROM orders""", """
SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y,
       CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m,
       CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d,
       CAST(EXTRACT(DOW FROM o_orderdate) AS BIGINT) AS dow
FROM orders""", "orders")

sql_check("sql_date_trunc", """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month,
       CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1""", """
SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1""", "orders")

sql_check("sql_strftime", """
SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd HH:mm') AS stamp FROM orders""", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp FROM orders""", "orders")

sql_check("sql_math", """
SELECT c_custkey, round(c_acctbal / 3, 2) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS up,
       CAST(floor(c_acctbal) AS BIGINT) AS down, abs(c_acctbal) AS a
FROM customer""", None, "customer")

sql_check("sql_cast", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS size_d, CAST(p_size AS STRING) AS size_s,
       CAST(round(p_retailprice) AS BIGINT) AS price_i, TRY_CAST(p_brand AS INT) AS brand_i,
       CAST(p_retailprice AS DECIMAL(12, 2)) AS price_dec
FROM part""", None, "part")

sql_check("sql_topk", """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10""", None, "orders")

sql_check("sql_division", """
SELECT p_partkey, p_size / 2 AS half, try_divide(p_retailprice, p_size - 25) AS ratio
FROM part""", """
SELECT p_partkey, p_size / 2 AS half,
       CASE WHEN p_size - 25 = 0 THEN NULL ELSE p_retailprice / (p_size - 25) END AS ratio
FROM part""", "part")
