"""Checked queries for profiling and curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.functions.names import column_key_col
from quarry.operators.profile import (apply_knowledge, column_stats, profile_columns,
                                      profile_table, review_count)
from quarry.plans.registry import TABLES, check, table

# ---- DuckDB side: Spark type names and the semantic rule over information_schema
DUCK_SPARK_TYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""

DUCK_SEMANTIC = """CASE
  WHEN contains(lower(column_name), 'email') THEN 'email'
  WHEN contains(lower(column_name), 'phone') OR contains(lower(column_name), 'tel') THEN 'phone'
  WHEN contains(lower(column_name), 'date') OR contains(lower(column_name), 'time') THEN 'datetime'
  WHEN contains(lower(column_name), 'id') THEN 'identifier'
  WHEN contains(lower(column_name), 'name') THEN 'name'
  WHEN contains(lower(column_name), 'address') OR contains(lower(column_name), 'street') THEN 'address'
  WHEN contains(lower(column_name), 'zip') OR contains(lower(column_name), 'postal') THEN 'postal_code'
  WHEN contains(lower(column_name), 'amount') OR contains(lower(column_name), 'price')
       OR contains(lower(column_name), 'cost') THEN 'currency'
  WHEN contains(lower(column_name), 'percent') OR contains(lower(column_name), 'rate') THEN 'percentage'
  WHEN spark_type IN ('tinyint','smallint','int','bigint','float','double') THEN 'numeric'
  WHEN spark_type IN ('date','timestamp','timestamp_ntz') THEN 'datetime'
  WHEN spark_type = 'boolean' THEN 'boolean'
  ELSE 'text' END"""

DUCK_COLUMNS = f"""(SELECT table_name, column_name, ordinal_position,
   {DUCK_SPARK_TYPE} AS spark_type FROM information_schema.columns
   WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}))"""

# The columns of the driver tables (TESTDATA.md), in order;
# float columns (NaN counts as missing) are marked with a trailing "~".
DRIVER_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal~ c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal~",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice~",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice~ o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity~ l_extendedprice~ "
                "l_discount~ l_tax~ l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value~ props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _duck_missing(c: str) -> str:
    return f"{c[:-1]} IS NULL OR isnan({c[:-1]})" if c.endswith("~") else f"{c} IS NULL"


# Per column of every driver table: its missing values over the full table.
DUCK_NULLS = "(" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c.rstrip('~')}' AS c, "
    f"CAST(count(*) FILTER (WHERE {_duck_missing(c)}) AS BIGINT) AS null_count FROM {t}"
    for t, cols in DRIVER_COLUMNS.items() for c in cols.split()) + ")"

DUCK_PROFILE = f"""(SELECT c.*, n.null_count FROM {DUCK_COLUMNS} c
   JOIN {DUCK_NULLS} n ON n.t = c.table_name AND n.c = c.column_name)"""


def _profiles(spark, sf_dir):
    """Profile of every column of every driver table (one aggregate pass
    over each whole table), tagged with the table name."""
    frames = [profile_columns(table(spark, sf_dir, t), with_samples=False)
              .withColumn("table_name", F.lit(t)) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), frames)


@check("profile_table", oracle="""
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem""")
def p_table(spark, sf_dir):
    return profile_table(table(spark, sf_dir, "lineitem"))


def _docs_labels(spark, sf_dir):
    # documents ⟕ labels: the label columns are NULL for unlabeled documents
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc_id")
    return d.join(lab, d.doc_id == lab.l_doc_id, "left")


_DL_COLS = ["doc_id", "lang", "n_chars", "l_doc_id", "quality", "toxic"]
_DL_FROM = """(SELECT d.doc_id, d.lang, d.n_chars, l.doc_id AS l_doc_id, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@check("profile_nulls", oracle=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count,
       round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_percentage
       FROM {_DL_FROM} t""" for c in _DL_COLS))
def p_nulls(spark, sf_dir):
    prof = profile_columns(_docs_labels(spark, sf_dir), with_samples=False)
    return prof.select("column_name", "null_count", "null_percentage")


@check("profile_distinct", oracle=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values
       FROM {_DL_FROM} t""" for c in _DL_COLS))
def p_distinct(spark, sf_dir):
    stats = column_stats(_docs_labels(spark, sf_dir), exact_distinct=True)
    return stats.select("column_name", "unique_values")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


@check("profile_numeric", oracle=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(avg({c}), 6) AS mean FROM lineitem""" for c in _LI_NUM) + """ UNION ALL
    SELECT c, NULL, NULL, NULL FROM (VALUES ('l_returnflag'), ('l_linestatus'), ('l_shipdate')) v(c)""")
def p_numeric(spark, sf_dir):
    stats = column_stats(table(spark, sf_dir, "lineitem"))
    return stats.select("column_name", "min", "max", F.round("mean", 6).alias("mean"))


# Semantic type, description and column key come with each column's
# profile; the missing-value count shows the table was profiled whole.
@check("semantic_types", oracle=f"""
SELECT table_name, column_name, spark_type AS data_type, {DUCK_SEMANTIC} AS semantic_type,
       null_count
FROM {DUCK_PROFILE} c""")
def p_semantic(spark, sf_dir):
    return _profiles(spark, sf_dir).select("table_name", "column_name", "data_type",
                                           "semantic_type", "null_count")


_DUCK_READABLE = """array_to_string(list_transform(string_split(replace(replace(column_name, '_', ' '), '-', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ')"""


@check("auto_descriptions", oracle=f"""
SELECT table_name, column_name,
  CASE sem WHEN 'email' THEN 'Email address - ' || r WHEN 'phone' THEN 'Phone number - ' || r
    WHEN 'identifier' THEN 'Unique identifier - ' || r WHEN 'currency' THEN 'Monetary amount - ' || r
    WHEN 'datetime' THEN 'Date/time value - ' || r ELSE r || ' (' || spark_type || ')' END AS auto_description,
  null_count
FROM (SELECT *, {DUCK_SEMANTIC} AS sem, {_DUCK_READABLE} AS r FROM {DUCK_PROFILE} c) t""")
def p_descriptions(spark, sf_dir):
    return _profiles(spark, sf_dir).select("table_name", "column_name", "auto_description",
                                           "null_count")


@check("column_key", oracle=f"""
SELECT table_name, column_name, replace(trim(lower(column_name)), ' ', '_') AS column_key,
       null_count
FROM {DUCK_PROFILE} c""")
def p_column_key(spark, sf_dir):
    return _profiles(spark, sf_dir).select("table_name", "column_name", "column_key",
                                           "null_count")


def _knowledge(spark):
    # curated entries: keys as typed by people (case, blanks) are normalised
    rows = [(" C_Name ", "Customer name", "Who bought"),
            ("c_acctbal", "Account balance", "Credit position"),
            ("unused column", "Not in this table", None)]
    k = spark.createDataFrame(rows, "column_name string, description string, business_meaning string")
    return k.select(column_key_col("column_name").alias("column_key"), "description",
                    "business_meaning", F.current_timestamp().alias("verified_at"))


_KNOW_ORACLE = f"""
SELECT column_name, k.description AS description, k.description IS NOT NULL AS human_verified,
       k.description IS NULL AS needs_review
FROM {DUCK_COLUMNS} c LEFT JOIN (VALUES ('c_name', 'Customer name'), ('c_acctbal', 'Account balance'))
  k(key, description) ON k.key = c.column_name
WHERE c.table_name = 'customer'"""


@check("apply_knowledge", oracle=_KNOW_ORACLE)
def p_knowledge(spark, sf_dir):
    prof = profile_columns(table(spark, sf_dir, "customer"), _knowledge(spark), with_samples=False)
    return prof.select("column_name", "description", "human_verified", "needs_review")


@check("pending_reviews", oracle=f"""
SELECT CAST(count(*) FILTER (WHERE needs_review) AS BIGINT) AS columns_needing_review
FROM ({_KNOW_ORACLE}) t""")
def p_pending(spark, sf_dir):
    prof = profile_columns(table(spark, sf_dir, "customer"), with_samples=False)
    return review_count(apply_knowledge(prof, _knowledge(spark))).select(
        F.col("columns_needing_review").cast("bigint").alias("columns_needing_review"))


# Full profile of the largest table: every deterministic field, the number
# of sample values shown (lineitem has no NULLs, so always 5) and the
# distinct estimate checked against the exact count (within 3 sd).
_LI_COLS = DRIVER_COLUMNS["lineitem"].split()


@check("profile_columns", oracle=f"""
SELECT c.column_name, CAST(n.row_count AS BIGINT) AS row_count, n.null_count,
       n.min, n.max, n.mean, {DUCK_SEMANTIC} AS semantic_type,
       CASE WHEN {DUCK_SEMANTIC} IN ('email', 'phone', 'identifier', 'currency', 'datetime')
            THEN 'x' ELSE 'y' END AS description_kind,
       lower(c.column_name) AS column_key, false AS human_verified, true AS needs_review,
       5 AS n_samples, true AS distinct_within_3sd
FROM {DUCK_COLUMNS} c JOIN (""" + " UNION ALL ".join(
    f"""SELECT '{c.rstrip("~")}' AS col, count(*) AS row_count,
       CAST(count(*) FILTER (WHERE {_duck_missing(c)}) AS BIGINT) AS null_count,
       {f"CAST(min({c.rstrip('~')}) AS DOUBLE)" if c.rstrip("~") not in ("l_returnflag", "l_linestatus", "l_shipdate") else "CAST(NULL AS DOUBLE)"} AS min,
       {f"CAST(max({c.rstrip('~')}) AS DOUBLE)" if c.rstrip("~") not in ("l_returnflag", "l_linestatus", "l_shipdate") else "CAST(NULL AS DOUBLE)"} AS max,
       {f"round(avg({c.rstrip('~')}), 6)" if c.rstrip("~") not in ("l_returnflag", "l_linestatus", "l_shipdate") else "CAST(NULL AS DOUBLE)"} AS mean
       FROM lineitem""" for c in _LI_COLS) + """) n ON n.col = c.column_name
WHERE c.table_name = 'lineitem'""")
def p_full(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    prof = profile_columns(li)
    exact = column_stats(li, exact_distinct=True).select(
        "column_name", F.col("unique_values").alias("_exact"))
    templated = F.col("semantic_type").isin("email", "phone", "identifier", "currency",
                                            "datetime")
    return prof.join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "min", "max", F.round("mean", 6).alias("mean"),
        "semantic_type",
        F.when(templated & ~F.col("auto_description").endswith(")"), "x")
        .when(~templated & F.col("auto_description").endswith(")"), "y")
        .otherwise("wrong").alias("description_kind"),
        "column_key", "human_verified", "needs_review",
        F.size("sample_values").alias("n_samples"),
        (F.abs(F.col("unique_values") - F.col("_exact")) <= F.col("_exact") * 0.15)
        .alias("distinct_within_3sd"))


# Profile on ingest (P16): the stored profile of an ingested snapshot, with
# statistics observed during the write.
_CUST = [("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True),
         ("c_mktsegment", False)]


@check("profile_on_ingest", oracle=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count,
       {f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS min,
       {f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS max
       FROM customer""" for c, num in _CUST))
def p_on_ingest(spark, sf_dir):
    from quarry.catalog import Catalog
    from quarry.plans.registry import table_path
    from quarry.session import scratch_path
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    did = cat.create_dataset("Customers", {"type": "parquet",
                                           "path": table_path(sf_dir, "customer")})
    cat.ingest(did)
    return cat.profiles().where(F.col("dataset_id") == did).select(
        "column_name", "row_count", "null_count", "min", "max")


# Annotation inputs (P13): columns still needing review after the knowledge
# overlay (``lang`` is curated), with their profile figures.
_DL_TYPES = {"doc_id": "bigint", "lang": "string", "n_chars": "bigint", "l_doc_id": "bigint",
             "quality": "int", "toxic": "int"}


@check("annotation_inputs", oracle=f"""
SELECT column_name, spark_type AS data_type, {DUCK_SEMANTIC} AS semantic_type, null_percentage
FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS spark_type,
       round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_percentage
       FROM {_DL_FROM} t""" for c, t in _DL_TYPES.items() if c != "lang") + ") x")
def p_annotation_inputs(spark, sf_dir):
    from quarry.operators.profile import annotation_inputs
    k = spark.createDataFrame([("lang", "Language code", "Routing", None)],
                              "column_key string, description string, business_meaning string, "
                              "verified_at timestamp")
    prof = profile_columns(_docs_labels(spark, sf_dir), k)
    return annotation_inputs(prof).select("column_name", "data_type", "semantic_type",
                                          "null_percentage")


# Annotations (P14, P15): one fenced JSON answer per column of the orders
# profile (as an annotator would return it, describing the column by its
# auto description), parsed and merged back onto the profile.
@check("merge_annotations", oracle=f"""
SELECT table_name, column_name,
  CASE sem WHEN 'email' THEN 'Email address - ' || r WHEN 'phone' THEN 'Phone number - ' || r
    WHEN 'identifier' THEN 'Unique identifier - ' || r WHEN 'currency' THEN 'Monetary amount - ' || r
    WHEN 'datetime' THEN 'Date/time value - ' || r ELSE r || ' (' || spark_type || ')' END AS ai_description,
  'missing: ' || CAST(null_count AS VARCHAR) AS ai_quality_notes, CAST(0.7 AS DOUBLE) AS ai_confidence
FROM (SELECT *, {DUCK_SEMANTIC} AS sem, {_DUCK_READABLE} AS r FROM {DUCK_PROFILE} c) t
WHERE table_name = 'orders'""")
def p_merge_annotations(spark, sf_dir):
    from quarry.operators.profile import merge_annotations, parse_annotations
    prof = profile_columns(table(spark, sf_dir, "orders"), with_samples=False)
    answer = F.to_json(F.create_map(F.col("column_name"), F.struct(
        F.col("auto_description").alias("description"),
        F.concat(F.lit("missing: "), F.col("null_count").cast("string")).alias("quality_notes"))))
    texts = prof.select(F.concat(F.lit("Here you go:\n```json\n"), answer, F.lit("\n```"))
                        .alias("text"))
    merged = merge_annotations(prof, texts.select(parse_annotations("text").alias("annotations")))
    return merged.select(F.lit("orders").alias("table_name"), "column_name", "ai_description",
                         "ai_quality_notes", "ai_confidence")
