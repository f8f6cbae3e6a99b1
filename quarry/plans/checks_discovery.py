"""Checked queries for discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.discovery import dataset_search, dataset_search_topk, join_suggestions
from quarry.operators.profile import profile_columns
from quarry.plans.checks_profile import DUCK_COLUMNS, DUCK_SEMANTIC
from quarry.plans.registry import check, table

SEARCH_QUERY = "Blog posts in FR from example.net"
_HOST_RE = r"^[a-z]+://([^/?#]+)"


def _page_datasets(spark, sf_dir):
    # every page is a dataset: its host is the name, its url the source
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("id"),
                        F.regexp_extract("url", _HOST_RE, 1).alias("name"),
                        F.col("url").alias("source_url"),
                        F.col("page_id").alias("created_at"))


_SEARCH_ORACLE = f"""
WITH d AS (
  SELECT page_id AS id, regexp_extract(url, '{_HOST_RE}', 1) AS name, url FROM pages),
w AS (
  SELECT id,
    list_filter(list_distinct(regexp_extract_all(lower(name), '\\w+')),
                lambda x: list_contains(['blog','example','fr','from','in','net','posts'], x)) AS nm,
    list_filter(list_distinct(regexp_extract_all(lower(url), '\\w+')),
                lambda x: list_contains(['blog','example','fr','from','in','net','posts'], x)) AS sm
  FROM d)
SELECT id, round(CAST(least(len(nm) * 0.5 + len(sm) * 0.3, 1.0) AS DOUBLE), 2) AS confidence,
  CASE WHEN len(list_distinct(list_concat(nm, sm))) > 0
       THEN 'Matched keywords: ' || array_to_string(list_sort(list_distinct(list_concat(nm, sm))), ', ')
       ELSE 'Low relevance' END AS reason
FROM w"""


@check("dataset_search", oracle=_SEARCH_ORACLE)
def d_search(spark, sf_dir):
    scored = dataset_search(_page_datasets(spark, sf_dir), SEARCH_QUERY)
    return scored.select("id", "confidence", "reason")


@check("dataset_search_topk", oracle=f"""
SELECT id, confidence, reason FROM ({_SEARCH_ORACLE}) s
WHERE confidence > 0 ORDER BY confidence DESC, id LIMIT 5""")
def d_topk(spark, sf_dir):
    scored = dataset_search(_page_datasets(spark, sf_dir), SEARCH_QUERY)
    return dataset_search_topk(scored, 5).select("id", "confidence", "reason")


def _cols(spark, sf_dir, name):
    # a dataset's column list with semantic types is its profile (one pass
    # over the whole table), as the catalog stores it after an ingest
    return profile_columns(table(spark, sf_dir, name), with_samples=False).select(
        "ordinal", "column_name", "semantic_type")


_PAIR_RULE = """
  (regexp_replace(l.n, '[_\\-\\s]', '', 'g') LIKE '%' || regexp_replace(r.n, '[_\\-\\s]', '', 'g') || '%')
  OR (regexp_replace(r.n, '[_\\-\\s]', '', 'g') LIKE '%' || regexp_replace(l.n, '[_\\-\\s]', '', 'g') || '%')
  OR ((regexp_matches(l.n, 'id$') OR regexp_matches(l.n, '^id')) AND regexp_matches(r.n, 'id$'))"""


@check("join_suggestions", oracle=f"""
WITH c AS (SELECT table_name, column_name, lower(column_name) AS n, {DUCK_SEMANTIC} AS sem
           FROM {DUCK_COLUMNS} x),
p AS (
  SELECT l.column_name AS left_column, r.column_name AS right_column, l.n = r.n AS same,
         ({_PAIR_RULE}) AS sim,
         l.sem = 'identifier' AND r.sem = 'identifier' AS both_id, l.n AS ln, r.n AS rn
  FROM c l, c r WHERE (l.table_name = 'events' AND r.table_name = 'conversations')
                   OR (l.table_name = 'documents' AND r.table_name = 'labels')),
s AS (
  SELECT *, (CASE WHEN same THEN 0.95 WHEN sim THEN 0.75 ELSE 0.0 END)
            + (CASE WHEN both_id THEN 0.1 ELSE 0.0 END) AS conf FROM p)
SELECT left_column, right_column, round(CAST(least(conf, 1.0) AS DOUBLE), 2) AS confidence,
  concat_ws('; ', CASE WHEN same THEN 'Exact name match'
                       WHEN sim THEN 'Name similarity: ' || ln || ' <-> ' || rn END,
            CASE WHEN both_id THEN 'Both are identifiers' END) AS reason
FROM s WHERE conf > 0.5""")
def d_join(spark, sf_dir):
    a = join_suggestions(_cols(spark, sf_dir, "events"), _cols(spark, sf_dir, "conversations"))
    b = join_suggestions(_cols(spark, sf_dir, "documents"), _cols(spark, sf_dir, "labels"))
    return a.unionByName(b)
