"""Discovery: keyword score, top-k, join-key suggestions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators.discovery import (dataset_search, dataset_search_topk, join_suggestions,
                                        names_similar)

DS = "id string, name string, source_url string, source_query string, created_at int"


def _search(spark, rows, query, cols=None):
    d = spark.createDataFrame(rows, DS)
    c = spark.createDataFrame(cols, "dataset_id string, column_name string") if cols else None
    return {r.id: (r.confidence, r.reason) for r in dataset_search(d, query, c).collect()}


def test_score_steps(spark):
    rows = [("n", "Sales Data", None, None, 1),               # name: 2 words
            ("u", "x", "https://h/orders.csv", None, 2),      # url words
            ("q", "x", None, "select * from orders", 3),      # query text used without url
            ("uq", "x", "https://h/a.csv", "orders", 4),      # url present: query ignored
            ("c", "x", None, None, 5),                        # column hits only
            ("cap", "sales orders data", "https://sales/orders/data", None, 6)]
    cols = [("c", "order_total"), ("c", "ORDERS_ID"), ("c", "name")]
    got = _search(spark, rows, "sales data orders", cols)
    assert got["n"][0] == 1.0
    assert got["u"] == (0.3, "Matched keywords: orders")
    assert got["q"][0] == 0.3
    assert got["uq"][0] == 0.0 and got["uq"][1] == "Low relevance"
    assert got["c"] == (0.1, "Matched keywords: ORDERS_ID")  # 'orders' ⊂ orders_id only
    assert got["cap"][0] == 1.0
    got2 = _search(spark, rows, "sales", cols)
    assert got2["n"][0] == 0.5
    assert all(v[0] == 0.0 for v in _search(spark, rows, "", cols).values())


def test_topk_order(spark):
    rows = [("a", "alpha", None, None, 3), ("b", "alpha beta", None, None, 2),
            ("c", "alpha", None, None, 1), ("d", "zzz", None, None, 0)]
    d = spark.createDataFrame(rows, DS)
    top = dataset_search_topk(dataset_search(d, "alpha beta"), k=3).collect()
    assert [r.id for r in top] == ["b", "c", "a"]


def _cols(spark, rows):
    return spark.createDataFrame(rows, "column_name string, semantic_type string")


def test_join_suggestions_cases(spark):
    left = _cols(spark, [("id", "identifier"), ("user_id", "identifier"), ("a_id", "identifier"),
                         ("idx", "identifier"), ("total", "numeric")])
    right = _cols(spark, [("id", "identifier"), ("userid", "identifier"), ("b_id", "identifier"),
                          ("video_no", "text")])
    got = {(r.left_column, r.right_column): (r.confidence, r.reason)
           for r in join_suggestions(left, right).collect()}
    assert got[("id", "id")] == (1.0, "Exact name match; Both are identifiers")
    assert got[("user_id", "userid")][0] == 0.85
    assert got[("a_id", "b_id")][0] == 0.85
    assert ("idx", "video_no") not in got
    assert ("total", "id") not in got
    confs = [r.confidence for r in join_suggestions(left, right).collect()]
    assert confs == sorted(confs, reverse=True)


def _similar_rule(a: str, b: str) -> bool:
    import re
    c1, c2 = re.sub(r"[_\-\s]", "", a), re.sub(r"[_\-\s]", "", b)
    if c1 in c2 or c2 in c1:
        return True
    return bool((re.search("id$", a) or re.search("^id", a)) and re.search("id$", b))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("aidx_-", min_size=1, max_size=6),
                          st.text("aidx_-", min_size=1, max_size=6)), min_size=1, max_size=15))
def test_names_similar_property(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(names_similar(F.col("a"), F.col("b"))).collect()]
    assert got == [_similar_rule(a, b) for a, b in pairs]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("aid_x", min_size=1, max_size=5), min_size=1, max_size=6, unique=True),
       st.lists(st.text("aid_x", min_size=1, max_size=5), min_size=1, max_size=6, unique=True))
def test_join_suggestions_equal_all_pairs_rule(spark, left, right):
    # the equi-join candidate set finds exactly what the all-pairs rule finds
    L = _cols(spark, [(n, "identifier" if "id" in n else "text") for n in left])
    R = _cols(spark, [(n, "identifier" if "id" in n else "text") for n in right])
    got = {(r.left_column, r.right_column) for r in join_suggestions(L, R).collect()}
    want = set()
    for a in left:
        for b in right:
            base = 0.95 if a == b else (0.75 if _similar_rule(a, b) else 0.0)
            if base + (0.1 if ("id" in a and "id" in b) else 0.0) > 0.5:
                want.add((a, b))
    assert got == want
