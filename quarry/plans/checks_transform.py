"""Checked queries for the declarative transformation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.asof import asof_join
from quarry.operators.hotkeys import hot_key_join
from quarry.operators.transform import run_transformation
from quarry.plans.registry import check, table, table_path


def _src(sf_dir, alias, name):
    return {"alias": alias, "type": "parquet", "path": table_path(sf_dir, name)}


@check("transform_identity", oracle="SELECT * FROM nation")
def t_identity(spark, sf_dir):
    return run_transformation(spark, {"sources": [_src(sf_dir, "n", "nation")]})


_DOC_LABEL_AGG = {
    "group_by": ["d.lang"],
    "metrics": {"n_docs": "CAST(count(*) AS BIGINT)",
                "n_labeled": "CAST(count(l.doc_id) AS BIGINT)",
                "sum_quality": "CAST(sum(l.quality) AS BIGINT)"},
}


def _doc_label(sf_dir, how, agg=True):
    cfg = {"sources": [_src(sf_dir, "d", "documents"), _src(sf_dir, "l", "labels")],
           "join": {"left": "d", "right": "l", "on": "d.doc_id = l.doc_id", "how": how}}
    if agg:
        cfg["aggregate"] = _DOC_LABEL_AGG
    return cfg


_DL_SELECT = """SELECT d.lang AS lang, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(count(l.doc_id) AS BIGINT) AS n_labeled, CAST(sum(l.quality) AS BIGINT) AS sum_quality
FROM documents d {join} labels l ON d.doc_id = l.doc_id GROUP BY d.lang"""


@check("transform_inner", oracle=_DL_SELECT.format(join="INNER JOIN"))
def t_inner(spark, sf_dir):
    return run_transformation(spark, _doc_label(sf_dir, "inner"))


@check("transform_left", oracle=_DL_SELECT.format(join="LEFT JOIN"))
def t_left(spark, sf_dir):
    cfg = _doc_label(sf_dir, None)
    del cfg["join"]["how"]  # left is the default
    return run_transformation(spark, cfg)


# Right / full: English documents against all labels / the good-quality
# labels, so both sides keep rows without a partner.
@check("transform_right", oracle="""
SELECT l.doc_id AS label_doc, l.quality AS quality, d.doc_id AS doc_id, d.lang AS lang
FROM (SELECT * FROM documents WHERE lang = 'en') d
RIGHT JOIN labels l ON d.doc_id = l.doc_id""")
def t_right(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_doc"), "quality")
    out = run_transformation(spark, {
        "sources": [{"alias": "d"}, {"alias": "l"}],
        "join": {"left": "d", "right": "l", "on": "d.doc_id = l.label_doc", "how": "right"}},
        frames={"d": d, "l": lab})
    return out.select("label_doc", "quality", "doc_id", "lang")


@check("transform_outer", oracle="""
SELECT d.doc_id AS doc_id, d.n_chars AS n_chars, l.doc_id AS label_doc, l.toxic AS toxic
FROM (SELECT * FROM documents WHERE lang = 'en') d
FULL OUTER JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""")
def t_outer(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    lab = (table(spark, sf_dir, "labels").where("quality = 1")
           .select(F.col("doc_id").alias("label_doc"), "toxic"))
    out = run_transformation(spark, {
        "sources": [{"alias": "d"}, {"alias": "l"}],
        "join": {"left": "d", "right": "l", "on": "d.doc_id = l.label_doc", "how": "outer"}},
        frames={"d": d, "l": lab})
    return out.select("doc_id", "n_chars", "label_doc", "toxic")


@check("transform_semi", oracle="""
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def t_semi(spark, sf_dir):
    return run_transformation(spark, _doc_label(sf_dir, "semi", agg=False)).select(
        "doc_id", "lang", "n_chars")


@check("transform_anti", oracle="""
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def t_anti(spark, sf_dir):
    return run_transformation(spark, _doc_label(sf_dir, "anti", agg=False)).select(
        "doc_id", "lang", "n_chars")


# Purchases meet the user's newest signup at or before the purchase.  Right
# rows with equal (user, time) are reduced to the largest event_id in the
# oracle, which is the tie rule of the Spark operator (largest tiebreak).
_ASOF_ORACLE = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id AS s_user_id, ts AS s_ts, max(event_id) AS s_event_id
      FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT p.event_id AS event_id, p.user_id AS user_id, p.ts AS ts,
       s.s_event_id AS signup_id, s.s_ts AS signup_ts
FROM p ASOF JOIN s ON p.user_id = s.s_user_id AND p.ts >= s.s_ts"""


@check("transform_asof", oracle=_ASOF_ORACLE)
def t_asof(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    s = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("signup_id"), F.col("user_id").alias("s_user_id"),
        F.col("ts").alias("signup_ts"))
    out = run_transformation(spark, {
        "sources": [{"alias": "p"}, {"alias": "s"}],
        "join": {"left": "p", "right": "s", "how": "asof", "tiebreak": ["signup_id"],
                 "on": "p.user_id = s.s_user_id AND p.ts >= s.signup_ts"}},
        frames={"p": p, "s": s})
    return out.select("event_id", "user_id", "ts", "signup_id", "signup_ts")


@check("transform_asof_unbucketed", oracle=_ASOF_ORACLE)
def t_asof_plain(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    s = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("signup_id"), F.col("user_id").alias("s_user_id"),
        F.col("ts").alias("signup_ts"))
    return asof_join(p, s, [("user_id", "s_user_id")], "ts", "signup_ts",
                     tiebreak=["signup_id"], bucket=None).select(
        "event_id", "user_id", "ts", "signup_id", "signup_ts")


def _asof_sides(spark, sf_dir, time):
    ev = table(spark, sf_dir, "events")
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", F.col(time).alias("t"))
    s = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("signup_id"), F.col("user_id").alias("s_user_id"), F.col(time).alias("s_t"))
    return {"p": p, "s": s}


def _asof_form(time, op, how):
    join = {"left": "p", "right": "s", "how": how, "tiebreak": ["signup_id"],
            "on": f"p.user_id = s.s_user_id AND p.t {op} s.s_t"}

    def run(spark, sf_dir):
        out = run_transformation(spark, {"sources": [{"alias": "p"}, {"alias": "s"}], "join": join},
                                 frames=_asof_sides(spark, sf_dir, time))
        return out.select("event_id", "user_id", "t", "signup_id", "s_t")
    return run


for _name, _time, _op, _how in (("transform_asof_strict", "ts", ">", "asof"),
                                ("transform_asof_left_next", "ts", "<=", "asof_left"),
                                ("transform_asof_integer", "event_id", "<", "asof")):
    check(_name, oracle=f"""
WITH p AS (SELECT event_id, user_id, {_time} AS t FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id AS s_user_id, {_time} AS s_t, max(event_id) AS signup_id
      FROM events WHERE event_type = 'signup' GROUP BY user_id, {_time})
SELECT p.event_id AS event_id, p.user_id AS user_id, p.t AS t, s.signup_id AS signup_id, s.s_t AS s_t
FROM p ASOF {"LEFT" if _how == "asof_left" else ""} JOIN s ON p.user_id = s.s_user_id AND p.t {_op} s.s_t""")(
        _asof_form(_time, _op, _how))


@check("transform_range_time", oracle="""
WITH w AS (SELECT event_id AS w_id, ts AS st, ts + INTERVAL 20 MINUTE AS en
           FROM events WHERE event_type = 'signup')
SELECT w.w_id AS w_id, CAST(count(*) AS BIGINT) AS n_events, max(e.event_id) AS last_event
FROM events e JOIN w ON e.ts >= w.st AND e.ts < w.en GROUP BY w.w_id""")
def t_range_time(spark, sf_dir):
    # a window after each signup against all events: bins on the time axis
    ev = table(spark, sf_dir, "events")
    w = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("w_id"), F.col("ts").alias("st"),
        (F.col("ts") + F.expr("INTERVAL 20 MINUTE")).alias("en"))
    return run_transformation(spark, {
        "sources": [{"alias": "e"}, {"alias": "w"}],
        "join": {"left": "e", "right": "w", "how": "inner", "on": "e.ts >= w.st AND e.ts < w.en"},
        "aggregate": {"group_by": ["w.w_id"], "metrics": {
            "n_events": "CAST(count(*) AS BIGINT)", "last_event": "max(e.event_id)"}}},
        frames={"e": ev.select("event_id", "ts"), "w": w})


@check("transform_theta", oracle="""
SELECT c.c_custkey AS c_custkey, CAST(count(*) AS BIGINT) AS n_big_orders
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20
GROUP BY c.c_custkey""")
def t_theta(spark, sf_dir):
    # equi part is hashed, the range part is a residual filter of the join
    return run_transformation(spark, {
        "sources": [_src(sf_dir, "c", "customer"), _src(sf_dir, "o", "orders")],
        "join": {"left": "c", "right": "o", "how": "inner",
                 "on": "o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20"},
        "aggregate": {"group_by": ["c.c_custkey"],
                      "metrics": {"n_big_orders": "CAST(count(*) AS BIGINT)"}}})


@check("transform_aggregate", oracle="""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def t_aggregate(spark, sf_dir):
    return run_transformation(spark, {
        "sources": [_src(sf_dir, "l", "lineitem")],
        "aggregate": {"group_by": ["l_returnflag", "l_linestatus"], "metrics": {
            "sum_qty": "round(sum(l_quantity), 2)",
            "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)",
            "avg_disc": "round(avg(l_discount), 6)",
            "count_order": "CAST(count(*) AS BIGINT)"}}})


@check("transform_join_aggregate", oracle="""
SELECT n.n_name AS n_name, CAST(count(*) AS BIGINT) AS n_suppliers,
       round(sum(s.s_acctbal), 2) AS total_acctbal
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""")
def t_join_aggregate(spark, sf_dir):
    return run_transformation(spark, {
        "sources": [_src(sf_dir, "s", "supplier"), _src(sf_dir, "n", "nation")],
        "join": {"left": "s", "right": "n", "on": "s.s_nationkey = n.n_nationkey", "how": "inner"},
        "aggregate": {"group_by": ["n.n_name"], "metrics": {
            "n_suppliers": "CAST(count(*) AS BIGINT)",
            "total_acctbal": "round(sum(s.s_acctbal), 2)"}}})


@check("transform_global_agg", oracle="""
SELECT CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS total,
       min(o_orderdate) AS first_order FROM orders""")
def t_global_agg(spark, sf_dir):
    return run_transformation(spark, {
        "sources": [_src(sf_dir, "o", "orders")],
        "aggregate": {"group_by": [], "metrics": {
            "n_orders": "CAST(count(*) AS BIGINT)", "total": "round(sum(o_totalprice), 2)",
            "first_order": "min(o_orderdate)"}}})


@check("dedupe_columns", oracle="""
SELECT s.s_suppkey AS s_suppkey, s.s_nationkey AS s_nationkey, s.s_name AS s_name,
       n.n_nationkey AS n_nationkey, n.n_name AS n_name,
       n2.n_nationkey AS n_nationkey_1, n2.n_name AS n_name_1
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN nation n2 ON n2.n_regionkey = n.n_regionkey AND n2.n_nationkey = n.n_nationkey""")
def t_dedupe(spark, sf_dir):
    # SELECT * of a self-join: the second n_nationkey / n_name become *_1.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).drop("n_regionkey")
    out = run_transformation(spark, {
        "sources": [{"alias": "a"}, {"alias": "b"}],
        "join": {"left": "a", "right": "b", "how": "inner",
                 "on": "a.n_nationkey = b.n_nationkey"}},
        frames={"a": sn, "b": n.drop("n_regionkey")})
    return out


# A pure range condition: orders whose price falls in a customer's band.
# The engine turns it into an equi-join on price bins (bin width = mean
# band length, 500 here) with the exact test as residual, never all pairs.
_BANDS = "(SELECT c_custkey, c_acctbal * 10 AS lo, c_acctbal * 10 + 500 AS hi FROM customer)"


def _bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") * 10).alias("lo"),
        (F.col("c_acctbal") * 10 + 500).alias("hi"))
    return o, c


@check("transform_range", oracle=f"""
SELECT o.o_orderkey AS o_orderkey, c.c_custkey AS c_custkey
FROM orders o JOIN {_BANDS} c ON o.o_totalprice >= c.lo AND o.o_totalprice < c.hi""")
def t_range(spark, sf_dir):
    o, c = _bands(spark, sf_dir)
    return run_transformation(spark, {
        "sources": [{"alias": "o"}, {"alias": "c"}],
        "join": {"left": "o", "right": "c", "how": "inner",
                 "on": "o.o_totalprice >= c.lo AND o.o_totalprice < c.hi"}},
        frames={"o": o, "c": c}).select("o_orderkey", "c_custkey")


@check("transform_range_left", oracle=f"""
SELECT o.o_orderkey AS o_orderkey, CAST(count(c.c_custkey) AS BIGINT) AS n_bands
FROM orders o LEFT JOIN {_BANDS} c ON c.lo <= o.o_totalprice AND c.hi > o.o_totalprice
GROUP BY o.o_orderkey""")
def t_range_left(spark, sf_dir):
    # every order is kept; orders in no band count 0
    o, c = _bands(spark, sf_dir)
    return run_transformation(spark, {
        "sources": [{"alias": "o"}, {"alias": "c"}],
        "join": {"left": "o", "right": "c", "how": "left",
                 "on": "c.lo <= o.o_totalprice AND c.hi > o.o_totalprice"},
        "aggregate": {"group_by": ["o.o_orderkey"],
                      "metrics": {"n_bands": "CAST(count(c.c_custkey) AS BIGINT)"}}},
        frames={"o": o, "c": c})


_HOT_KEY = "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 5 = 0 THEN NULL ELSE user_id * 2 END"


def _hot_join(spark, sf_dir, how):
    """A third of the events on one customer, a fifth of the rest on none."""
    ev = table(spark, sf_dir, "events").select("event_id", F.expr(_HOT_KEY).alias("cust"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return hot_key_join(ev, cu, [("cust", "c_custkey")], how)


_HOT_SELECT = f"""SELECT e.event_id, e.cust, c.c_custkey, c.c_nationkey
FROM (SELECT event_id, {_HOT_KEY} AS cust FROM events) e {{join}} customer c ON e.cust = c.c_custkey"""


@check("hot_key_full_join", oracle=_HOT_SELECT.format(join="FULL JOIN"))
def t_hot_full(spark, sf_dir):
    return _hot_join(spark, sf_dir, "full")


@check("hot_key_right_join", oracle=_HOT_SELECT.format(join="RIGHT JOIN"))
def t_hot_right(spark, sf_dir):
    return _hot_join(spark, sf_dir, "right")
