"""Transformations, as-of join, range join, SQL gap helpers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.asof import asof_join
from quarry.operators.joins import unique_names
from quarry.operators.ranges import range_join
from quarry.operators.sqlgaps import distinct_on, group_concat, qualify
from quarry.operators.transform import run_transformation

T0 = datetime(2024, 1, 1)


def _t(m):
    return T0 + timedelta(minutes=m)


def _asof_frames(spark):
    left = spark.createDataFrame(
        [(1, "a", _t(10)),    # equal time with a right row -> matches it
         (2, "a", _t(5)),     # no earlier right row -> dropped
         (3, None, _t(30)),   # null key -> never matches
         (4, "b", _t(100)),   # several earlier rows -> newest
         (5, "b", _t(60 * 30))],  # far later (other buckets) -> carried in
        "lid int, k string, t timestamp")
    right = spark.createDataFrame(
        [(10, "a", _t(10)), (11, "a", _t(7)), (12, None, _t(1)),
         (13, "b", _t(1)), (14, "b", _t(90)), (15, "b", _t(95)), (16, "b", _t(95))],
        "rid int, rk string, rt timestamp")
    return left, right


@pytest.mark.parametrize("bucket", ["hour", "day", 60, 7, None])
def test_asof_rules(spark, bucket):
    left, right = _asof_frames(spark)
    out = asof_join(left, right, [("k", "rk")], "t", "rt", tiebreak=["rid"], bucket=bucket)
    got = sorted((r.lid, r.rid) for r in out.collect())
    assert got == [(1, 10), (4, 16), (5, 16)]


def test_asof_matches_brute_force(spark):
    rnd = random.Random(3)
    lrows = [(i, rnd.randint(0, 4), _t(rnd.randint(0, 5000))) for i in range(300)]
    rrows = [(1000 + i, rnd.randint(0, 4), _t(rnd.randint(0, 5000))) for i in range(300)]
    left = spark.createDataFrame(lrows, "lid int, k int, t timestamp")
    right = spark.createDataFrame(rrows, "rid int, rk int, rt timestamp")
    want = []
    for lid, k, t in lrows:
        cands = [(rt, rid) for rid, rk, rt in rrows if rk == k and rt <= t]
        if cands:
            want.append((lid, max(cands)[1]))
    for bucket in ("hour", 90, None):
        got = asof_join(left, right, [("k", "rk")], "t", "rt", tiebreak=["rid"], bucket=bucket)
        assert sorted((r.lid, r.rid) for r in got.collect()) == sorted(want)


def test_asof_numeric_time_and_hot_key(spark):
    # one key holds most rows: bucketing by a numeric width spreads it
    left = spark.range(0, 5000, 7).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 5000, 10).select(F.lit(1).alias("rk"), F.col("id").alias("rt"))
    got = asof_join(left, right, ["k"] and [("k", "rk")], "t", "rt", bucket=100)
    rows = got.collect()
    assert len(rows) == left.count()
    assert all(r.rt == (r.t // 10) * 10 for r in rows)


def test_transformation_config(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (4, 40)], "id int, w int")
    fr = {"a": a, "b": b}
    src = [{"alias": "a"}, {"alias": "b"}]

    def run(join=None, agg=None):
        cfg = {"sources": src}
        if join:
            cfg["join"] = join
        if agg:
            cfg["aggregate"] = agg
        return run_transformation(spark, cfg, frames=fr)

    assert run().count() == 3  # identity: first source
    j = {"left": "a", "right": "b", "on": "a.id = b.id"}
    assert run(j).count() == 4  # left is the default
    assert run({**j, "how": "inner"}).count() == 2
    assert run({**j, "how": "right"}).count() == 3
    assert run({**j, "how": "outer"}).count() == 5
    assert run({**j, "how": "semi"}).count() == 1
    assert run({**j, "how": "anti"}).count() == 2
    assert run({**j, "how": "inner"}).columns == ["id", "v", "id_1", "w"]
    for bad in ("cross", "sideways"):
        with pytest.raises(ValueError, match="Unsupported join kind"):
            run({**j, "how": bad})
    g = run(agg={"group_by": [], "metrics": {"n": "count(*)", "s": "sum(id)"}})
    assert g.collect()[0].asDict() == {"n": 3, "s": 6}


def test_global_aggregate_on_empty_input(spark):
    e = spark.createDataFrame([], "id int")
    out = run_transformation(spark, {"sources": [{"alias": "e"}],
                                     "aggregate": {"group_by": [], "metrics": {"n": "count(*)"}}},
                             frames={"e": e}).collect()
    assert len(out) == 1 and out[0].n == 0


def test_unique_names():
    assert unique_names(["id", "x", "id", "x"]) == ["id", "x", "id_1", "x_1"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]


def test_range_join_matches_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(0, 1000)) for i in range(200)]
    rngs = []
    for j in range(50):
        lo = rnd.uniform(0, 1000)
        rngs.append((j, lo, lo + rnd.uniform(0, 120)))
    p = spark.createDataFrame(pts, "pid int, x double")
    r = spark.createDataFrame(rngs, "rid int, lo double, hi double")
    got = sorted((row.pid, row.rid) for row in range_join(p, r, "x", "lo", "hi", 50.0).collect())
    want = sorted((pid, rid) for pid, x in pts for rid, lo, hi in rngs if lo <= x < hi)
    assert got == want


def test_sql_gap_helpers(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, "c"), (2, 9, "a")],
                               "k int, v int, s string")
    first = sorted(tuple(r) for r in distinct_on(df, ["k"], ["v", "s"]).collect())
    assert first == [(1, 3, "a"), (2, 9, "a")]
    w = Window.partitionBy("k").orderBy(F.desc("v"), "s")
    top = qualify(df, F.row_number().over(w), lambda rn: rn == 1)
    assert sorted(tuple(r) for r in top.collect()) == [(1, 5, "b"), (2, 9, "a")]
    gc = df.groupBy("k").agg(group_concat("s").alias("g")).orderBy("k").collect()
    assert [r.g for r in gc] == ["a,b", "a,c"]


def _range_frames(spark, seed=7):
    rnd = random.Random(seed)
    pts = [(i, rnd.choice([None, round(rnd.uniform(0, 100), 1)])) for i in range(120)]
    rngs = []
    for j in range(40):
        lo = round(rnd.uniform(-10, 100), 1)
        rngs.append((j, lo, round(lo + rnd.choice([0.0, 0.5, 3.0, 25.0, 80.0]), 1)))
    rngs.append((99, None, 5.0))
    p = spark.createDataFrame(pts, "pid int, x double")
    r = spark.createDataFrame(rngs, "rid int, lo double, hi double")
    return pts, rngs, p, r


@pytest.mark.parametrize("how,width", [("inner", None), ("inner", 0.7), ("left", None),
                                       ("semi", 10.0), ("anti", None)])
def test_transform_range_condition_matches_brute_force(spark, how, width):
    pts, rngs, p, r = _range_frames(spark)
    join = {"left": "p", "right": "r", "how": how, "on": "r.lo <= p.x AND p.x < r.hi"}
    if width:
        join["bin_width"] = width
    out = run_transformation(spark, {"sources": [{"alias": "p"}, {"alias": "r"}],
                                     "join": join}, frames={"p": p, "r": r})
    assert not [c for c in out.columns if c.startswith("_q")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan

    def hit(x, lo, hi):
        return x is not None and lo is not None and hi is not None and lo <= x < hi
    pairs = [(pid, rid) for pid, x in pts for rid, lo, hi in rngs if hit(x, lo, hi)]
    matched = {pid for pid, _ in pairs}
    if how == "inner":
        want = sorted(pairs)
        got = sorted((r_.pid, r_.rid) for r_ in out.collect())
    elif how == "left":
        want = sorted(pairs + [(pid, None) for pid, _ in pts if pid not in matched],
                      key=lambda t: (t[0], -1 if t[1] is None else t[1]))
        got = sorted(((r_.pid, r_.rid) for r_ in out.collect()),
                     key=lambda t: (t[0], -1 if t[1] is None else t[1]))
    elif how == "semi":
        want = sorted(matched)
        got = sorted(r_.pid for r_ in out.collect())
    else:
        want = sorted(pid for pid, _ in pts if pid not in matched)
        got = sorted(r_.pid for r_ in out.collect())
    assert got == want


def test_transform_refuses_all_pairs_condition(spark):
    _, _, p, r = _range_frames(spark)
    with pytest.raises(ValueError, match="all pairs"):
        run_transformation(spark, {"sources": [{"alias": "p"}, {"alias": "r"}],
                                   "join": {"left": "p", "right": "r", "how": "inner",
                                            "on": "p.x > r.lo"}},
                           frames={"p": p, "r": r})


@pytest.mark.parametrize("on,rule", [
    ("p.x > r.lo AND p.x <= r.hi", lambda x, lo, hi: lo < x <= hi),
    ("r.hi >= p.x AND r.lo <= p.x", lambda x, lo, hi: lo <= x <= hi),
    ("r.lo < p.x AND r.hi > p.x", lambda x, lo, hi: lo < x < hi),
    ("p.x < r.hi AND r.lo <= p.x", lambda x, lo, hi: lo <= x < hi),
])
def test_range_operators_and_orders_on_bin_edges(spark, on, rule):
    # values sit exactly on bin edges (width 2.0) and on range ends
    pts = [(i, float(x)) for i, x in enumerate([0, 1, 2, 3, 4, 6, 8, 10, 2, 4])]
    rngs = [(0, 0.0, 2.0), (1, 2.0, 4.0), (2, 3.0, 3.0), (3, 4.0, 10.0), (4, 1.0, 9.0)]
    p = spark.createDataFrame(pts, "pid int, x double")
    r = spark.createDataFrame(rngs, "rid int, lo double, hi double")
    out = run_transformation(spark, {"sources": [{"alias": "p"}, {"alias": "r"}],
                                     "join": {"left": "p", "right": "r", "how": "inner",
                                              "on": on, "bin_width": 2.0}},
                             frames={"p": p, "r": r})
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((pid, rid) for pid, x in pts for rid, lo, hi in rngs if rule(x, lo, hi))
    assert sorted((row.pid, row.rid) for row in out.collect()) == want


def test_right_range_join_with_points_on_the_right(spark):
    pts, rngs, p, r = _range_frames(spark)
    out = run_transformation(spark, {"sources": [{"alias": "r"}, {"alias": "p"}],
                                     "join": {"left": "r", "right": "p", "how": "right",
                                              "on": "r.lo <= p.x AND p.x < r.hi"}},
                             frames={"p": p, "r": r})
    assert out.columns == ["rid", "lo", "hi", "pid", "x"]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()

    def hit(x, lo, hi):
        return x is not None and lo is not None and hi is not None and lo <= x < hi
    pairs = [(pid, rid) for pid, x in pts for rid, lo, hi in rngs if hit(x, lo, hi)]
    matched = {pid for pid, _ in pairs}
    key = lambda t: (t[0], -1 if t[1] is None else t[1])
    want = sorted(pairs + [(pid, None) for pid, _ in pts if pid not in matched], key=key)
    assert sorted(((row.pid, row.rid) for row in out.collect()), key=key) == want


def _instants(spark, minutes, name, id_name):
    rows = [(i, None if m is None else _t(m)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, f"{id_name} int, {name} timestamp")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "double", "decimal(12,2)"])
def test_range_join_kinds_match_brute_force(spark, kind):
    from quarry.operators.ranges import range_join
    unit = 1440 if kind == "date" else 1
    pts = [None, 0, 3, 5, 5, 17, 60, 999]
    rngs = [(0, 5), (5, 5), (3, 900), (None, 4), (2, None), (9, 1), (17, 18), (0, 2000)]
    if "time" in kind or kind == "date":
        conv = lambda m: None if m is None else _t(m * unit)
        base = "timestamp"
    else:
        conv, base = (lambda m: m), "int"
    p = spark.createDataFrame([(i, conv(m)) for i, m in enumerate(pts)], f"i int, p {base}").selectExpr("i", f"CAST(p AS {kind}) AS p")
    r = spark.createDataFrame([(j, conv(a), conv(z)) for j, (a, z) in enumerate(rngs)], f"j int, lo {base}, hi {base}")
    r = r.selectExpr("j", f"CAST(lo AS {kind}) AS lo", f"CAST(hi AS {kind}) AS hi")
    want = sorted((i, j) for i, m in enumerate(pts) for j, (a, z) in enumerate(rngs)
                  if None not in (m, a, z) and a <= m < z)
    for width in (None, 0.7 if unit == 1 else 50000.0):
        got = sorted((x.i, x.j) for x in range_join(p, r, "p", "lo", "hi", bin_width=width).collect())
        assert got == want, (kind, width)


def test_range_join_one_long_range_and_bad_bounds(spark):
    from quarry.operators.ranges import range_join
    p = spark.range(0, 2000).selectExpr("id", "CAST(id * 1000 AS DOUBLE) AS p")
    r = spark.createDataFrame([(1, 0.0, 2e6), (2, 5000.0, 5001.0)], "j int, lo double, hi double")
    got = {x.j: x.n for x in range_join(p, r, "p", "lo", "hi", bin_width=1.0).groupBy("j").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 2000, 2: 1}
    for bad in (float("inf"), float("nan")):
        r2 = spark.createDataFrame([(1, 0.0, bad), (2, 0.0, 5.0)], "j int, lo double, hi double")
        with pytest.raises(Exception, match="finite"):
            range_join(p, r2, "p", "lo", "hi").collect()
    text = r.selectExpr("j", "CAST(lo AS STRING) AS lo", "CAST(hi AS STRING) AS hi")
    with pytest.raises(ValueError, match="equality"):
        range_join(p, text, "p", "lo", "hi")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "double"])
@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_asof_forms_match_brute_force(spark, kind, op):
    import operator
    import random
    rnd = random.Random(7)
    day = 1440 if kind == "date" else 37
    draw = lambda n: [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(12)])) for i in range(n)]
    left, right = draw(40), draw(25)
    base = "int" if kind in ("int", "double") else "timestamp"
    conv = (lambda m: m) if base == "int" else (lambda m: None if m is None else _t(m * day))
    frame = lambda rows, i, k, t: spark.createDataFrame(
        [(a, b, conv(c)) for a, b, c in rows], f"{i} int, {k} string, {t} {base}").selectExpr(i, k, f"CAST({t} AS {kind}) AS {t}")
    test = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}[op]
    want = {}
    for i, k, t in left:
        fit = [(r[2] if op[0] == ">" else -r[2], r[0]) for r in right
               if None not in (k, t, r[1], r[2]) and r[1] == k and test(t, r[2])]
        want[i] = max(fit)[1] if fit else None
    lf, rf = frame(left, "i", "k", "t"), frame(right, "j", "rk", "rt")
    got = {x.i: x.j for x in asof_join(lf, rf, [("k", "rk")], "t", "rt", tiebreak=["j"], op=op, how="left").collect()}
    assert got == want
    inner = {x.i: x.j for x in asof_join(lf, rf, [("k", "rk")], "t", "rt", tiebreak=["j"], op=op).collect()}
    assert inner == {i: j for i, j in want.items() if j is not None}


def test_asof_widens_and_refuses(spark):
    a = spark.createDataFrame([(1, 10)], "k int, t int")
    b = spark.createDataFrame([(1, 9)], "rk int, rt long")
    assert asof_join(a, b, [("k", "rk")], "t", "rt").collect()[0].rt == 9
    with pytest.raises(TypeError, match="differ"):
        asof_join(a, b.withColumn("rt", F.current_timestamp()), [("k", "rk")], "t", "rt")
    with pytest.raises(ValueError, match="comparison"):
        asof_join(a, b, [("k", "rk")], "t", "rt", op="=")
