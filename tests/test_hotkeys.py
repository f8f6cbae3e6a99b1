"""Joins with hot keys against Spark's own joins."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.hotkeys import heavy_hitters, hot_key_join

LEFT, RIGHT = "k int, t string, _h string, salts int", "k int, t string, ls_salt int"


def _sides(spark, seed, hot_left, hot_right, n=400):
    """A third of each side's rows are its hot key (which may be null or stand on one side only)."""
    rnd = random.Random(seed)
    key = lambda hot: hot if rnd.random() < 0.34 else rnd.choice([None, *range(2, 60)])
    text = lambda: rnd.choice(["a", "b", None])
    a = [(key(hot_left), text(), rnd.choice(["x", None]), i // 2) for i in range(n)]
    b = [(key(hot_right), text(), i) for i in range(n // 4)]
    return spark.createDataFrame(a + a[:9], LEFT), spark.createDataFrame(b + b[:5], RIGHT)


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full_outer"])
@pytest.mark.parametrize("hot", [(1, 1), (1, 7), (1, -1), (None, 1), (None, None)])
def test_hot_key_join_equals_the_plain_join(spark, how, hot):
    a, b = _sides(spark, 3, *hot)
    for on in ([("k", "k")], [("k", "k"), ("t", "t")]):
        cond = [a[x] == b[y] for x, y in on]
        want = a.join(b, cond, {"full_outer": "full"}.get(how, how))
        got = hot_key_join(a, b, on, how, parts=20)
        assert got.columns == want.columns
        assert _rows(got) == _rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_empty_sides(spark, how):
    a, b = _sides(spark, 4, 1, 1, 40)
    for x, y in ((a.filter("false"), b), (a, b.filter("false")), (a.filter("false"), b.filter("false"))):
        assert _rows(hot_key_join(x, y, [("k", "k")], how, parts=4)) == _rows(x.join(y, x["k"] == y["k"], how))


def test_heavy_hitters_are_counted_exactly(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, -2).otherwise(F.col("id")).alias("k"))
    want = df.groupBy("k").count().where("count > 300").collect()
    assert sorted((r["k"], r["n"]) for r in heavy_hitters(df, ["k"], 100).collect()) == sorted(map(tuple, want))


def test_a_hot_key_is_spread_over_tasks(spark):
    """No task of the join's output holds much more than its share of the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
        b = spark.range(0, 40_000, 5).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
        per = lambda df: max(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())
        plain, spread = a.join(b, a["k"] == b["k"], "full"), hot_key_join(a, b, [("k", "k")], "full", parts=200)
        assert plain.count() == spread.count()
        assert per(plain) > 13_000 and per(spread) < 9_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_kinds(spark):
    a, b = _sides(spark, 5, 1, 1, 8)
    with pytest.raises(ValueError, match="hot keys"):
        hot_key_join(a, b, [("k", "k")], "semi")
