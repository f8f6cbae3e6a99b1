"""Ranks, frames and quantiles of huge partitions against windows and lists."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.quantiles import exact_quantiles, sketch_quantiles
from quarry.operators.ranks import distributed_frames, distributed_ranks, distributed_running

ALL = {"rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist"}


def _rows(seed, n=600):
    """A third of the rows are one key, some partitions are tiny or null."""
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "a", "a", "b", None]) if i % 50 else f"p{i}", 7 if i % 3 == 0 else rnd.choice([None, *range(12)]), rnd.choice(["x", "y", None])) for i in range(n)]


@pytest.mark.parametrize("seed,order,ranges", [(1, ["k"], 8), (2, ["k DESC", "t NULLS LAST"], 5), (3, ["t", "`k` desc nulls first"], 1), (4, ["k ASC NULLS LAST"], 40)])
def test_ranks_equal_the_window_functions(spark, seed, order, ranges):
    from quarry.operators.ranks import sort_terms
    df = spark.createDataFrame(_rows(seed), "i int, g string, k int, t string")
    w = Window.partitionBy("g").orderBy(*sort_terms(order)[0])
    want = df.select("i", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.cume_dist().over(w))
    got = distributed_ranks(df, ["g"], order, ALL, ranges).select("i", *ALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("tiles", [1, 4, 1000])
def test_row_numbers_and_tiles(spark, tiles):
    df = spark.createDataFrame(_rows(5), "i int, g string, k int, t string")
    w = Window.partitionBy("g").orderBy("k", "i")
    want = df.select("i", F.row_number().over(w), F.ntile(tiles).over(w))
    got = distributed_ranks(df, ["g"], ["k", "i"], {"rn": "row_number", "nt": ("ntile", tiles)}, 9)
    assert sorted((r["i"], r["rn"], r["nt"]) for r in got.collect()) == sorted(map(tuple, want.collect()))
    ties = distributed_ranks(df, [], ["k"], {"rn": "row_number", "_q0": "rank"}, 9).collect()  # equal keys: numbers of their own
    assert sorted(r["rn"] for r in ties) == list(range(1, 601)) and all(a["_q0"] <= a["rn"] for a in ties)
    with pytest.raises(ValueError):
        distributed_ranks(df, ["g"], ["k"], {"x": "median"})
    assert distributed_ranks(df.limit(0), ["g"], ["k"], ALL).count() == 0


def test_one_tie_over_many_ranges_is_cut(spark):
    df = spark.range(4000).selectExpr("id AS i", "1 AS g", "IF(id < 3000, 5, id) AS k")
    got = distributed_ranks(df, ["g"], ["k"], {"rk": "rank", "cd": "cume_dist"}, 16)
    assert {(r["rk"], r["cd"]) for r in got.where("k = 5").collect()} == {(1, 0.75)}
    from quarry.operators.ranks import _dealt
    assert _dealt(df, ["g"], ["k"], 16, "r").groupBy("r").count().agg(F.max("count")).first()[0] < 600


@pytest.mark.parametrize("before,after", [(2, 1), (0, 0), (40, 3), (1, -1), (-2, 2), (-3, 5), (0, 30)])
def test_frames_take_rows_of_their_neighbours(spark, before, after):
    df = spark.createDataFrame(_rows(6, 300), "i int, g string, k int, t string")
    w = Window.partitionBy("g").orderBy("k", "i").rowsBetween(-before, after)
    cols = {"s": F.sum("k"), "n": F.count(F.lit(1)), "f": F.min("i")}
    want = df.select("i", *(c.over(w) for c in cols.values()))
    got = distributed_frames(df, ["g"], ["k", "i"], cols, before, after, block_rows=7, ranges=5)
    assert sorted(map(tuple, got.select("i", *cols).collect())) == sorted(map(tuple, want.collect()))


def test_running_aggregates(spark):
    df = spark.createDataFrame(_rows(8, 400), "i int, g string, k int, t string")
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("i", F.sum("k").over(w), F.count("k").over(w), F.min("k").over(w), F.max("k").over(w))
    got = distributed_running(df, ["g"], ["i"], "k", {"a": "sum", "b": "count", "c": "min", "d": "max"}, block_rows=11)
    assert sorted(map(tuple, got.select("i", "a", "b", "c", "d").collect())) == sorted(map(tuple, want.collect()))


def _values(seed, n):
    rnd = random.Random(seed)
    draw = [lambda: 5.0, lambda: rnd.gauss(0, 1), lambda: rnd.gauss(0, 1) * 10.0 ** rnd.randint(-200, 200), lambda: float(rnd.randint(0, 4)), lambda: None, lambda: float("nan")]
    return [(rnd.choice(["a", "a", "b", None]), rnd.choice(draw)()) for _ in range(n)] + [("only null", None), ("one", 3.0)]


@pytest.mark.parametrize("seed,edges,small,continuous", [(1, 4, 1, True), (2, 16, 20, True), (3, 128, 4096, True), (4, 8, 3, False), (5, 2, 1, False)])
def test_quantiles_equal_sorted_lists(spark, seed, edges, small, continuous):
    rows, probs = _values(seed, 500), [0.0, 0.013, 0.25, 0.5, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, n double")
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, ["k"], "n", probs, continuous, edges, small).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    how = "linear" if continuous else "inverted_cdf"
    assert set(got) == {(k, p) for k in by for p in probs}
    for (k, p), q in got.items():
        assert q == pytest.approx(np.quantile(by[k], p, method=how), rel=1e-9, abs=1e-300)


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.range(10_001).selectExpr("id AS v", "id % 3 AS p")
    assert {r["p"]: r["q"] for r in exact_quantiles(df, [], "v", [0.5, 0.999], edges=16, small=50).collect()} == {0.5: 5000.0, 0.999: 9990.0}
    assert exact_quantiles(df, ["p"], "v", [0.0], names=("prob", "q")).count() == 3
    assert exact_quantiles(df.limit(0), ["p"], "v", [0.5], names=("prob", "q")).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "v", [1.5])


@pytest.mark.parametrize("error", [0.05, 0.002])
def test_sketch_keeps_its_error(spark, error):
    df = spark.range(40_000, numPartitions=7).selectExpr("id % 2 AS g", "CAST((id * 7919) % 40000 AS DOUBLE) AS v")
    for r in sketch_quantiles(df, ["g"], "v", [0.01, 0.5, 0.77], error).collect():
        assert abs(r["q"] - r["p"] * 40_000) <= 2 * (error * 20_000 + 1)  # ranks are 2 apart
