"""Recursion by path doubling and semi-naive rounds."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.recursion import ancestors, reachable, recurse


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.range(10_001).selectExpr("id AS n", "IF(id = 0, NULL, id - 1) AS up")
    got = ancestors(chain, "n", "up")
    assert got.where("root = 0 AND depth = node").count() == 10_001


def test_forests_match_walking_up(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, rnd.randint(0, i - 1), 0, 9999]) if i else None) for i in range(300)]
    up = dict(rows)

    def walk(i):
        depth = 0
        while up[i] in up:
            i, depth = up[i], depth + 1
        return i, depth

    got = {r["node"]: (r["root"], r["depth"]) for r in ancestors(spark.createDataFrame(rows, "node int, at int"), "node", "at").collect()}
    assert got == {i: walk(i) for i, _ in rows}
    assert ancestors(spark.createDataFrame([], "n int, p int"), "n", "p").count() == 0


def test_contracted_forests_match_walking_up(spark, monkeypatch):
    from quarry.operators import recursion as m
    monkeypatch.setattr(m, "DOUBLED", 20, raising=False)
    sizes, staged = [], m._staged

    def counting(df, name):
        out = staged(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(m, "_staged", counting)
    rnd = random.Random(6)
    rows = [(i, i - 1 if i % 50 else None) for i in range(300)] + [(i, rnd.choice([None, rnd.randint(300, i - 1), 300])) for i in range(301, 400)] + [(300, 999)]
    rnd.shuffle(rows)
    up = dict(rows)

    def walk(i):
        depth = 0
        while up[i] in up:
            i, depth = up[i], depth + 1
        return i, depth

    got = ancestors(spark.createDataFrame(rows, "node int, at long"), "node", "at")
    assert got.schema["root"].dataType.simpleString() == "bigint"
    assert {r["node"]: (r["root"], r["depth"]) for r in got.collect()} == {i: walk(i) for i, _ in rows}
    assert sum(sizes) < 8 * len(rows)  # rows staged in all: not the input once a round
    with pytest.raises(ValueError, match="cycle"):
        ancestors(spark.createDataFrame([(i, i ^ 1) for i in range(100)], "n int, p int"), "n", "p")


@pytest.mark.parametrize("rows", [[(1, 2), (2, 1)], [(1, 1)], [(1, None), (1, None)], [(None, 1)]])
def test_cycles_and_repeated_nodes_fail(spark, rows):
    with pytest.raises(ValueError):
        ancestors(spark.createDataFrame(rows, "n int, p int"), "n", "p")


def test_reachable_matches_search(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 30), rnd.choice([None, rnd.randint(0, 30)])) for _ in range(45)] + [(50 + i, 51 + i) for i in range(20)]
    out = {}
    for a, b in edges:
        if b is not None:
            out.setdefault(a, set()).add(b)
    want = set()
    for a in out:
        todo, seen = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        want |= {(a, x) for x in seen}
    got = reachable(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rounds_past_a_hundred_and_a_million_rows(spark):
    step = lambda d: d.where("k < 130").selectExpr("k + 1", "v")
    base = spark.range(3).selectExpr("0 AS k", "id AS v")
    assert recurse(base, step, distinct=False).groupBy("k").count().agg(F.count("*"), F.min("count"), F.max("count")).first()[:] == (131, 3, 3)
    doubled = lambda d: d.where("k < 20").selectExpr("k + 1", "v * 2").unionAll(d.where("k < 20").selectExpr("k + 1", "v * 2 + 1"))
    assert recurse(spark.createDataFrame([(0, 0)], "k int, v int"), doubled, distinct=False).count() == 2**21 - 1
    with pytest.raises(ValueError, match="goes on"):
        recurse(base, step, distinct=False, most_rounds=5)


def test_union_ends_on_cycles_and_keeps_nulls_apart(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], "a int, b int")
    base = spark.createDataFrame([(1,), (1,)], "x int")
    got = recurse(base, lambda d: d.join(edges, F.col("x") == F.col("a")).select("b"))
    assert sorted((r["x"] for r in got.collect()), key=str) == [1, 2, 3, None]
