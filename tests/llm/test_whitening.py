"""Whitening against numpy's dense eigensolver and exact integers."""

import math

import numpy as np
import pytest

from quarry.llm import common, queries, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def dense(rows, components=8):
    """(id, x) rows -> {(id, deviation): whitened up to sign}, explained."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviations, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def held(got, rows, components=8):
    deviations, white, explained = dense(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert sorted(by) == list(range(1, len(explained) + 1))
    assert len(got) == len(rows) * len(explained)
    for k, found in by.items():
        y = [(found[(i, d)][0]["whitened"], white[j, k - 1]) for j, ((i, _), d) in enumerate(zip(rows, deviations))]
        a, b = np.array(y).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        one = next(iter(found.values()))[0]
        assert one["n"] == len(rows) and abs(one["explained"] / explained[k - 1] - 1) < 1e-9 and one["identity_error"] < 1e-9


def test_whole_table_equals_dense_eigenvectors(spark):
    df = queries.table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    held(queries.op13_whitening(spark, SF).collect(), rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(3)
    good = [(i, [float(c) for c in r.standard_normal(5) * (5 - np.arange(5))]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [2.0**43, 0.0, 0.0, 0.0, 0.0])]
    rows = good + [good[0], (None, good[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, n int, whitened double, id string")
    held(whitening.whiten(df, components=4).collect(), rows, 4)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 3")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).count() == 0


def test_rank_deficient_and_huge_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-6
    far = [(i, [float(i) * 2**38, float(i % 2)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("dim,want", [(1, 8), (3, 8), (9, 8), (40, 5), (120, 8)])
def test_solver(dim, want):
    a = np.random.default_rng(dim).standard_normal((dim, 2 * dim))
    for v in (a @ a.T, np.eye(dim), np.diag(np.r_[[5.0] * min(dim, 3), np.ones(max(0, dim - 3))])):
        values, vectors, residuals = whitening.jacobi_davidson(lambda w: v @ w, dim, want)
        top = np.linalg.eigvalsh(v)[::-1][: min(dim, want)]
        assert np.abs(values - top).max() < 1e-12 * top[0] and residuals.max() < 1e-12 * top[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(top))).max() < 1e-13


def test_minres_solves():
    a = np.random.default_rng(1).standard_normal((12, 12))
    v, b = a + a.T, np.random.default_rng(2).standard_normal((12, 3))
    assert np.abs(v @ whitening.minres(lambda w: v @ w, b, 40, 1e-13) - b).max() < 1e-8
