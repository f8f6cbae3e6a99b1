"""Removal of repeated passages against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, queries, substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def brute(rows, size):
    """(doc_id, n_words, n_removed, kept words) of every row."""
    found, first = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k: k + size]) for k in range(len(w) - size + 1)]
        found.append((i, w, windows))
        if i is not None:
            for x in windows:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w, windows in found:
        gone = set()
        for k, x in enumerate(windows):
            if i is not None and first[x] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def kept(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def small_corpus(seed):
    """Few words, shared passages, copies, repeats inside a document."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    passages = [words(r.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "\n\t ".join(r.choice([words(r.randint(0, 12)), r.choice(passages)]) for _ in range(r.randint(0, 5)))
        rows.append((r.choice([i, i, i, i // 3, -i]), t))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (None, passages[0]), (None, passages[0]), (502, None), (503, ""), (504, " \t\n"),
                   (505, passages[1] + " " + passages[1]), (506, " ".join(passages) + " " + words(2000))]


@pytest.mark.parametrize("seed,size,group", [(1, 10, 1 << 17), (2, 8, 3), (3, 9, 1), (4, 4, 20), (5, 1, 2)])
def test_small_corpora_equal_brute_force(spark, seed, size, group):
    rows = small_corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fid int, kept string").repartition(3)
    assert kept(substring_dedup.dedup(docs, words=size, group=group, file_bytes=2000)) == brute(rows, size)


def test_whole_table_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    text = docs.filter("doc_id = 5").first()["text"]
    more = spark.createDataFrame([(10**6, text), (10**6, text), (10**6 + 1, "Front " + text + " back"), (-1, "x " * 3000), (-1, "x " * 60), (0, "x " * 70)], docs.schema)
    both = docs.unionAll(more)
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = brute(rows, 50)
    assert kept(substring_dedup.dedup(both, file_bytes=50_000)) == want and sum(r[2] > 0 for r in want) > 5
    got = sorted(map(tuple, queries.op11_substring_dedup(spark, SF).collect()))
    assert got == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50))]


def test_spans_name_the_removed_words(spark):
    rows = [(1, " ".join(map(str, range(40)))), (2, "a b " + " ".join(map(str, range(5, 30))) + " c " + " ".join(map(str, range(12))))]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=10).collect()}
    assert got[1]["spans"] == [] and [tuple(s) for s in got[2]["spans"]] == [(2, 27), (28, 40)] and got[2]["kept"] == "a b c"


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    rows = small_corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    work = substring_dedup.judged_files(substring_dedup.write_files(docs, common.scratch_path(spark, "t"), words=9), 9)
    path, n = (r := work.first())["file"], sorted(r["docs"], key=lambda d: d["idx"])
    judged = np.array([d["state"] == 1 for d in n])
    whole = substring_dedup.Words(path, 9)
    one = [(c.at + c.here, c.anchors(), c.blocks(np.arange(len(c.here)))) for c in whole.chunks(judged)]
    monkeypatch.setattr(substring_dedup, "STEP", 7)
    many = [(c.at + c.here, c.anchors(), c.blocks(np.arange(len(c.here)))) for c in whole.chunks(judged)]
    for k in range(3):
        assert (np.concatenate([x[k] for x in one]) == np.concatenate([x[k] for x in many])).all()


def test_crowded_prefixes_get_longer(spark):
    rows = [(1, 1, 1, 1)] * 5 + [(1, 1, 1, 2)] * 2 + [(1, 2, 1, 1)] * 3 + [(2, 1, 1, 1)]
    df = spark.createDataFrame([(*r, i, 0, 0) for i, r in enumerate(rows)], ", ".join(f"{c} long" for c in [*substring_dedup.EDGES, "lo", "fid", "place"]))
    depth = {r: {x["prefix"] for x in substring_dedup.with_prefix(df, substring_dedup.crowded_prefixes(df, 3)).filter(" AND ".join(f"b{k} = {v}" for k, v in enumerate(r, 1))).collect()} for r in set(rows)}
    assert depth == {(1, 1, 1, 1): {5}, (1, 1, 1, 2): {4}, (1, 2, 1, 1): {2}, (2, 1, 1, 1): {1}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(empty).count() == 0
    assert substring_dedup.dedup(empty.unionAll(spark.createDataFrame([(1, None)], empty.schema))).select(F.col("kept")).collect()[0][0] == ""
