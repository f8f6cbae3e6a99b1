"""Alignment of two tokenizers against a per-text brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common, queries, token_alignment

SF = "/root/testdata/sf0.001"
A, B = (queries.tokenizer_path(n) for n in (queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER))
ODD = [None, "", " ", "  ", "a  b", "x　  y z", "x   y", "x   y", "\n a", "a  \n  b", "tab\t  b", "<s> </s><unk>", "<|endoftext|> a", "a▁b c", "fine words",
       "a\x1c  b\x85  c", "\x00 \x7f  x", "ﬁ Ａ ½", " lead", "trail  ", "one ", "é x", "don't  've I'll", "﻿ a", "日本語 テスト  です", "🙂🙂 👩‍👩‍👧 x", "word " * 3000, "z" * 5000, "  ▁", "fine words"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def brute(texts):
    """Rows without ids, text by text, with the tokenizers on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = token_alignment.byte_of_letter()
    found, counts = [], collections.Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        raw = (" " + t).encode()
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != raw or b"".join(tb) != raw:
            found.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ta]), np.cumsum([len(x) for x in tb])
        links, j = [], 0
        for i, end in enumerate(ea):
            while True:
                links.append((ia[i], ib[j]))
                if eb[j] >= end:
                    j += eb[j] == end
                    break
                j += 1
        both = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups, x, y = [], 0, 0
        for end in both:
            p, q = int(np.searchsorted(ea, end)) + 1, int(np.searchsorted(eb, end)) + 1
            groups.append(",".join(map(str, ia[x:p])) + "|" + ",".join(map(str, ib[y:q])))
            x, y = p, q
        found.append((len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(set(links))
    top = collections.defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(counts[x] == top[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]


def test_whole_table_and_odd_texts_equal_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, "tie")], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.unionAll(odd).collect()]
    got = token_alignment.align(docs.unionAll(odd), A, B, shard_bytes=100_000, segment_keys=500).collect()
    want = brute([t for _, t in rows])
    assert sorted(map(tuple, got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    assert sum(w[0] == 0 for w in want) >= 4 and sum(w[0] > 0 for w in want) > 200


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op12_token_alignment(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def test_tables_without_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(empty, A, B).count() == 0
    none = spark.createDataFrame([(1, None, 2, "u"), (1, "", 2, "u"), (None, "▁", 3, "v")], "doc_id long, text string, n_a int, file string")
    assert sorted(map(tuple, token_alignment.align(none, A, B).collect()), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(None, 0, 0, 0, 0, 0, 0, "")], key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 70_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**48, n))
    h = token_alignment.PerfectHash.build(keys[::-1])
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    strangers = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 2**48, 500), keys)
    assert (h.index(strangers) == -1).all()


def test_units_begin_at_spaces_after_other_characters():
    data = np.frombuffer(" ab  c\n d　 e é f".encode(), np.uint8)
    at = token_alignment.unit_starts(data, np.array([0]))
    assert [bytes(x).decode() for x in np.split(data, at[1:])] == [" ab", "  c\n d　 e", " é", " f"]


def test_align_marks_units_that_do_not_round_trip():
    t = token_alignment.Pair(A, B).align(pa.array([" a", " ▁", " b"]))
    assert t["ok"].to_pylist() == [True, False, True] and t["n_a"].to_pylist() == [1, 0, 1] and t["text"].to_pylist()[1] == ""
