"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes.  Chunk ends are *normalised*:
a strict mask decides up to the normal size, a loose one after it, between a
least and a greatest size, so chunk sizes stay close to the normal one.  As
the hash sees 32 bytes, an edit changes the chunks around it and boundaries
fall in step again.  A fingerprint is the set of chunk digests, each weighted
by the bytes it covers; the likeness of a text to another is the weight of
its chunks found in the other (containment).

To compare each document with the next (descending id), documents are dealt
to id ranges and streamed in order; each range is closed by the first
document of the range after it, so texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_width, small_batches, staged, text_or_empty
from quarry.llm.shingles import _power, mix

LEAST, NORMAL, MOST = 12, 40, 160
STRICT_BITS, LOOSE_BITS = 7, 4
REACH = 32
_U = np.uint64
_rng = np.random.default_rng(777)
GEAR = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rolled(values: np.ndarray) -> np.ndarray:
    """Gear hashes of the last 32 values at every place, by doubling."""
    h, width = values, 1
    while width < REACH:
        more = h.copy()
        more[width:] += h[:-width] << _U(width)
        h, width = more, 2 * width
    return h


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct chunk digests, sorted; bytes they cover) of every text."""
    lens = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * REACH
    data = np.frombuffer(gap.join(texts), np.uint8)
    first = np.cumsum(lens + REACH) - (lens + REACH)
    values = GEAR[data]
    for f, n in zip(first[:-1], lens[:-1]):
        values[f + n: f + n + REACH] = 0  # a text never sees the one before it
    if not len(data):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    h = _rolled(values) >> _U(8)
    loose_at = np.flatnonzero((h & _U((1 << LOOSE_BITS) - 1)) == 0)
    strict = (loose_at[(h[loose_at] & _U((1 << STRICT_BITS) - 1)) == 0] + 1).tolist()
    loose = (loose_at + 1).tolist()
    far = len(data) + MOST + 1
    strict.append(far)
    loose.append(far)
    cuts, counts = [], np.zeros(len(texts), np.int64)
    for d, (at, n) in enumerate(zip(first.tolist(), lens.tolist())):
        end, had = at + n, len(cuts)
        while at < end:
            cut = strict[bisect_left(strict, at + LEAST)]
            if cut > at + NORMAL:
                cut = min(loose[bisect_left(loose, at + NORMAL)], at + MOST)
            at = min(cut, end)
            cuts.append(at)
        counts[d] = len(cuts) - had
    ends = np.array(cuts, np.int64)
    starts = np.empty_like(ends)
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(ends):
        starts[1:] = ends[:-1]
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        starts[new] = first[owner[new]]
    power, inverse = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power, dtype=np.uint64)])
    digest = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64), 51) >> _U(24)
    out, at = [], np.concatenate([[0], np.cumsum(counts)])
    for d in range(len(texts)):
        s = slice(at[d], at[d + 1])
        keys, back = np.unique(digest[s], return_inverse=True)
        out.append((keys, np.bincount(back, ends[s] - starts[s], minlength=len(keys)).astype(np.int64)))
    return out


def spell(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as text: digest:bytes, by digest, comma-joined; the
    empty text's is empty."""
    return ",".join([f"{k:010x}:{w}" for k, w in zip(print_[0].tolist(), print_[1].tolist())])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of a's weight whose chunks b has too; two empty texts are alike."""
    if not len(a[0]):
        return float(not len(b[0]))
    return float(a[1][np.isin(a[0], b[0], assume_unique=True)].sum() / a[1].sum())


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ordered(docs: DataFrame) -> DataFrame:
    """(_bucket, _tail, doc_id, text): every range of ids in descending order,
    closed by the first document of the next range (the last range by the
    first document of all)."""
    width = 4 * shuffle_width(docs.sparkSession)
    rows = docs.withColumn("_h", F.xxhash64("text"))
    marks = rows.agg(F.percentile_approx("doc_id", [i / width for i in range(1, width)], 20 * width)).first()[0]
    bounds = np.array(sorted(set(marks or [])), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(bounds, ids.fillna(0).astype("int64"), "right")).astype("int32"))

    rows = rows.withColumn("_bucket", bucket("doc_id"))
    order = F.struct("doc_id", (-F.col("_h")).alias("_h"))
    firsts = rows.groupBy("_bucket").agg(F.max(order).alias("_first"))
    firsts = staged(firsts.select("_bucket", F.col("_first.doc_id").alias("_id"), (-F.col("_first._h")).alias("_fh")), "print-firsts")
    by = Window.orderBy("_bucket")  # one row per range
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.struct("_id", "_fh")).over(every)
    closing = firsts.select("_bucket", F.coalesce(F.lag(F.struct("_id", "_fh")).over(by), last).alias("_n"))
    closing = closing.select(F.col("_bucket").alias("_to"), F.col("_n._id").alias("_id"), F.col("_n._fh").alias("_fh"))
    # as many rows as ranges, a number fixed before: small enough to send to every task
    tails = rows.join(F.broadcast(closing), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_fh")))
    tails = tails.dropDuplicates(["_to"]).select(F.col("_to").alias("_bucket"), F.lit(1).alias("_tail"), "doc_id", "text", "_h")
    both = rows.select("_bucket", F.lit(0).alias("_tail"), "doc_id", "text", "_h").unionAll(tails)
    both = both.repartition(shuffle_width(docs.sparkSession), "_bucket")
    return both.sortWithinPartitions("_bucket", "_tail", F.col("doc_id").desc_nulls_last(), "_h").drop("_h")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, the fingerprint of its text, of its edited
    text (its last third replaced by the start of the next document), and
    near_edited and near_next: its likeness to the edited text and to the
    next document.

    Null texts are empty: fingerprint "", 0 characters.  Rows with equal ids
    follow one another by their text's hash; null ids come last, as one
    range.  A single row is followed by itself.  Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, still without its next one
        for b in small_batches(batches, "text", 1 << 20):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("_bucket", "_tail", "doc_id", "text"))))
            if held:
                rows.insert(0, held)
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1]]
            held = rows[-1]
            if not pairs:
                continue
            assert all(x[0] == y[0] for x, y in pairs)
            new = [edited(x[3], y[3]) for x, y in pairs]
            raw = [t.encode() for t in new]
            texts = chunks([r[3].encode() for r in rows])
            own = [p for p, r in zip(texts, rows[:-1]) if not r[1]]
            following = [q for q, r in zip(texts[1:], rows[:-1]) if not r[1]]
            changed = chunks(raw)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([spell(p) for p in own]), pa.array([spell(p) for p in changed]),
                pa.array([likeness(p, q) for p, q in zip(own, changed)], pa.float64()),
                pa.array([likeness(p, q) for p, q in zip(own, following)], pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return _ordered(texts).mapInArrow(run, OUT)
