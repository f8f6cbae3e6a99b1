"""N-gram Jaccard join as a blocked sparse matrix product.

The document-by-n-gram incidence matrix times its transpose holds the
overlap of every two documents.  Only entries of at least the overlap that
75 % similarity asks of the two sizes matter, so it is formed by blocks:

1. *Rows*: documents of equal shingle sets are one class (one matrix row).
2. *Column order*: every column (shingle) is counted over all documents, 4
   bytes each.  Two bitmaps of fixed size say "in two documents or more" and
   "in ``HEAVY`` or more"; columns of one document come first, heavy ones
   last, each by hash.  Any such order is right; the counts only make it
   cheap: a row with a quarter of columns of its own has nothing to join.
3. *Prefix block*: two similar rows share a column among the first
   n - ceil(0.75 n) + 1 of either, so only those columns are joined, minus
   columns of one document.  A pair goes on if its sizes, the places of the
   shared column in both rows, and the parity bitmaps of both rows (a lower
   bound of their difference) leave room for the overlap it needs.
4. *Remaining block*: for the surviving pairs alone the whole rows are
   joined and their exact overlap is counted.

To avoid all pairs of a large group, the prefix block is joined in rounds:
first each row against one row of its column and size band, then again those
that share a column but not yet a component, then all rows that share a
column but not a component.  A link between rows of one component changes
nothing, so components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BATCH_ROWS, BLANKS, batch_rows, row_key, shuffle_width, small_batches, staged, unused
from quarry.llm.components import components
from quarry.llm.shingles import least_difference, mix, parity_bitmap, set_digests, shingle_sets

SIZE = 5
PERCENT = 75
HEAVY = 64
SHARED_BITS, HEAVY_BITS = 27, 23  # log2 of the bitmaps' bits: 16 MB, 1 MB
FLUSH = 1 << 19
PIECE = 1 << 20
_U = np.uint64


# ---------------------------------------------------------------- bitmaps of fixed size
def _bloom_bits(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    return np.concatenate([(mix(keys, 41 + k) & _U((1 << bits) - 1)) for k in range(hashes)]).astype(np.int64)


def _packed(at: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(1 << bits, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _column_counts(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bitmap of columns in >= 2 documents, of those in >= HEAVY, log2 of
    the number of column blocks).  A block is a range of hashes; it is counted
    in one task, as 32-bit remainders, and fills its own part of the bitmaps,
    so their size is fixed and the driver gets only them."""
    blocks = min(1 << 16, 1 << max(4, math.ceil(math.log2(8 * shuffle_width(docs.sparkSession)))))
    top = int(math.log2(blocks))
    shared_bits, heavy_bits = SHARED_BITS - top, max(3, HEAVY_BITS - top)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            cols, times = np.unique(np.concatenate(held) >> _U(32 - top), return_counts=True)
            cut = np.searchsorted(cols >> _U(32), np.arange(blocks + 1, dtype=np.uint64))
            low = cols.astype(np.uint32)
            once = times == 1
            pick = [(slice(a, z)) for a, z in zip(cut, cut[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(blocks), pa.int32()), pa.array([low[s][once[s]].tobytes() for s in pick], pa.binary()),
                 pa.array([low[s][~once[s]].tobytes() for s in pick], pa.binary()),
                 pa.array([times[s][~once[s]].astype(np.uint32).tobytes() for s in pick], pa.binary())], ["block", "once", "many", "times"])

        for b in small_batches(batches, "_t", PIECE):
            hashes, _ = shingle_sets(b.column("_t"), size)
            held.append(hashes)
            n += len(hashes)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(pdf["once"]), np.uint32)
        many, times = np.frombuffer(b"".join(pdf["many"]), np.uint32), np.frombuffer(b"".join(pdf["times"]), np.uint32)
        cols, back = np.unique(np.concatenate([once, many]), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.ones(len(once)), times]), minlength=len(cols))
        cols = cols.astype(np.uint64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])],
                             "shared": [_packed(_bloom_bits(cols[total >= 2], shared_bits, 3), shared_bits)],
                             "heavy": [_packed(_bloom_bits(cols[total >= HEAVY], heavy_bits, 2), heavy_bits)]})

    counted = (docs.mapInArrow(emit, "block int, once binary, many binary, times binary")
               .groupBy("block").applyInPandas(count, "block int, shared binary, heavy binary"))
    shared = np.zeros((blocks, 1 << (shared_bits - 3)), np.uint8)
    heavy = np.zeros((blocks, 1 << (heavy_bits - 3)), np.uint8)
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        for r in counted.toLocalIterator():  # 17 MB in all, whatever the input
            shared[r["block"]], heavy[r["block"]] = np.frombuffer(r["shared"], np.uint8), np.frombuffer(r["heavy"], np.uint8)
    return shared, heavy, top


def _in_blocks(bitmaps: np.ndarray, hashes: np.ndarray, top: int, n: int) -> np.ndarray:
    """Membership of hashes in the bitmap of their column block."""
    bits = int(math.log2(bitmaps.shape[1])) + 3
    block = (hashes >> _U(64 - top)).astype(np.int64)
    low = (hashes >> _U(32 - top)) & _U(0xFFFFFFFF)
    out = np.ones(len(hashes), bool)
    for k in range(n):
        at = (mix(low, 41 + k) & _U((1 << bits) - 1)).astype(np.int64)
        out &= (bitmaps[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


# ---------------------------------------------------------------- the matrix's rows
def _classes(docs: DataFrame, size: int) -> DataFrame:
    """Every document (_id, and _key where there is one) with its set's size
    and digest, staged."""
    more = [c for c in docs.columns if c not in ("_id", "_t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "_t", PIECE):
            hashes, sizes = shingle_sets(b.column("_t"), size)
            digest = set_digests(hashes, sizes)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array([d.tobytes() for d in digest], pa.binary()),
                                              *[b.column(c) for c in more]], ["doc_id", "n_shingles", "cls", *more])

    kinds = "doc_id long, n_shingles long, cls binary" + "".join(f", {c} string" for c in more)
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return staged(docs.mapInArrow(run, kinds), "jaccard-classes")


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per class that has a shared column in its prefix: cls, n, its
    parity bitmap, all its columns (``row``), those of the prefix with their places in the row's order, and a
    number ``rid`` that stands for the class from here on."""
    shared_map, heavy_map, top = _column_counts(docs, size)
    maps = docs.sparkSession.sparkContext.broadcast((shared_map, heavy_map))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_of, heavy_of = maps.value
        done: set[bytes] = set()
        for b in small_batches(batches, "_t", PIECE):
            hashes, sizes = shingle_sets(b.column("_t"), size)
            if not len(hashes):
                continue
            shared, heavy = _in_blocks(shared_of, hashes, top, 3), _in_blocks(heavy_of, hashes, top, 2)
            out, ends = [], np.cumsum(sizes)
            for d, digest in enumerate(set_digests(hashes, sizes)):
                n, key = int(sizes[d]), digest.tobytes()
                if not n or key in done:
                    continue
                done.add(key)
                row = slice(ends[d] - n, ends[d])
                order = np.argsort(shared[row] * (1 + heavy[row]), kind="stable")[: prefix_length(n, percent)]
                place = np.flatnonzero(shared[row][order])
                if len(place):
                    out.append((key, n, parity_bitmap(hashes[row]), hashes[row].tobytes(), hashes[row][order[place]].astype(np.int64), place))
            if out:
                lens = np.cumsum([0] + [len(o[4]) for o in out]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([o[i] for o in out]).astype(k)))
                         for i, k in ((4, np.int64), (5, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary()), *lists],
                                                 ["cls", "n", "bitmap", "row", "cols", "places"])

    rows = docs.mapInArrow(run, "cls binary, n long, bitmap binary, row binary, cols array<long>, places array<int>")
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return staged(rows.dropDuplicates(["cls"]).withColumn("rid", F.monotonically_increasing_id()), "jaccard-prefixes")


# ---------------------------------------------------------------- pairs
def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap that makes sets of these sizes similar enough."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def _bounded(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb) whose parity bitmaps leave room for a link."""
    side = lambda x: rows.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = np.array([least_difference(x, y) for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist())], np.int64)
            n = b.column("na").to_numpy() + b.column("nb").to_numpy()
            # overlap <= (n - difference) / 2 and it must be at least percent / (100 + percent) of n
            may = (n - differ) * (100 + percent) >= 2 * percent * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"]).filter(pa.array(may, pa.bool_()))

    return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long, na long, nb long")


def _links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of enough exact overlap: the remaining block of the product,
    over the rows of the classes in ``pairs`` alone."""
    spark = rows.sparkSession
    with batch_rows(spark, 1000):
        pairs = staged(_bounded(pairs, rows, percent), "jaccard-pairs")
    side = lambda x: rows.select(F.col("rid").alias(x), F.col("row").alias(f"r{x}"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ra"), b.column("rb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb")
    with batch_rows(spark, 100):  # two whole rows in each
        return staged(joined.mapInArrow(overlap, "a long, b long"), "jaccard-links")


def _fits(percent: int) -> Column:
    """Size and positional bounds of a pair met in one shared column."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (small * 100 >= large * percent) & (room >= _needed(F.col("na"), F.col("nb"), percent))


def _star(cells: DataFrame, order: Column, rows: DataFrame, percent: int) -> DataFrame:
    """Links between the first row (by ``order``) of each column and size band
    and the rows of other components in it: at most one pair for each cell."""
    cells = cells.withColumn("band", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    first = cells.groupBy("col", "band").agg(F.min(F.struct(order.alias("_o"), "rid", "n", "place", "comp")).alias("_f"), F.count("*").alias("_k"))
    first = staged(first.filter("_k > 1").select("col", "band", F.col("_f.rid").alias("a"), F.col("_f.n").alias("na"), F.col("_f.place").alias("pa"),
                                                 F.col("_f.comp").alias("ca")), "jaccard-anchors")
    met = cells.withColumnsRenamed({"rid": "b", "n": "nb", "place": "pb"}).join(first, ["col", "band"]).filter("comp != ca").filter(_fits(percent))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _links(staged(pairs, "jaccard-met"), rows, percent)


def _mixed(cells: DataFrame, links: DataFrame) -> DataFrame:
    """The cells of columns that rows of several components share, staged."""
    groups = staged(components(links, "a", "b"), "jaccard-groups")
    cells = cells.join(groups, cells["rid"] == groups["node"], "left").select("col", "rid", "n", "place", F.coalesce("component", "rid").alias("comp"))
    mixed = cells.groupBy("col").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("col")
    return staged(cells.join(staged(mixed, "jaccard-mixed"), "col", "left_semi"), "jaccard-cells")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT,
                   keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (its set's size), component_id
    (the least doc_id reachable by links of at least ``percent`` per cent
    Jaccard similarity), cls (its set's digest) and comp (its component's
    name, null for the empty set); ``keyed`` adds _key, of its id and text.

    A null, empty or blank text has the empty set, links with nothing and is
    its own component; so its component_id is its own doc_id, null if that is
    null.  Repeated rows are copies.  Null ids are members but never the
    least id unless all are null.  Other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    key = row_key(F.col(id_col), F.col(text_col)).alias("_key")
    members = _classes(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"), *[key] * keyed), size)
    rows = _prefixes(texts.select("_t"), size, percent)
    cells = rows.select("rid", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("cols", "places")).alias("_c")).select(
        F.col("_c.cols").alias("col"), "rid", "n", F.col("_c.places").alias("place"))

    # round 1: one row of each column and size band against all others of it: that with the fewest
    # columns of its own before it, as the text that others were copied from has
    links = _star(cells.withColumn("comp", F.col("rid")), F.col("place"), rows, percent)
    grouped = _mixed(cells, links)
    # round 2: the same with another row, for rows that share a column but not yet a component
    links = staged(links.unionAll(_star(grouped, F.xxhash64("col", "rid"), rows, percent)), "jaccard-links")
    grouped = _mixed(grouped.drop("comp"), links)
    # round 3: all rows that share a column but not a component.  From its place in a row, a column leaves
    # room for partners of at most ``cap`` columns, so of two similar rows one has a cap of its own size or
    # more (else each would be smaller than the other): only such strong rows are joined with all.
    cap = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("place")) / F.lit(percent)).cast("int") - F.col("n")
    grouped = grouped.withColumn("cap", cap)
    comps = lambda c: c.groupBy("col", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("cap").alias("cap"))
    strong = grouped.filter("cap >= n")
    near = ((F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
            & (F.col("x.cap") >= F.col("y.lo")) & (F.col("y.cap") >= F.col("x.lo")))
    across = comps(strong).alias("x").join(comps(grouped).alias("y"), (F.col("x.col") == F.col("y.col")) & (F.col("x.comp") != F.col("y.comp")) & near).select(
        F.col("x.col").alias("col"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"), F.col("y.lo").alias("lo"), F.col("y.hi").alias("hi"), F.col("y.cap").alias("cap"))
    across = staged(across, "jaccard-across")
    side = lambda c, x: c.select("col", F.col("comp").alias(f"c{x}"), F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"))
    # of a large component only the rows that fit the other one's sizes and room are taken
    rows_a = strong.select(F.col("col").alias("_col"), F.col("comp").alias("_ca"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("cap").alias("_cap"))
    fit = ((F.col("na") <= F.col("cap")) & (F.col("_cap") >= F.col("lo")) & (F.col("hi") * 100 >= F.col("na") * percent) & (F.col("na") * 100 >= F.col("lo") * percent))
    met = across.join(rows_a, (F.col("col") == F.col("_col")) & (F.col("ca") == F.col("_ca")) & fit).select("col", "cb", "a", "na", "pa")
    met = met.join(side(grouped, "b"), ["col", "cb"]).filter(_fits(percent))
    pairs = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-met")
    links = links.unionAll(_links(pairs, rows, percent))

    joined = components(links, "a", "b")
    joined = staged(rows.select("rid", "cls").join(joined, F.col("rid") == F.col("node")).select("cls", F.col("component").cast("string").alias("comp")), "jaccard-groups")
    ids = members.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("_least"))
    ids = staged(ids.join(joined, "cls", "left").select("cls", F.coalesce("comp", F.hex("cls")).alias("comp"), "_least"), "jaccard-ids")
    least = staged(ids.groupBy("comp").agg(F.min("_least").alias("component_id")), "jaccard-least")
    named = staged(ids.join(least, "comp").select(F.col("cls").alias("_cls"), "comp", "component_id"), "jaccard-named")
    columns = ["doc_id", "n_shingles", "component_id", "cls", "comp", *["_key"] * keyed]
    full = members.filter("n_shingles > 0").join(named, F.col("cls") == F.col("_cls")).select(*columns)
    empty = members.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("comp", F.lit(None).cast("string"))
    return full.unionAll(empty.select(*columns))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one of each component, that of the least id
    (null ids last; of equal ids the least key of id and text; of repeated
    rows one).  Texts without words are in no group and all stay."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, keyed=True, **options)
    groups = staged(groups.select("doc_id", "comp", "_key"), "jaccard-members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"]
    key, kept = unused(docs, "_key"), unused(docs, "_kept")
    chosen = staged(groups.filter("comp is not null").groupBy("comp").agg(first.alias(kept)).select(kept), "jaccard-kept")
    rows = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    words = F.length(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")) > 0
    one = rows.filter(words).join(chosen, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key])
    return one.unionAll(rows.filter(~words)).drop(key)
