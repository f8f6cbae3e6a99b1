"""Benchmark decontamination by a prefix-filtered set join, in DataFrame
operations only.

A *window* is ``window`` (13) consecutive words of a benchmark item, or the
whole of a shorter item.  A window is the set of its word shingles (five
words; the whole window where it has fewer).  It occurs in a document only if
*all* its shingles do, so with a containment of 1 the necessary prefix is one
token: its rarest shingle over the corpus.

1. Count every benchmark shingle over all documents.  A fixed-size bitmap
   (2^20 bits, whatever the tables' sizes) first passes over the positions
   that cannot be one; the rest is counted before it is joined.
2. Order each window's shingles by (count, hash); the first is its prefix.
   Windows with a shingle that occurs nowhere are dropped: they can't occur.
3. Scan the documents again, keep positions that hold a prefix token, join
   them with the windows of that token, apply the length and positional
   bounds (the window must lie inside the document) and compare the words.
4. Per document, merge the verified windows' intervals and list their items.

Neighbouring windows mostly share their rarest shingle, so a benchmark
passage leaves two or three joined rows, not one for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import row_key, staged, text_or_empty, without

WINDOW = 13
SHINGLE = 5
BITS = 20  # log2 of the bitmap's bits: 128 KB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing A-Z


def words_of(text: str | Column) -> Column:
    """The words of a text as an array; none for null, empty or blank ones."""
    return F.filter(F.split(F.translate(text_or_empty(text), UPPER, LOWER), GAPS), lambda w: w != "")


def _hash(words: Column, at: Column, n: int) -> Column:
    """Hash of the n words from 0-based position ``at``; null beyond the end."""
    return F.when(at + n <= F.size(words), F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)]))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: _wid, _win (its words), _items is kept apart by
    :func:`window_items`."""
    w = items.select(F.col(id_col).cast("string").alias("_item"), words_of(text_col).alias("_words"))
    last = F.greatest(F.size("_words") - window, F.lit(0))
    at = F.explode(F.when(F.size("_words") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))
    w = w.select("_item", "_words", at.alias("_at"))
    win = F.slice("_words", F.col("_at") + 1, F.lit(window))
    return w.select("_item", win.alias("_win")).withColumn("_wid", row_key(F.col("_win"))).distinct()


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Every shingle of every distinct window: _wid, _win, _off, _h."""
    n = F.least(F.size("_win"), F.lit(shingle))
    rows = windows.select("_wid", "_win", F.explode(F.sequence(F.lit(0), F.size("_win") - n)).alias("_off"))
    h = F.coalesce(_hash(F.col("_win"), F.col("_off"), shingle),
                   *[F.when(F.size("_win") == k, _hash(F.col("_win"), F.col("_off"), k)) for k in range(shingle - 1, 0, -1)])
    return rows.withColumn("_h", h)


def _bitmap(hashes: DataFrame, bits: int = BITS) -> Column:
    """A bitmap of the hashes as a scalar subquery: 2^bits bits in longs, of
    one size however many hashes there are."""
    bit = F.col("_h").bitwiseAND(F.lit((1 << bits) - 1))
    cells = (hashes.select(F.shiftright(bit, 6).alias("_cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("_bit"))
             .groupBy("_cell").agg(F.bit_or("_bit").alias("_bits")))
    filled = cells.agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_bits"))).alias("_m")).select(
        F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << (bits - 6)) - 1).cast("long")),
                    lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long"))).alias("_map"))
    return filled.scalar()


def _maybe(bitmap: Column, h: Column, bits: int = BITS) -> Column:
    bit = h.bitwiseAND(F.lit((1 << bits) - 1))
    cell = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", cell, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(kept columns, _words, _at, _h) of every position and shingle length.
    Position n_words is the document's own row: it has no shingle."""
    n = len(lengths)
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), F.size("_words") * n)).alias("_i"))
    rows = rows.withColumn("_at", F.floor(F.col("_i") / n).cast("int")) if n > 1 else rows.withColumnRenamed("_i", "_at")
    h = _hash(F.col("_words"), F.col("_at"), lengths[0])
    if n > 1:
        turn = F.pmod(F.col("_i"), F.lit(n))
        h = F.coalesce(*[F.when(turn == k, _hash(F.col("_words"), F.col("_at"), size)) for k, size in enumerate(lengths)])
    return rows.withColumn("_h", h)


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, _key (its id and text's key), n_words,
    n_hit, n_items, items_sha256, contaminated (5 % of its words are hit).

    A null, empty or wordless text has n_words 0 and is clean; items without
    words have no window; an empty benchmark leaves every document clean.
    Repeated rows give a row each.  Items with equal windows all count."""
    spark = docs.sparkSession
    owned = staged(item_windows(items, window, item_id, item_text), "bench-windows")
    windows = staged(_shingles(owned.select("_wid", "_win").distinct(), shingle), "bench-shingles")
    # at most `shingle` different lengths
    lengths = sorted(r[0] for r in windows.select(F.least(F.size("_win"), F.lit(shingle))).distinct().collect()) or [shingle]

    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), words_of(text_col).alias("_words"))
    known = windows.select("_h").distinct()
    seen = _positions(texts.select("_words"), lengths).filter(_maybe(_bitmap(known), F.col("_h")))
    counts = seen.groupBy("_h").agg(F.count("*").alias("_n"))
    counts = staged(known.join(counts, "_h"), "bench-counts")

    rated = windows.join(counts, "_h", "left").groupBy("_wid").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_h", "_off")).alias("_first"), F.first("_win").alias("_win"))
    prefix = staged(rated.filter("_first._n > 0").select("_wid", "_win", F.col("_first._h").alias("_h"), F.col("_first._off").alias("_off")), "bench-prefix")

    reach = window - 1
    tokens = _bitmap(prefix.select("_h").distinct())
    own = F.col("_at") == F.size("_words")
    found = (_positions(texts, lengths).filter(own | _maybe(tokens, F.col("_h")))
             .select("doc_id", "_key", F.size("_words").cast("long").alias("n_words"), "_at", F.when(~own, F.col("_h")).alias("_h"),
                     F.greatest(F.col("_at") - reach, F.lit(0)).alias("_from"), own.alias("_own"),
                     F.when(~own, F.slice("_words", F.greatest(F.col("_at") - reach, F.lit(0)) + 1, F.lit(reach + window))).alias("_near")))
    found = staged(found, "bench-found")

    start, size = F.col("_at") - F.col("_off"), F.size("_win")
    inside = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice("_near", F.greatest(start - F.col("_from") + 1, F.lit(1)), size) == F.col("_win")
    verified = (found.filter("not _own").join(prefix, "_h").filter(inside & same)
                .select("_key", start.alias("_start"), (start + size).alias("_end"), "_wid").distinct())
    verified = staged(verified, "bench-hits")

    by_start = Window.partitionBy("_key").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    merged = verified.withColumn("_seen", F.coalesce(F.max("_end").over(by_start), F.lit(0)))
    n_hit = merged.groupBy("_key").agg(F.sum(F.greatest(F.lit(0), F.col("_end") - F.greatest("_start", "_seen"))).alias("_n_hit"))
    named = verified.select("_key", "_wid").distinct().join(owned.select("_wid", "_item"), "_wid").select("_key", "_item").distinct()
    named = named.groupBy("_key").agg(F.sort_array(F.collect_list("_item")).alias("_items"), F.count("*").alias("_n_items"))
    facts = staged(n_hit.join(named, "_key"), "bench-facts")

    out = found.filter("_own").select("doc_id", "_key", "n_words").join(facts, "_key", "left")
    hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "_key", "n_words", hit.alias("n_hit"), F.coalesce("_n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
                      ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    marked = hits(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = staged(marked.filter("contaminated").select("_key").distinct(), "bench-contaminated")
    return without(docs, row_key(F.col(id_col), F.col(text_col)), bad)
