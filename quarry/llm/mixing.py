"""Mixing sources to target weights by a multivariate-hypergeometric tree.

A block is one document; its size is its number of words.  Steps:

1. *Targets*: sources in code-point order (null last) weigh 3, 1, 2,
   repeating, and share ``budget`` (1.5) times all words; none gets more than
   ``cap`` (2) times its own words, the excess is shared again by weight.
   That fixed point is the water level ``min(cap * size, level * weight)``.
2. *Permutation*: each source's blocks are ordered by a seeded hash.  Hash
   buckets split a hot source, so its order is ranks inside buckets plus
   prefix sums over the buckets, never one task's sort.
3. *Quota*: a source gives whole passes over its blocks, then the first
   blocks of its permutation up to its target; the block at the edge gives
   only its first words.  So a source's words equal its target to a word.
4. *Splitting tree*: the exact block counts of all sources are split between
   the halves of the output shards by multivariate-hypergeometric draws,
   level by level, until each shard has its exact quota of every source.
5. *Draw*: a shard takes the next disjoint run of each source's permuted
   blocks and is shuffled locally.

Only ids and sizes are shuffled, never texts.  Seeds make reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NOT_BLANKS, row_key, staged, text_or_empty, unused

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2.0
BUCKETS = 1024
SHARDS = 8
BIG = 10**9  # numpy's exact hypergeometric sampler needs smaller populations


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(NOT_BLANKS)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_rid, doc_id, source, size, _key) of every row, staged.  ``_rid`` is a
    row number that lives as long as the staged table, so repeated rows and
    null ids stay apart."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                      word_count(text_col).alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("_key"))
    return staged(out.withColumn("_rid", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, blocks, target): one row per source.

    The windows below run over one row per source.  With sources in the order
    of cap/weight, those before the water level are full and the rest share
    what remains by weight; the level is the first that no full one exceeds."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("blocks"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))
    free = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(full), F.lit(0.0))
    per = per.withColumn("_level", left / free)
    # the first source in that order whose cap isn't below the level sets the level of all after it
    open_ = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(every)
    level = F.coalesce(open_["_level"], F.lit(float("inf")))
    return per.select("source", "source_size", "blocks", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def permuted(sizes: DataFrame, targets: DataFrame, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Every block with its rank in its source's permutation, its whole
    passes and the words it gives in the last, partial pass (``_extra``)."""
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("_key"))
    rows = sizes.withColumn("_h", h).withColumn("_bucket", F.pmod(F.shiftright(F.col("_h"), 20), F.lit(buckets)).cast("int"))
    per = rows.groupBy("source", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                     F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_w0"))
    goal = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets.select("source", "source_size", "target", "blocks", passes.alias("_passes"), (goal - passes * F.col("source_size")).alias("_rest"))
    per = staged(per.join(goals, per["source"].eqNullSafe(goals["source"])).drop(goals["source"]), "mix-buckets")
    rows = rows.join(per.withColumnsRenamed({"source": "_s", "_bucket": "_b"}),
                     F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "_key", "_rid")
    rows = (rows.withColumn("_rank", F.col("_n0") + F.row_number().over(inside) - 1)
            .withColumn("_before", F.col("_w0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    return rows.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before"))))


def mix(docs: DataFrame, seed: int = 0, **columns) -> DataFrame:
    """Words taken of every document: doc_id, size, source, source_size,
    target, taken (repeats counted) and the plan's own columns.

    Null and blank texts have size 0 and give nothing.  Rows with equal ids
    count one by one.  An empty table gives an empty result; other columns
    of ``docs``, whatever their names, are not read."""
    return mix_sizes(sized(docs, **columns), seed)


def mix_sizes(sizes: DataFrame, seed: int = 0) -> DataFrame:
    rows = permuted(sizes, source_targets(sizes), seed)
    return rows.withColumn("taken", F.col("_passes") * F.col("size") + F.col("_extra"))


# ---------------------------------------------------------------- splitting tree
def _tail(ratio, last: int, step: int = 1 << 16) -> np.ndarray:
    """Products of ratio(0), ratio(0) ratio(1), ... up to ratio(last - 1), as
    far as they stay above 2^-60: what follows adds nothing to a double."""
    out, at, weight = [np.zeros(0)], 0, 1.0
    while at < last and weight > 2.0**-60:
        out.append(weight * np.cumprod(ratio(np.arange(at, min(last, at + step), dtype=np.float64))))
        at, weight = at + step, out[-1][-1]
    return np.concatenate(out)


def _drawn(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One hypergeometric draw from a population of any size.  numpy's sampler
    holds fewer than 10^9; a larger one is drawn by inversion: weights go
    outwards from the mode by the ratios of neighbouring probabilities, some
    nine standard deviations to each side."""
    if good + bad < BIG:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    mode = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))
    # P(k + 1) / P(k) = (good - k) (take - k) / ((k + 1) (bad - take + k + 1))
    right = _tail(lambda i: (good - mode - i) / (mode + i + 1) * ((take - mode - i) / (bad - take + mode + i + 1)), high - mode)
    left = _tail(lambda i: (mode - i) / (good - mode + i + 1) * ((bad - take + mode - i) / (take - mode + i + 1)), mode - low)
    upto = np.cumsum(np.concatenate([left[::-1], [1.0], right]))
    return mode - len(left) + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), len(upto) - 1)


def hypergeometric(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` blocks drawn without replacement are of each
    source, drawn source by source; the counts add up to ``take``."""
    out, total = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, n in enumerate(counts):
        n, rest = int(n), total - int(n)
        got = _drawn(rng, n, rest, take) if take > 0 and n else 0
        out[i], take, total = got, take - got, rest
    return out


def shard_quotas(counts: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source, shard, n) from (source, n): exact quotas whose shard totals
    differ by at most one, by splitting each node of a binary tree in two.
    One node is one group: a row per source, however many blocks there are.
    The depth is log2(shards); a level is one small shuffle."""
    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        if hi - lo < 2:
            return pdf
        pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
        mid, n = (lo + hi) // 2, pdf["n"].to_numpy()
        total, width = int(n.sum()), hi - lo
        # shard k of the node gets (total * (k + 1)) // width - (total * k) // width blocks
        left = hypergeometric(np.random.default_rng([seed, lo, hi]), n, total * (mid - lo) // width)
        return pd.concat([pdf.assign(n=left, hi=mid), pdf.assign(n=n - left, lo=mid)], ignore_index=True)

    nodes = counts.select("source", F.col("n").cast("long"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    width = shards
    while width > 1:
        nodes, width = nodes.groupBy("lo", "hi").applyInPandas(halve, "source string, n long, lo int, hi int"), -(-width // 2)
    return nodes.filter("n > 0").select("source", F.col("lo").alias("shard"), "n")


def draws(mixed: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per drawn block: _rid, doc_id, words, shard, _place (its local
    shuffle position's key), copy.  A source's blocks, pass after pass in
    permuted order, are dealt to the shards in runs of the tree's quotas."""
    copies = F.col("_passes") + F.when(F.col("_extra") > 0, 1).otherwise(0)
    taken = mixed.filter("taken > 0").select("_rid", "doc_id", "source", "size", "_h", "_rank", "_bucket", "_passes", "_extra", "blocks", copies.alias("_copies"))
    each = (taken.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))))
            .withColumn("words", F.when(F.col("copy") < F.col("_passes"), F.col("size")).otherwise(F.col("_extra"))))
    # blocks without words are never drawn: the index counts all blocks, the quotas are cut on the index
    counts = each.groupBy("source").agg((F.max(F.col("copy") * F.col("blocks") + F.col("_rank")) + 1).alias("n"))
    quotas = shard_quotas(counts, shards, seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = (quotas.withColumn("_to", F.sum("n").over(upto)).groupBy("source")
            .agg(F.sort_array(F.collect_list(F.struct("_to", "shard"))).alias("_runs")))
    index = F.col("copy") * F.col("blocks") + F.col("_rank")
    # a hot source's rows are spread: the quotas are repeated per bucket group, the join key has both
    split = 16
    runs = staged(runs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))), "mix-quotas").withColumnRenamed("source", "_s")
    each = each.withColumn("_part2", F.pmod(F.col("_bucket"), F.lit(split)))
    out = each.join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_part2")))
    shard = F.filter("_runs", lambda r: r["_to"] > index)[0]["shard"]
    return out.select("_rid", "doc_id", "source", "size", "words", "copy", shard.alias("shard"),
                      F.xxhash64(F.lit(seed + 1), "_h", "_rid", "copy").alias("_place"))


def dealt(docs: DataFrame, seed: int = 0, shards: int = SHARDS, **columns) -> DataFrame:
    """``mix``'s rows with ``taken`` as the words of their drawn blocks, summed
    over all shards that the tree dealt them to; 0 for a row that is not drawn."""
    plan = staged(mix(docs, seed, **columns), "mix-plan")
    words = draws(plan, shards, seed).groupBy("_rid").agg(F.sum("words").alias("_drawn"))
    return plan.join(words, "_rid", "left").withColumn("taken", F.coalesce("_drawn", F.lit(0).cast("long"))).drop("_drawn")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a lasting row name: file and place of a row that is read
    from files, else a row number in a staged copy."""
    try:
        path, at = docs.metadataColumn("_metadata")["file_path"], docs.metadataColumn("_metadata")["row_index"]
        return docs.select("*", F.concat_ws(":", F.hex(F.xxhash64(path)), at).alias(name))
    except AnalysisException:
        return staged(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "mix-rows")


def mixed_documents(docs: DataFrame, seed: int = 0, shards: int = SHARDS, *, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, once per drawn copy, dealt to
    ``shards`` partitions and shuffled inside each.  A block cut at its
    source's edge keeps its first words; ``n_chars``, where there is one,
    is then counted anew.  Columns of any name are passed on."""
    rid, drawn_rid, size, words, shard, place = (unused(docs, n) for n in ("_rid", "_drawn_rid", "_size", "_words", "_shard", "_place"))
    kept = _numbered(docs, rid)
    sizes = kept.select(F.col(rid).alias("_rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        word_count(text_col).alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("_key"))
    drawn = draws(mix_sizes(staged(sizes, "mix-sizes"), seed), shards, seed).select(
        F.col("_rid").alias(drawn_rid), F.col("size").alias(size), F.col("words").alias(words),
        F.col("shard").alias(shard), F.col("_place").alias(place))
    rows = kept.join(drawn, F.col(rid) == F.col(drawn_rid))
    cut = F.col(words) < F.col(size)
    pieces = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"{NOT_BLANKS}[\\x20\\x09-\\x0D]*"), F.lit(0))
    first = F.when(cut, F.array_join(F.slice(pieces, 1, F.col(words).cast("int")), ""))
    rows = rows.withColumn(text_col, F.coalesce(first, F.col(text_col)))
    if "n_chars" in docs.columns:
        count = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(cut, count).otherwise(F.col("n_chars")))
    dealt = rows.repartition(shard, F.pmod(F.col(place), F.lit(64)))
    return dealt.sortWithinPartitions(shard, place).drop(rid, drawn_rid, size, words, shard, place)
