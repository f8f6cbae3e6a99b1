"""Equality joins with hot keys, right and full outer ones among them.

The adaptive skew split covers no full outer join and splits only one side of
a right or left one.  ``hot_key_join`` finds the keys that hold more rows than
one shuffle partition's fair share by a mergeable heavy-hitter sketch of key
hashes (bounded state per task, no shuffle of distinct keys), counts those keys
exactly, and then runs one join on (keys, salt): a hot key's rows on its larger
side are dealt to salts, those on the other side repeated once per salt.  All
other keys have salt 0, so they are shuffled as in a plain join.

The side that is dealt out is never empty for its key, so a repeated row that
found no partner under one salt has one under another: such rows are dropped
from an outer join's result.  Rows with a null in a key match nothing; they are
dealt to all salts, so they form no hot partition either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import spark_join_type
from quarry.session import scratch_path

KINDS = ("inner", "left", "right", "full")


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _whole(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def heavy_hitters(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys..., n): the keys without nulls that hold more than 1/parts of the
    rows, with their exact counts: fewer than ``parts`` rows.

    The sketch's error is far below 1/parts, so no such key is missed; what it
    names too many is cut by the exact counts.  The second pass reads the key
    columns only and aggregates in each task first."""
    keyed = df.where(_whole(keys)).select(*keys)
    sketch = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {4 * parts}, {max(1024, 32 * parts)})")
    top = keyed.agg(sketch.alias("top"), F.count("*").alias("total"))
    top = top.select(F.explode("top.item").alias("_h"), "total")
    found = keyed.join(F.broadcast(top), _hash(keys) == F.col("_h"))  # at most 4 * parts hashes
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.first("total").alias("total")).where(F.col("n") * parts > F.col("total"))


def hot_key_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", parts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` where each pair of columns in ``on`` is
    equal; the columns of left, then those of right, names kept as they are.

    ``parts`` (the session's shuffle partitions by default, at most 30,000)
    sets what is hot: more than 1/parts of a side's rows; a hot key's larger
    side is dealt to as many salts as it holds such shares.  Null keys match
    nothing, an empty side gives what the plain join gives, repeated rows
    count each, and the columns may have any names."""
    spark, kind = left.sparkSession, spark_join_type(how)
    if kind not in KINDS:
        raise ValueError(f"Unsupported join kind for hot keys: {how!r}")
    parts = max(2, min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), 30_000))
    names = left.columns + right.columns
    lk, rk = [f"l{left.columns.index(a)}" for a, _ in on], [f"r{right.columns.index(b)}" for _, b in on]
    ldf, rdf = left.toDF(*[f"l{i}" for i in range(len(left.columns))]), right.toDF(*[f"r{i}" for i in range(len(right.columns))])

    same = [f"k{i}" for i in range(len(on))]
    side = lambda df, keys, n: heavy_hitters(df, keys, parts).toDF(*same, n, f"{n}_total")
    hot = side(ldf, lk, "nl").join(side(rdf, rk, "nr"), same, "full")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    most, total = F.greatest(nl, nr), F.when(nl >= nr, F.col("nl_total")).otherwise(F.col("nr_total"))
    hot = hot.select(*same, (nl >= nr).alias("deal_left"), F.ceil(most * parts / total).cast("int").alias("salts"))
    path = scratch_path(spark, "hot-keys")
    hot.write.parquet(path)
    hot = spark.read.schema(hot.schema).parquet(path)  # fewer than 2 * parts rows

    def salted(df: DataFrame, keys: list[str], s: str, dealt: Column) -> DataFrame:
        marked = df.withColumn(f"{s}_row", F.monotonically_increasing_id())
        known = F.lit(True)
        for k, h in zip(keys, same):
            known = known & (F.col(k) == F.col(h))
        marked = marked.join(F.broadcast(hot), known, "left")
        one = lambda n: F.array(F.pmod(F.col(f"{s}_row"), n).cast("int"))
        salts = (F.when(~_whole(keys), one(F.lit(parts)))
                 .when(F.col("salts").isNull(), F.array(F.lit(0)))
                 .when(dealt, one(F.col("salts")))
                 .otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))
        repeated = F.coalesce(F.col("salts").isNotNull() & ~dealt, F.lit(False))
        return marked.select(*df.columns, repeated.alias(f"{s}_repeated"), F.lit(True).alias(f"{s}_here"), F.explode(salts).alias(f"{s}_salt"))

    ls, rs = salted(ldf, lk, "ls", F.col("deal_left")), salted(rdf, rk, "rs", ~F.col("deal_left"))
    equal = F.col("ls_salt") == F.col("rs_salt")
    for a, b in zip(lk, rk):
        equal = equal & (F.col(a) == F.col(b))
    out = ls.join(rs, equal, kind)
    spare = (F.col("ls_repeated") & F.col("rs_here").isNull()) | (F.col("rs_repeated") & F.col("ls_here").isNull())
    return out.where(~F.coalesce(spare, F.lit(False))).select(*ldf.columns, *rdf.columns).toDF(*names)
