"""As-of join (T7 / B11): each left row meets the nearest right row with the
same key: the newest at (``>=``) or before (``>``) the left row's time, or
the first at (``<=``) or after (``<``) it.  NULL keys or times never match;
inner drops left rows without a match, left keeps them with NULLs.

Spark has no ASOF JOIN, so it is composed from DataFrame operations:

1. Both sides are unioned, tagged by side, and cut into (key, time bucket)
   groups.  A running ``last(right, ignorenulls)`` over each group, ordered
   towards the left row's time, finds the match inside the bucket; on equal
   times the right rows come first if equality matches, else last.
2. For left rows without a match in their bucket, it is the nearest right
   row of another bucket: per (key, bucket) the nearest right row is reduced
   with ``max_by`` (map-side combine), and a running ``last`` over buckets
   per key carries it on.

Bucketing is what keeps a hot key (say a third of all rows) from landing in
one task: its rows spread over as many tasks as it has buckets, and step 2
works on one row per bucket.  ``bucket="auto"`` takes hours for timestamps,
days for dates, and for numbers a width of 1 / ``AUTO_BUCKETS`` of the times'
span (one pass over the two time columns).  ``"hour"``, ``"day"`` and a width
(in seconds for times) can be asked for; ``bucket=None`` partitions by key
only.  The trade-off: a finer bucket splits step 1 further, while step 2
orders one row per non-empty bucket of a key (an hour bucket: under 9,000
rows per key-year).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import dedupe_columns
from quarry.functions.names import col_ref


AUTO_BUCKETS = 4096
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _bucket(t: Column, dtype: T.DataType, bucket) -> Column:
    if bucket is None:
        return F.lit(0)
    if isinstance(dtype, _TIMES):
        if bucket == "day":
            return F.struct(F.to_date(t).alias("d"), F.lit(0).alias("h"))
        if bucket == "hour":
            return F.struct(F.to_date(t).alias("d"), F.hour(t).alias("h"))
        if isinstance(bucket, (int, float)) and bucket > 0:
            # fixed width in seconds: finer buckets split a hot key further
            secs = F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000.0)
            return F.floor(secs / F.lit(float(bucket)))
        raise ValueError(f"time bucket must be 'hour', 'day' or seconds > 0, not {bucket!r}")
    if isinstance(bucket, str) or not bucket > 0:
        raise ValueError(f"bucket of a numeric time must be a width > 0, not {bucket!r}")
    return F.floor(t.cast("double") / F.lit(float(bucket)))


def _common_type(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> T.DataType:
    """The type both times are widened to; numbers and times don't mix."""
    kinds = [left.schema[left_on].dataType, right.schema[right_on].dataType]
    if kinds[0] == kinds[1]:
        return kinds[0]
    for family in (T.NumericType, _TIMES):
        if all(isinstance(k, family) for k in kinds):
            both = left.select(col_ref(left_on).alias("t")).union(right.select(col_ref(right_on).alias("t")))
            return both.schema["t"].dataType
    raise TypeError(f"as-of times differ in type: {kinds[0]} vs {kinds[1]}")


def _auto_bucket(dtype: T.DataType, times: DataFrame):
    if isinstance(dtype, T.DateType):
        return "day"
    if isinstance(dtype, _TIMES):
        return "hour"
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"as-of needs numbers, dates or timestamps, not {dtype.simpleString()}")
    t = F.col("t").cast("double")
    lo, hi = times.where(F.abs(t) < F.lit(math.inf)).agg(F.min(t), F.max(t)).first()
    width = (hi - lo) / AUTO_BUCKETS if lo is not None else 0.0
    return width if 0 < width < math.inf else 1.0


def _descending(t: Column, dtype: T.DataType) -> Column:
    """A value that falls as the time rises."""
    if isinstance(dtype, T.TimestampType):
        return -F.unix_micros(t)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") - t
    return -F.unix_date(t) if isinstance(dtype, T.DateType) else -t


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]] | Sequence[str],
              left_on: str, right_on: str, tiebreak: Sequence[str] = (),
              bucket="auto", op: str = ">=", how: str = "inner") -> DataFrame:
    """Return left columns followed by right columns of the matched row.

    ``by`` holds key pairs ``(left_col, right_col)`` (or shared names).
    ``op`` reads ``left time op right time`` (``>=``, ``>``, ``<=``, ``<``);
    ``how`` is ``inner`` or ``left``.  ``tiebreak`` right columns order right
    rows with equal keys and times; the largest wins, so the result is
    deterministic.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"as-of comparison must be >=, >, <= or <, not {op!r}")
    if how not in ("inner", "left"):
        raise ValueError(f"as-of join is inner or left, not {how!r}")
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    q = lambda c: col_ref(c)
    dtype = _common_type(left, left_on, right, right_on)
    lt, rt = q(left_on).cast(dtype), q(right_on).cast(dtype)
    if bucket == "auto":
        bucket = _auto_bucket(dtype, left.select(lt.alias("t")).union(right.select(rt.alias("t"))))
    later, strict = op in ("<=", "<"), op in (">", "<")
    lstruct = F.struct(*[q(c) for c in left.columns])
    rstruct = F.struct(*[q(c) for c in right.columns])
    ltype_s = left.select(lstruct.alias("s")).schema["s"].dataType
    rtype_s = right.select(rstruct.alias("s")).schema["s"].dataType
    keys = [f"_k{i}" for i in range(len(pairs))]
    tb_cols = [f"_tb{i}" for i in range(len(tiebreak))]
    tb_types = [right.schema[c].dataType for c in tiebreak]
    lside, rside = (0, 1) if strict else (1, 0)  # the order on equal times

    lsel = ([q(lc).alias(k) for (lc, _), k in zip(pairs, keys)]
            + [lt.alias("_t"), _bucket(lt, dtype, bucket).alias("_b"), F.lit(lside).alias("_side")]
            + [F.lit(None).cast(t).alias(c) for c, t in zip(tb_cols, tb_types)]
            + [lstruct.alias("_l"), F.lit(None).cast(rtype_s).alias("_r")])
    rsel = ([q(rc).alias(k) for (_, rc), k in zip(pairs, keys)]
            + [rt.alias("_t"), _bucket(rt, dtype, bucket).alias("_b"), F.lit(rside).alias("_side")]
            + [q(c).alias(n) for c, n in zip(tiebreak, tb_cols)]
            + [F.lit(None).cast(ltype_s).alias("_l"), rstruct.alias("_r")])
    valid = F.col("_t").isNotNull()
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    lrows = left.select(*lsel)
    both = lrows.unionByName(right.select(*rsel)).where(valid)

    def result(matched: DataFrame) -> DataFrame:
        if how == "inner":
            matched = matched.where(F.col("_r").isNotNull())
        else:
            matched = matched.unionByName(lrows.where(~valid).select("_l", "_r"))
        return dedupe_columns(matched.select("_l.*", "_r.*"))

    # 1. nearest right row inside the same (key, bucket)
    towards = (lambda c: F.col(c).desc()) if later else F.col
    w_in = (Window.partitionBy(*keys, "_b").orderBy(towards("_t"), "_side", *tb_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (both.withColumn("_m", F.last("_r", ignorenulls=True).over(w_in))
           .where(F.col("_side") == lside).select(*keys, "_b", "_l", "_m"))
    if bucket is None:
        return result(inb.select("_l", F.col("_m").alias("_r")))

    # 2. carry-in: nearest right row of any bucket before (or after) this one.
    # Both inputs are map-side reduced to one row per (key, bucket); the big
    # windowed frame is consumed once, by a left join on its own partitioning.
    nearest = F.struct((_descending(F.col("_t"), dtype) if later else F.col("_t")).alias("t"), *tb_cols)
    rlast = (both.where(F.col("_side") == rside).groupBy(*keys, "_b")
             .agg(F.max_by("_r", nearest).alias("_lr")))
    lb = (both.where(F.col("_side") == lside).groupBy(*keys, "_b")
          .agg(F.lit(None).cast(rtype_s).alias("_lr")))
    w_carry = (Window.partitionBy(*keys).orderBy(towards("_b"))
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (rlast.unionByName(lb).groupBy(*keys, "_b")
             .agg(F.first("_lr", ignorenulls=True).alias("_lr"))
             .withColumn("_c", F.last("_lr", ignorenulls=True).over(w_carry))
             .where(F.col("_c").isNotNull()).select(*keys, "_b", "_c"))
    return result(inb.join(carry, [*keys, "_b"], "left")
                  .select("_l", F.coalesce("_m", "_c").alias("_r")))
