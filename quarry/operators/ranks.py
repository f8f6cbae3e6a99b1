"""Ranks and row frames over few, huge partitions.

A SQL window sorts a whole partition in one task.  Here a partition's rows are
dealt to ordered ranges (Spark's range partitioning of partition, order and a
tie breaker, so even a key that a third of the rows share is cut), each range
is ranked alone, and what the earlier ranges hold is added from a table of one
row per (partition, range): numbers of rows and of distinct keys, and where the
run of equal keys at a range's ends began or stops.  Row frames are computed in
blocks of row numbers, each with halo rows from its neighbours.

The order is a list of columns, each with ``DESC`` / ``NULLS FIRST|LAST`` after
its name if wanted (default as in Spark: ascending, nulls first; descending,
nulls last).  Null partitions are partitions; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import col_ref
from quarry.operators.ranges import free_names
from quarry.session import scratch_path

BLOCK_ROWS = 100_000
_TERM = re.compile(r"^\s*(`(?:[^`]|``)+`|.+?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*$", re.I)
KINDS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")


def sort_terms(order_by: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """(the sort columns with their directions, the bare columns)."""
    ordered, bare = [], []
    for term in order_by:
        name, way, nulls = _TERM.match(term).groups()
        c = col_ref(name[1:-1].replace("``", "`") if name.startswith("`") else name)
        way, nulls = (way or "asc").lower(), nulls and nulls.lower()
        ordered.append(getattr(c, way + (f"_nulls_{nulls}" if nulls else ""))())
        bare.append(c)
    return ordered, bare


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, "ranks", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], ranges: int | None, name: str) -> DataFrame:
    """The rows with the number of their range.  Ranges follow one another in
    every partition; rows of one key may fall in several."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered, _ = sort_terms(order_by)
    ties = F.xxhash64(F.monotonically_increasing_id())
    return df.repartitionByRange(n, *map(col_ref, partition_by), *ordered, ties).withColumn(name, F.spark_partition_id())


def distributed_ranks(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], columns: Mapping[str, str | tuple[str, int]],
                      ranges: int | None = None) -> DataFrame:
    """Add rank columns: name -> ``row_number``, ``rank``, ``dense_rank``,
    ``percent_rank``, ``cume_dist`` or ``("ntile", n)``.

    The result equals the SQL window functions (row numbers and tiles of rows
    with equal keys are theirs in some order).  No task holds more than a
    range's rows of a partition, some 1 / ``ranges`` of all."""
    for kind in columns.values():
        if (kind if isinstance(kind, str) else kind[0]) not in KINDS:
            raise ValueError(f"Unsupported rank: {kind!r}")
    part, (ordered, bare) = list(partition_by), sort_terms(order_by)
    rng, num, rnk, dns, cum, key, n_in, first, last, kinds, tail, head, at, *_rest = free_names(24, df)
    (before, merges, start, prev, nxt, since, upto, all_, total, opens, ends) = _rest
    local = Window.partitionBy(rng, *map(col_ref, part)).orderBy(*ordered)
    rows = _dealt(df, part, order_by, ranges, rng).withColumns({
        key: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(bare))),
        num: F.row_number().over(local), rnk: F.rank().over(local), dns: F.dense_rank().over(local)})
    rows = _staged(rows, "local")
    # one row per range of a partition
    edges = rows.groupBy(rng, *map(col_ref, part)).agg(
        F.count(F.lit(1)).alias(n_in), F.min_by(key, num).alias(first), F.max_by(key, num).alias(last), F.max(dns).alias(kinds),
        F.max(rnk).alias(tail), F.count_if(F.col(rnk) == 1).alias(head))
    whole = Window.partitionBy(*map(col_ref, part))
    along = whole.orderBy(rng)
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.withColumns({before: F.coalesce(F.sum(n_in).over(earlier), F.lit(0)), prev: F.lag(last).over(along), nxt: F.lead(first).over(along),
                               since: F.lag(rng).over(along), upto: F.lead(rng).over(along), total: F.sum(n_in).over(whole),
                               all_: F.coalesce(F.sum(kinds).over(earlier), F.lit(0))})
    goes_on, comes_on = F.col(since).isNotNull() & F.col(prev).eqNullSafe(F.col(first)), F.col(upto).isNotNull() & F.col(nxt).eqNullSafe(F.col(last))
    # rank of the last key, and rows up to the end of the first key's run; null where a run covers the range and goes on
    opening = F.when(F.col(kinds) > 1, F.col(before) + F.col(tail)).when(~goes_on, F.col(before) + 1)
    ending = F.when(F.col(kinds) > 1, F.col(before) + F.col(head)).when(~comes_on, F.col(before) + F.col(n_in))
    edges = edges.withColumns({opens: opening, ends: ending, merges: F.when(goes_on, 1).otherwise(0)})
    edges = edges.withColumns({
        start: F.when(goes_on, F.last(opens, ignorenulls=True).over(earlier)),
        at: F.when(comes_on, F.first(ends, ignorenulls=True).over(later)),
        merges: F.sum(merges).over(along)})
    edges = edges.select(F.col(rng).alias(opens), *(col_ref(p).alias(f"{ends}_{i}") for i, p in enumerate(part)), first, last, before, merges, start, at, total, all_)
    same = F.col(rng) == F.col(opens)
    for i, p in enumerate(part):
        same = same & col_ref(p).eqNullSafe(F.col(f"{ends}_{i}"))
    joined = rows.join(edges, same)
    if any(k == "cume_dist" for k in columns.values()):
        run = Window.partitionBy(rng, *map(col_ref, part)).orderBy(rnk)
        joined = joined.withColumn(cum, F.count(F.lit(1)).over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.col(before) + F.col(num)
    rank = F.when(F.col(start).isNotNull() & F.col(key).eqNullSafe(F.col(first)), F.col(start)).otherwise(F.col(before) + F.col(rnk))
    n = F.col(total)
    made = {
        "row_number": place, "rank": rank, "dense_rank": F.col(all_) - F.col(merges) + F.col(dns),
        "percent_rank": F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)),
        "cume_dist": F.when(F.col(at).isNotNull() & F.col(key).eqNullSafe(F.col(last)), F.col(at)).otherwise(F.col(before) + F.col(cum)) / n}

    def tile(k: int) -> Column:
        size, more = F.floor(n / F.lit(k)), n % F.lit(k)  # the first ``more`` tiles have a row more
        return F.when(place <= more * (size + 1), F.ceil(place / (size + 1))).otherwise(more + F.ceil(F.try_divide(place - more * (size + 1), size)))

    out = [(made[k] if isinstance(k, str) else tile(k[1])).cast("double" if k in ("percent_rank", "cume_dist") else "long").alias(c) for c, k in columns.items()]
    return joined.select(*map(col_ref, df.columns), *out)


def distributed_frames(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], columns: Mapping[str, Column], preceding: int, following: int,
                       block_rows: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """Add aggregates over ``ROWS BETWEEN preceding PRECEDING AND following
    FOLLOWING`` (``lag`` and ``lead`` are frames of one row: -1, 1 after the
    current row).  ``columns`` are aggregate expressions without a window.

    A row goes to the block of its row number and, flagged, to the blocks
    whose rows reach it, so a task sorts ``block_rows`` rows and the halo."""
    if preceding + following < 0 or block_rows < 1:
        raise ValueError("the frame is empty")
    num, block, own = free_names(3, df)
    rows = distributed_ranks(df, partition_by, order_by, {num: "row_number"}, ranges)
    of = lambda c: F.floor(c / F.lit(block_rows))
    place = F.col(num) - 1
    # rows that have this one in their frame, and the row itself
    lowest, highest = F.least(place, place - following), F.greatest(place, place + preceding)
    rows = rows.withColumn(block, F.explode(F.sequence(of(F.greatest(lowest, F.lit(0))), of(highest)))).withColumn(own, F.col(block) == of(place))
    w = Window.partitionBy(block, *map(col_ref, partition_by)).orderBy(num).rowsBetween(-preceding, following)
    return rows.select(*map(col_ref, df.columns), *(c.over(w).alias(name) for name, c in columns.items()), own).where(F.col(own)).drop(own)


def distributed_running(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], value: str, columns: Mapping[str, str],
                        block_rows: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """Add running ``sum``, ``count``, ``min`` or ``max`` of a column from the
    partition's first row to the current one (ROWS): inside a block by a
    window, before it by the blocks' own aggregates."""
    of = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    num, block, other, *made = free_names(3 + 2 * len(columns), df)
    rows = distributed_ranks(df, partition_by, order_by, {num: "row_number"}, ranges)
    rows = _staged(rows.withColumn(block, F.floor((F.col(num) - 1) / F.lit(block_rows))), "running")
    part = list(map(col_ref, partition_by))
    here, past = made[: len(columns)], made[len(columns):]
    sums = rows.groupBy(block, *part).agg(*(of[k](col_ref(value)).alias(x) for k, x in zip(columns.values(), here)))
    earlier = Window.partitionBy(*part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda k, x: (F.sum if k == "count" else of[k])(x).over(earlier)
    sums = sums.select(F.col(block).alias(other), *(p.alias(f"{other}_{i}") for i, p in enumerate(part)), *(over(k, x).alias(y) for k, x, y in zip(columns.values(), here, past)))
    same = F.col(block) == F.col(other)
    for i, p in enumerate(part):
        same = same & p.eqNullSafe(F.col(f"{other}_{i}"))
    w = Window.partitionBy(block, *part).orderBy(num).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def both(kind: str, x: str) -> Column:
        now = of[kind](col_ref(value)).over(w)
        if kind in ("min", "max"):
            return (F.least if kind == "min" else F.greatest)(now, F.col(x))
        added = F.coalesce(now, F.lit(0)) + F.coalesce(F.col(x), F.lit(0))
        return F.when(now.isNotNull() | F.col(x).isNotNull(), added)

    return rows.join(sums, same).select(*map(col_ref, df.columns), *(both(k, x).alias(c) for (c, k), x in zip(columns.items(), past)))
