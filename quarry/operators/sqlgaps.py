"""DataFrame forms of SQL words Spark SQL lacks: DISTINCT ON, QUALIFY,
GROUP_CONCAT.  (ASOF JOIN is quarry.operators.asof.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quarry.functions.names import col_ref


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per ``keys`` by ``order`` (ascending; wrap in ``F.desc`` via
    negation of values if needed).  A partial aggregate (``min_by``), so a
    hot key is combined map-side instead of sorted in one task."""
    payload = [c for c in df.columns if c not in keys]
    ordcols = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*[col_ref(c) for c in payload]), F.struct(*ordcols))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")


def qualify(df: DataFrame, window_value: Column, condition, name: str = "_w") -> DataFrame:
    """Filter on a window function's value (QUALIFY):
    ``qualify(df, F.row_number().over(w), lambda v: v <= 3)``."""
    return df.withColumn(name, window_value).where(condition(F.col(name))).drop(name)


def group_concat(values: Column | str, sep: str = ",", distinct: bool = False) -> Column:
    """GROUP_CONCAT / string_agg with a default comma, sorted for a stable answer.
    Partial lists are combined map-side; the result is one string per group."""
    v = F.col(values) if isinstance(values, str) else values
    coll = F.collect_set(v) if distinct else F.collect_list(v)
    return F.array_join(F.array_sort(coll), sep)
