"""Newest row per key (Q2: latest successful snapshot of each dataset).

Written as ``max_by(struct(row), struct(order))`` in a ``groupBy``, not as a
``row_number`` window: the aggregate is combined map-side, so each task
ships at most one candidate per key to the shuffle and a key holding a
third of all rows costs no more than any other.  The struct ordering makes
the choice total (ties broken by the later order columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quarry.functions.names import col_ref


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                   where: Column | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    if where is not None:
        df = df.where(where)
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[col_ref(c) for c in payload]),
                    F.struct(*[col_ref(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def latest_snapshot(runs: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Per dataset, the newest run (by ``seq``) whose status is ``success``."""
    cond = F.col("status") == "success"
    if dataset_id is not None:
        cond = cond & (F.col("dataset_id") == dataset_id)
    return latest_per_key(runs, "dataset_id", ["seq"], where=cond)
