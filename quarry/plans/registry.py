"""Registry of checked queries: key -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables under
``sf_dir`` (or data Spark derives from them), so its work grows with them.
An oracle of ``None`` means the result is checked by row count only (or by
unit tests against a brute-force statement of the rule).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def check(key: str, oracle: str | None = None):
    """Register ``fn`` under ``key`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if key in _QUERIES:
            raise KeyError(f"duplicate check key {key}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn
    return deco


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_refs(sf_dir: str, *names: str) -> dict[str, str]:
    """``{name: path}`` for binding driver tables as views (default: all)."""
    return {n: table_path(sf_dir, n) for n in (names or TABLES)}


def _load_all() -> None:
    # Importing the suites fills the registry.
    from quarry.plans import (  # noqa: F401
        checks_discovery,
        checks_io,
        checks_profile,
        checks_query,
        checks_runs,
        checks_sql_a,
        checks_sql_b,
        checks_transform,
    )


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
