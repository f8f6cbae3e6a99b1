"""Source dispatch (S7), dataset-as-source (S8) and preview.

A source spec is a dict with a ``type``; each type maps to a reader
``(spark, spec) -> DataFrame``.  New types are added with :func:`register`
(for a fully custom connector, a Python Data Source registered with
``spark.dataSource.register`` can then be read with ``type: "format"``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.files import scan_csv, scan_json, scan_parquet

Reader = Callable[[SparkSession, Mapping], DataFrame]

_READERS: dict[str, Reader] = {}
# Types a run ingests incrementally when the ingest mode is "auto" (R2):
# only file sources can be read as a stream; databases and synthetic data
# are partitioned batch reads.
_STREAMABLE: set[str] = set()


def register(source_type: str, *, streamable: bool = False):
    def deco(fn: Reader) -> Reader:
        _READERS[source_type] = fn
        if streamable:
            _STREAMABLE.add(source_type)
        return fn
    return deco


def supported_types() -> list[str]:
    _load_builtin()
    return sorted(_READERS)


def is_streamable(source_type: str) -> bool:
    _load_builtin()
    return source_type in _STREAMABLE


def read_source(spark: SparkSession, spec: Mapping) -> DataFrame:
    _load_builtin()
    if spec.get("type", "pipeline") == "pipeline" or "pipeline_id" in spec or "dataset_id" in spec:
        if "path" not in spec:
            return _READERS["dataset"](spark, spec)
    t = spec.get("type")
    fn = _READERS.get(t)
    if fn is None:
        raise ValueError(f"Unsupported source type: {t}")
    return fn(spark, spec)


@register("parquet", streamable=True)
def _parquet(spark, spec):
    return scan_parquet(spark, spec["path"], spec.get("columns"))


@register("csv", streamable=True)
@register("csv_url", streamable=True)
def _csv(spark, spec):
    return scan_csv(spark, spec.get("path") or spec["url"], schema=spec.get("schema"),
                    header=spec.get("header", True), **(spec.get("options") or {}))


@register("json", streamable=True)
@register("json_url", streamable=True)
def _json(spark, spec):
    return scan_json(spark, spec.get("path") or spec["url"], schema=spec.get("schema"),
                     array=spec.get("array", False), **(spec.get("options") or {}))


@register("format")
def _format(spark, spec):
    reader = spark.read.format(spec["format"])
    if spec.get("schema"):
        reader = reader.schema(spec["schema"])
    for k, v in (spec.get("options") or {}).items():
        reader = reader.option(k, v)
    return reader.load(spec["path"]) if spec.get("path") else reader.load()


_loaded = False


def _load_builtin() -> None:
    global _loaded
    if _loaded:
        return
    _loaded = True
    from quarry.sources import jdbc, records, synthetic  # noqa: F401  (register)
    from quarry import catalog  # noqa: F401  (registers "dataset")


@dataclass
class Preview:
    columns: list[str]
    row_count: int
    sample: DataFrame


def preview_source(spark: SparkSession, spec: Mapping, n: int = 3,
                   order_by: list[str] | None = None) -> Preview:
    """Columns, row count and the first ``n`` rows (by ``order_by`` if given,
    for a stable answer; otherwise whatever rows come first)."""
    df = read_source(spark, spec)
    sample = (df.orderBy(*order_by) if order_by else df).limit(n)
    return Preview(columns=df.columns, row_count=df.count(), sample=sample)
