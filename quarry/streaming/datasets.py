"""Streams as datasets: a snapshot is the set of committed micro-batches.

A micro-batch is written to an attempt folder of its own and becomes part of
the dataset by one *commit record*, ``<root>/_commits/<batch id>.json``, that
is put only if absent.  So a batch counts once however often it is replayed,
a half-written one (a folder without a record) never counts, and of two
writers of the same batch one wins.  The record names the folder and its rows.

``<root>/_schema.json`` keeps the schema of the first ingest, so files that
come later are read the same way; ``<root>/_checkpoint`` is the stream's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import _fs, path_exists, put_if_absent, read_text
from quarry.sources.registry import read_source

FORMAT = "stream"  # a run's format whose output path is a stream's root
RECORD = "batch_id long, path string, rows long"
KINDS = {"parquet": "parquet", "csv": "csv", "csv_url": "csv", "json": "json", "json_url": "json"}
DIGITS = 18  # of a batch id in a record's name


def _record_path(root: str, batch_id: int) -> str:
    return f"{root}/_commits/{batch_id:0{DIGITS}d}.json"


def committed(spark: SparkSession, root: str, upto: int | None = None) -> list[dict]:
    """The commit records by batch id (one small row per batch), up to a batch."""
    if not path_exists(spark, f"{root}/_commits"):
        return []
    rows = spark.read.schema(RECORD).json(f"{root}/_commits").where(F.col("batch_id").isNotNull())
    if upto is not None:
        rows = rows.where(F.col("batch_id") <= upto)
    return [r.asDict() for r in rows.orderBy("batch_id").collect()]


def commit_batch(batch: DataFrame, root: str, batch_id: int) -> dict:
    """Write a micro-batch and commit it; the record that counts, which is an
    earlier one's where the batch was committed before."""
    spark = batch.sparkSession
    done = read_text(spark, _record_path(root, batch_id))
    if done is None:
        path = f"{root}/batches/{batch_id:0{DIGITS}d}-{uuid.uuid4().hex[:12]}"
        seen = Observation(f"rows{uuid.uuid4().hex[:8]}")
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        mine = json.dumps({"batch_id": batch_id, "path": path, "rows": int(seen.get.get("rows", 0))})
        done = mine if put_if_absent(spark, _record_path(root, batch_id), mine) else read_text(spark, _record_path(root, batch_id))
    return json.loads(done)


def read_stream_dataset(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The rows of the committed batches (up to a batch), nothing else under the root."""
    stored = read_text(spark, f"{root}/_schema.json")
    if stored is None:
        raise ValueError(f"No stream at {root}")
    schema, paths = T.StructType.fromJson(json.loads(stored)), [r["path"] for r in committed(spark, root, upto)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_schema(spark: SparkSession, root: str, source: Mapping) -> T.StructType:
    """The stored schema; at the first ingest the spec's own or that of the
    files that are there, all columns nullable as files may lack some."""
    stored = read_text(spark, f"{root}/_schema.json")
    if stored is None:
        given = source.get("schema")
        if isinstance(given, str):
            given = spark.createDataFrame([], given).schema
        found = given or read_source(spark, source).schema
        found = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.fields])
        put_if_absent(spark, f"{root}/_schema.json", found.json())
        stored = read_text(spark, f"{root}/_schema.json")
    return T.StructType.fromJson(json.loads(stored))


def open_stream(spark: SparkSession, source: Mapping, schema: T.StructType, max_files: int) -> DataFrame:
    """A file source as a stream, with the spec's reader options (for CSV, a
    header line per file unless the spec says otherwise)."""
    kind, path = KINDS[source["type"]], (source.get("path") or source["url"]).rstrip("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if kind == "csv":
        reader = reader.option("header", str(source.get("header", True)).lower())
    if kind == "json" and source.get("array"):
        reader = reader.option("multiLine", "true")
    reader = reader.options(**{k: str(v) for k, v in (source.get("options") or {}).items()})
    p, fs = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():  # a stream watches a folder
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.format(kind).load(path)


def ingest_stream(spark: SparkSession, source: Mapping, root: str, *, max_files: int = 100,
                  on_commit: Callable[[dict], None] | None = None) -> list[dict]:
    """Commit everything that arrived since the last call; the records of this
    call's batches.  ``on_commit`` also gets a replayed batch's record."""
    schema, records = stream_schema(spark, root, source), []

    def each(batch: DataFrame, batch_id: int) -> None:
        records.append(commit_batch(batch, root, batch_id))
        if on_commit:
            on_commit(records[-1])

    query = (open_stream(spark, source, schema, max_files).writeStream.foreachBatch(each)
             .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return records
