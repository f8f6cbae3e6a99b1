"""Incremental file ingest (R6) with Structured Streaming.

New files under a source directory are picked up by a file-source stream
(``maxFilesPerTrigger`` bounds a micro-batch), and each micro-batch is
written by ``foreachBatch`` to ``<target>/quarry_batch=<id>`` with mode overwrite,
then logged.  With the stream's checkpoint (offsets + commits) a restart
replays at most the uncommitted batch, and overwriting its directory makes
the replay idempotent: every file lands exactly once.  ``availableNow``
processes what is there and stops, so the job can be scheduled like a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "quarry_batch"  # a name of our own: a source may have a column "batch"


def stream_ingest(spark: SparkSession, source_dir: str, target_dir: str,
                  schema: T.StructType, fmt: str = "parquet", checkpoint: str | None = None,
                  glob: str | None = None, max_files_per_trigger: int = 100,
                  on_batch=None, options: dict | None = None) -> list[dict]:
    """Ingest every not-yet-seen file; return the per-batch log rows.

    The checkpoint lies beside the target unless named, so a later call goes
    on where this one ended; ``options`` are the reader's (a CSV file's header
    line is none of its rows unless they say so).  A source with a column ``quarry_batch`` is refused."""
    if PART in schema.fieldNames():
        raise ValueError(f"column name {PART!r} is taken by the batches' folders")
    checkpoint = checkpoint or f"{target_dir.rstrip('/')}-checkpoint"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", "true")
    reader = reader.options(**(options or {}))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.format(fmt).load(source_dir)
    log: list[dict] = []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = f"{target_dir.rstrip('/')}/{PART}={batch_id}"
        obs = Observation(f"batch{batch_id}")
        batch.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
        entry = {"batch_id": batch_id, "path": out, "rows": int(obs.get.get("rows", 0))}
        log.append(entry)
        if on_batch:
            on_batch(entry)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return log


def read_ingested(spark: SparkSession, target_dir: str) -> DataFrame:
    """All batches ingested so far (without the batches' partition column)."""
    return spark.read.parquet(target_dir).drop(PART)

