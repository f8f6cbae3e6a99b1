"""File scans: Parquet (S1), CSV (S2), JSON (S3).

All are plain ``spark.read`` calls, so the scan is split into tasks by the
input splits (``spark.sql.files.maxPartitionBytes``), filters and column
selection reach the Parquet reader, and nothing is downloaded whole first.
An explicit schema is preferred for CSV/JSON: inference costs an extra pass
over the data (``samplingRatio`` bounds it when inference is wanted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


# One set of options for CSV snapshots, to write and to read: with it empty
# strings, nulls, outer blanks, quotes, backslashes and newlines come back as
# they were.  A file with quoted newlines can't be split, so writers bound
# the rows of a file.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CSV_SNAPSHOT = {**TIMES, "header": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "",
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_SNAPSHOT_READ = {**CSV_SNAPSHOT, "multiLine": "true"}
CSV_FILE_ROWS = 500_000


def scan_parquet(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None, where: Column | str | None = None,
                 merge_schema: bool = False) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df


def scan_csv(spark: SparkSession, path: str | Sequence[str],
             schema: T.StructType | str | None = None, header: bool = True,
             infer: bool = True, sampling_ratio: float = 1.0, **options) -> DataFrame:
    reader = spark.read.option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", "true").option("samplingRatio", sampling_ratio)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def scan_json(spark: SparkSession, path: str | Sequence[str],
              schema: T.StructType | str | None = None, array: bool = False,
              **options) -> DataFrame:
    """JSON Lines by default; ``array=True`` reads files holding one JSON
    array of records (each file is then a single, unsplittable task)."""
    reader = spark.read.option("multiLine", str(array).lower())
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.json(path)
