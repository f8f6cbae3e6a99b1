"""Sinks: chunked, combined, export, coercion, accounting, dispatch."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.session import list_files
from quarry.sinks.writers import (export_result, write_chunked, write_combined, write_destination,
                                  write_snapshot)
from quarry.sources.records import coerce_mixed_types


def test_chunked_no_file_above_cap(spark, tmp_dir):
    df = spark.range(25000).withColumn("v", F.col("id") * 2)
    m = write_chunked(df, tmp_dir, chunk_rows=10000)
    assert m["total_rows"] == 25000
    counts = [spark.read.parquet(f).count() for f in list_files(spark, tmp_dir)]
    assert sum(counts) == 25000 and max(counts) <= 10000
    assert spark.read.parquet(tmp_dir).count() == 25000  # the whole directory is the snapshot


def test_multi_part_snapshot_three_files(spark, tmp_dir):
    df = spark.range(25000).coalesce(1)
    m = write_chunked(df, tmp_dir, chunk_rows=10000)
    assert m["total_chunks"] == 3 and len(m["files_written"]) == 3
    assert spark.read.parquet(tmp_dir).count() == 25000


def test_text_snapshots_keep_values_and_types(spark, tmp_dir):
    from datetime import date, datetime

    from quarry.catalog import read_snapshot_path
    df = spark.createDataFrame(
        [("", " x ", "a\"b\\c", "l1\nl2\r\nl3", "00123", None, 1, date(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5, 678901)),
         (None, "\r\n", "\\", "'q',\"", "\\n", None, None, None, None)],
        "a string, b string, c string, d string, e string, nothing string, n long, day date, at timestamp")
    for fmt in ("csv", "json"):
        write_snapshot(df, tmp_dir + fmt, fmt)
        back = read_snapshot_path(spark, tmp_dir + fmt, fmt)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_combined_single_file_at_any_size(spark, tmp_dir):
    df = spark.range(100).repartition(4)
    m = write_combined(df, tmp_dir)
    assert m["total_chunks"] == 1 and m["total_rows"] == 100


def test_empty_input_gives_typed_snapshot(spark, tmp_dir):
    df = spark.createDataFrame([], "a int, b string")
    m = write_snapshot(df, tmp_dir)
    back = spark.read.parquet(tmp_dir)
    assert m["total_rows"] == 0 and back.count() == 0 and back.columns == ["a", "b"]


def test_compression_rules(spark, tmp_dir):
    df = spark.range(10)
    write_snapshot(df, tmp_dir + "/gz", "csv", "gzip")
    write_snapshot(df, tmp_dir + "/plain", "csv", "snappy")
    write_snapshot(df, tmp_dir + "/none", "parquet", "none")
    assert all(f.endswith(".gz") for f in list_files(spark, tmp_dir + "/gz"))
    assert not any(f.endswith(".gz") for f in list_files(spark, tmp_dir + "/plain"))
    assert spark.read.parquet(tmp_dir + "/none").count() == 10
    with pytest.raises(ValueError, match="Unsupported format"):
        write_snapshot(df, tmp_dir + "/x", "excel")


def test_coerce_mixed_types(spark, tmp_dir):
    df = spark.createDataFrame([(1, [1.5, 2.0], {"k": 1}, float("nan"))],
                               "id int, arr array<double>, m map<string,int>, x double")
    out = coerce_mixed_types(df, "csv")
    row = out.first()
    assert row.arr == "[1.5,2.0]" and row.m == '{"k":1}' and row.x is None
    write_snapshot(df, tmp_dir, "csv")  # nested columns no longer block a CSV write
    assert spark.read.option("header", "true").csv(tmp_dir).count() == 1


def test_export_errors(spark, tmp_dir):
    empty = spark.range(5).where("id < 0")
    with pytest.raises(ValueError, match="no results"):
        export_result(empty, tmp_dir, "csv")
    with pytest.raises(ValueError, match="Unsupported export format"):
        export_result(spark.range(3), tmp_dir, "excel")
    m = export_result(spark.range(3), tmp_dir, "json")
    assert m["total_chunks"] == 1


def test_destination_dispatch(spark, tmp_dir):
    df = spark.read.parquet(f"{SF001}/nation.parquet")
    m = write_destination(df, {"type": "files", "path": tmp_dir}, {"format": "json"}, run_id="r1")
    assert m["output_path"].endswith("/r1") and m["total_rows"] == 25
    m2 = write_destination(df, {"type": "files", "path": tmp_dir}, {"chunked": True}, run_id="r2")
    assert m2["total_rows"] == 25
    with pytest.raises(ValueError, match="Unsupported destination type"):
        write_destination(df, {"type": "ftp"}, {})


def test_observed_metrics(spark, tmp_dir):
    m = write_snapshot(spark.range(10), tmp_dir, observe=[F.sum("id").alias("s")])
    assert m["observed"]["s"] == 45 and m["total_rows"] == 10
    assert os.path.isdir(tmp_dir.replace("file:", ""))


def test_spread_narrow_only_when_few_partitions_and_enough_data(spark):
    from quarry.sinks.writers import spread_narrow
    cores = spark.sparkContext.defaultParallelism
    big_narrow = spark.range(0, 20_000_000, 1, 1)      # ~160 MB estimate, one partition
    assert spread_narrow(big_narrow).rdd.getNumPartitions() == cores
    tiny = spark.range(0, 100, 1, 1)                    # far below 1 MB per core
    assert spread_narrow(tiny).rdd.getNumPartitions() == 1
    wide = spark.range(0, 20_000_000, 1, cores * 2)     # already spread: no exchange
    out = spread_narrow(wide)
    assert out.rdd.getNumPartitions() == cores * 2
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
