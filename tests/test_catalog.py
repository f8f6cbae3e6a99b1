"""Catalog: snapshots, runs, rollups, approvals, ingest, streaming."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.catalog import Catalog, DatasetError
from quarry.sources.registry import read_source
from quarry.streaming.ingest import read_ingested, stream_ingest


@pytest.fixture()
def cat(spark, tmp_dir):
    return Catalog(spark, tmp_dir)


def test_latest_snapshot_rule(cat, spark):
    did = cat.create_dataset("d", {"type": "parquet", "path": f"{SF001}/nation.parquet"})
    for i, st in enumerate(["success", "failed", "success", "failed"]):
        cat.log_run(dataset_id=did, run_id=f"r{i}", run_seq=i, status=st,
                    output_path=f"/p{i}" if st == "success" else None)
    assert cat.latest_snapshot(did)["run_id"] == "r2"
    only_fail = cat.create_dataset("f")
    cat.log_run(dataset_id=only_fail, run_id="x", run_seq=1, status="failed")
    with pytest.raises(DatasetError, match="No successful runs"):
        cat.latest_snapshot(only_fail)
    none = cat.create_dataset("n")
    with pytest.raises(DatasetError, match="No successful runs"):
        cat.latest_snapshot(none)
    with pytest.raises(DatasetError, match="not found"):
        cat.latest_snapshot("pipe-none")


def test_run_update_newest_state(cat):
    did = cat.create_dataset("d")
    cat.log_run(dataset_id=did, run_id="r1", run_seq=1, status="running")
    cat.log_run(dataset_id=did, run_id="r1", run_seq=1, status="success", rows_processed=100)
    r = cat.run_status(did, "r1").collect()
    assert len(r) == 1 and r[0].status == "success" and r[0].rows_processed == 100


def test_ingest_profile_and_multipart(cat, spark):
    src = {"type": "synthetic", "row_count": 25000, "schema": {"id": "uuid", "n": "integer:1:9"}}
    did = cat.create_dataset("Big Synth", src, options={"chunked": True})
    res = cat.ingest(did)
    assert res["status"] == "success" and res["total_rows"] == 25000
    assert res["total_chunks"] >= 3
    assert cat.read_snapshot(did).count() == 25000  # every part, not just the first
    prof = cat.profiles().where(F.col("dataset_id") == did).collect()
    assert {r.column_name for r in prof} == {"id", "n"}
    n = [r for r in prof if r.column_name == "n"][0]
    assert n.min == 1.0 and n.max == 9.0 and n.row_count == 25000


def test_failed_ingest_logged(cat):
    did = cat.create_dataset("bad", {"type": "parquet", "path": "/no/such/dir"})
    res = cat.ingest(did)
    assert res["status"] == "failed"
    run = cat.runs().where(F.col("dataset_id") == did).first()
    assert run.status == "failed" and run.error


def test_dataset_as_source_and_transformation(cat, spark):
    did = cat.create_dataset("nations", {"type": "parquet", "path": f"{SF001}/nation.parquet"})
    cat.ingest(did)
    df = read_source(spark, {"type": "pipeline", "pipeline_id": did, "catalog": cat.root})
    assert df.count() == 25
    with pytest.raises(DatasetError, match="requires 'pipeline_id'"):
        read_source(spark, {"type": "pipeline", "catalog": cat.root})
    res = cat.register_transformation("per region", {
        "sources": [{"alias": "n", "pipeline_id": did}],
        "aggregate": {"group_by": ["n_regionkey"], "metrics": {"k": "count(*)"}}})
    assert res["status"] == "success"
    assert cat.read_snapshot(res["dataset_id"]).count() == 5  # queryable like any dataset
    roll = {r.name: r for r in cat.run_rollup().collect()}
    assert roll["per region"].total_runs == 1 and roll["per region"].source_count == 1
    tot = cat.run_totals().first()
    assert tot.n_datasets == 2 and tot.total_runs == 2


def test_approve_column_upsert(cat):
    cat.approve_column("Email", "first", "m1")
    cat.approve_column(" email ", "second", "m2", verified_by="admin")
    k = cat.knowledge().collect()
    assert len(k) == 1 and k[0].column_key == "email" and k[0].description == "second"


def test_secrets_not_stored(cat):
    did = cat.create_dataset("db", {"type": "postgres", "host": "h", "database": "d",
                                    "password": "s3cret"})
    row = cat.dataset(did)
    assert "s3cret" not in row["source"]


def test_stream_ingest_each_file_once(spark, tmp_dir):
    src = tmp_dir.replace("file:", "") + "/in"
    os.makedirs(src)
    nation = spark.read.parquet(f"{SF001}/nation.parquet")
    paths = []
    for i in range(3):
        p = f"{tmp_dir}/stage{i}"
        nation.where(F.col("n_regionkey") == i).coalesce(1).write.parquet(p)
        paths.append(p)

    def drop_in(i):
        d = paths[i].replace("file:", "")
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        shutil.copy(os.path.join(d, f), os.path.join(src, f"part{i}.parquet"))

    out, ck = tmp_dir + "/out", tmp_dir + "/ck"
    drop_in(0), drop_in(1)
    stream_ingest(spark, src, out, nation.schema, checkpoint=ck)
    assert read_ingested(spark, out).count() == 10
    drop_in(2)
    stream_ingest(spark, src, out, nation.schema, checkpoint=ck)
    stream_ingest(spark, src, out, nation.schema, checkpoint=ck)  # restart adds nothing
    got = read_ingested(spark, out)
    assert got.count() == 15 and got.distinct().count() == 15


def test_ingest_mode():
    from quarry.catalog import ingest_mode
    assert ingest_mode("postgres") == "partitioned"
    assert ingest_mode("synthetic", "auto") == "partitioned"
    assert ingest_mode("csv") == "batch"
    assert ingest_mode("csv", True) == "stream" and ingest_mode("csv", "true") == "stream"
    assert ingest_mode("postgres", False) == "batch"
    assert ingest_mode("parquet", "false") == "batch"


def test_dataset_schemas(cat, spark):
    did = cat.create_dataset("My Nations", {"type": "parquet", "path": f"{SF001}/nation.parquet"})
    cat.ingest(did)
    cat.approve_column("n_name", "Nation name")
    rows = cat.dataset_schemas([did, "pipe-none"]).orderBy("ordinal").collect()
    assert [r.column_name for r in rows] == ["n_nationkey", "n_name", "n_regionkey"]
    assert rows[0].table_alias == "my_nations" and rows[0].source == "parquet"
    assert rows[1].description == "Nation name" and rows[0].description is None
    assert len(rows[1].sample_values) == 5 and rows[0].null_percentage == 0.0


def test_query_search_and_review_by_id(cat, spark):
    nation = cat.create_dataset("World Nations", {"type": "parquet", "path": f"{SF001}/nation.parquet"}, options={"format": "csv"})
    region = cat.create_dataset("Regions", {"type": "parquet", "path": f"{SF001}/region.parquet"}, options={"combine_chunks": True})
    for did in (nation, region):
        res = cat.ingest(did)
        assert res["status"] == "success"
    assert cat.runs().where("error is not null").count() == 0
    got = cat.query([nation, region], "SELECT count(*) AS n FROM world_nations n JOIN regions r ON n.n_regionkey = r.r_regionkey").collect()
    assert got["rows"] == [{"n": 25}]
    assert cat.query([nation], "SELECT * FROM world_nations", limit=7).df.count() == 7
    with pytest.raises(DatasetError, match="not found"):
        cat.query(["none"], "SELECT 1")
    assert [r.id for r in cat.search("nations").collect()] == [nation]
    assert {r.id for r in cat.search("regionkey").collect()} == {nation, region}  # column hits
    assert region in {r.dataset_id for r in cat.profiles().collect()}  # combined files keep their profile
    n = cat.pending_reviews().count()
    cat.approve_column("r_name", "Region name")
    assert cat.pending_reviews().count() == n - 1
    cat.join_suggestions(nation, region).collect()
    with pytest.raises(DatasetError, match="not found"):
        cat.join_suggestions(nation, "none")


def test_stream_keeps_own_batch_column_and_goes_on(spark, tmp_dir):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "batch int, v string")
    df.coalesce(1).write.parquet(f"{tmp_dir}/in")
    assert sum(r["rows"] for r in stream_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", df.schema)) == 2
    assert stream_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", df.schema) == []  # no second copy
    df.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    assert sum(r["rows"] for r in stream_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", df.schema)) == 2
    assert sorted(map(tuple, read_ingested(spark, f"{tmp_dir}/out").collect())) == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]
