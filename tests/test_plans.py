"""Plan shapes that matter at scale: pruned, filtered scans; one exchange for
a profile; no all-pairs operators; the big side of the flagship join is
exchanged once."""

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators.asof import asof_join
from quarry.operators.profile import profile_columns
from quarry.operators.transform import run_transformation
from quarry.plans.checks_query import flagship
from quarry.plans.query import run_sql
from quarry.plans.registry import table_refs

ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    """The executed plan; after AQE ran, only its final form."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = run_sql(spark, table_refs(SF001, "lineitem"), """
        SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem
        WHERE l_quantity < 10""", cap=None).df
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,10.0)]" in plan
    read = plan[plan.index("ReadSchema:"):].split("\n")[0]
    assert read.count(":") == 5  # ReadSchema + 4 columns: key, price, discount, quantity
    assert "l_shipdate" not in read and "l_comment" not in read


def test_profile_is_one_scan_one_exchange(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    plan = _plan(profile_columns(li, with_samples=False))
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
    assert "Expand" not in plan and "SortMergeJoin" not in plan
    assert plan.count("FileScan parquet") == 1


def test_profile_from_observed_stats_has_no_range_sort(spark):
    # ingest passes stats built from observed metrics (a small local frame
    # spread over several partitions): the per-column rows are ordered in
    # one partition, with no range-partitioning exchange or sampling job
    from quarry.operators.profile import column_stats
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    stats = column_stats(li).repartition(4)
    prof = profile_columns(li, stats=stats, with_samples=False)
    rows = prof.collect()
    assert [r["ordinal"] for r in rows] == sorted(r["ordinal"] for r in rows)
    assert "rangepartitioning" not in _plan(prof).lower()


def test_profile_joins_are_bounded_broadcasts(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    k = spark.createDataFrame([("l_tax", "Tax rate", None, None)],
                              "column_key string, description string, "
                              "business_meaning string, verified_at timestamp")
    prof = profile_columns(li, k)
    prof.collect()
    plan = _plan(prof)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "BroadcastHashJoin" in plan


def test_flagship_exchanges_lineitem_once(spark):
    df = flagship(spark, SF001)
    df.collect()
    plan = _plan(df)
    li_scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "l_orderkey" in ln]
    assert len(li_scan) == 1
    assert "l_extendedprice" in li_scan[0] and "l_shipdate" not in li_scan[0]
    assert not any(op in plan for op in ALL_PAIRS)


def test_asof_and_range_plans_have_no_all_pairs(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    s = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("sid"), F.col("user_id").alias("su"), F.col("ts").alias("sts"))
    a = asof_join(p, s, [("user_id", "su")], "ts", "sts", tiebreak=["sid"])
    a.collect()
    assert not any(op in _plan(a) for op in ALL_PAIRS)
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_totalprice")
    c = spark.read.parquet(f"{SF001}/customer.parquet").select(
        "c_custkey", (F.col("c_acctbal") * 10).alias("lo"), (F.col("c_acctbal") * 10 + 500).alias("hi"))
    r = run_transformation(spark, {"sources": [{"alias": "o"}, {"alias": "c"}],
                                   "join": {"left": "o", "right": "c", "how": "inner",
                                            "on": "o.o_totalprice >= c.lo AND o.o_totalprice < c.hi"}},
                           frames={"o": o, "c": c})
    r.collect()
    assert not any(op in _plan(r) for op in ALL_PAIRS)
