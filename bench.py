"""Benchmark the headline shapes at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

filter + projection on one table, customer ⋈ orders ⋈ lineitem grouped,
full column profile of lineitem; plus the as-of join and the declarative
transformation.  Each is run once to warm up, then 5 times; the median is
reported.  Results are fully executed (``noop`` sink or a small collect).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry.catalog import Catalog  # noqa: E402
from quarry.operators.asof import asof_join  # noqa: E402
from quarry.operators.profile import profile_columns  # noqa: E402
from quarry.operators.transform import run_transformation  # noqa: E402
from quarry.plans.checks_query import flagship  # noqa: E402
from quarry.plans.query import run_sql  # noqa: E402
from quarry.plans.registry import table, table_path, table_refs  # noqa: E402
from quarry.session import build_session, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def shapes(spark):
    def ingest():
        cat = Catalog(spark, scratch_path(spark, "bench-catalog"))
        did = cat.create_dataset("lineitem", {"type": "parquet",
                                              "path": table_path(SF_DIR, "lineitem")})
        res = cat.ingest(did)
        assert res["status"] == "success", res

    def filter_project():
        df = run_sql(spark, table_refs(SF_DIR, "lineitem"), """
            SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net
            FROM lineitem WHERE l_shipdate >= '1998-01-01' AND l_quantity < 10""", cap=None).df
        run_noop(df)

    def join3():
        flagship(spark, SF_DIR).collect()

    def profile():
        profile_columns(table(spark, SF_DIR, "lineitem")).collect()

    def asof():
        ev = table(spark, SF_DIR, "events")
        p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        s = ev.where("event_type = 'signup'").select(
            F.col("event_id").alias("signup_id"), F.col("user_id").alias("s_user"),
            F.col("ts").alias("signup_ts"))
        run_noop(asof_join(p, s, [("user_id", "s_user")], "ts", "signup_ts",
                           tiebreak=["signup_id"]))

    def transform():
        run_transformation(spark, {
            "sources": [{"alias": "o", "type": "parquet", "path": table_path(SF_DIR, "orders")},
                        {"alias": "l", "type": "parquet", "path": table_path(SF_DIR, "lineitem")}],
            "join": {"left": "o", "right": "l", "on": "o.o_orderkey = l.l_orderkey",
                     "how": "inner"},
            "aggregate": {"group_by": ["o.o_orderpriority"], "metrics": {
                "n": "count(*)", "qty": "sum(l.l_quantity)"}}}).collect()

    return {"ingest": ingest, "filter_project": filter_project, "join3": join3,
            "profile": profile, "asof_join": asof, "transform": transform}


def main():
    spark = build_session(f"local[{CPUS}]", CPUS * 2, app_name="quarry-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    results = {}
    for name, fn in shapes(spark).items():
        fn()  # warm-up
        times = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": CPUS,
                      "runs": RUNS}))


if __name__ == "__main__":
    main()
