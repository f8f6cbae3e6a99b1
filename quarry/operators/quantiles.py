"""Exact quantiles of huge groups, and a mergeable sketch beside them.

``percentile`` keeps every distinct value of a group in one task.  Here order
statistics are found by narrowing: a pass lays some hundred edges (values of
the group, from a mergeable sketch of what is left) over the open interval
that holds a wanted rank, counts exactly how many rows fall between them and
on them, and keeps the one interval the rank is in.  What is left shrinks a
hundredfold a pass; a rank that falls on an edge is found, and of the rest a
few thousand values are sorted.  The sketch only proposes edges: a poor one
costs a pass, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import col_ref
from quarry.operators.ranges import free_names
from quarry.session import scratch_path

EDGES = 128
SMALL = 4096


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, "quantiles", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, as sides ``a`` and ``b``; Spark
    broadcasts the smaller by its size or splits a hot group's partition."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.alias("a").join(b.alias("b"), cond)


def order_statistics(rows: DataFrame, sizes: DataFrame, ranks: DataFrame, groups: Sequence[str], edges: int = EDGES, small: int = SMALL) -> DataFrame:
    """(groups, k, x): the value of rank ``k`` (from 0) for every row of
    ``ranks`` (groups, k).  ``rows`` has the groups and ``v``, a double
    without nulls and NaN, ``sizes`` the groups and ``n``, their rows."""
    own = [*groups, "below"]  # an open interval: its group and how many rows lie before it
    live = _meet(rows, sizes, groups).select("a.*", F.lit(0).cast("long").alias("below"), F.col("b.n").alias("inside"))
    ranks = ranks.select(*groups, "k", F.lit(0).cast("long").alias("below"))
    share = F.array(*(F.lit(i / edges) for i in range(edges + 1)))
    found = None
    while True:
        tiny = live.where(F.col("inside") <= small).groupBy(*own).agg(F.sort_array(F.collect_list("v")).alias("xs"))
        tiny = _meet(ranks, tiny, own).select(*(f"a.{g}" for g in groups), "a.k", F.element_at("b.xs", (F.col("a.k") - F.col("a.below") + 1).cast("int")).alias("x"))
        found = tiny if found is None else found.unionAll(tiny)
        big = live.where(F.col("inside") > small)
        laid = _staged(big.groupBy(*own).agg(F.array_distinct(F.percentile_approx("v", share, 8 * edges)).alias("e")), "edges")
        if laid.isEmpty():
            return found
        # class 2i + 1 is edge i, class 2i lies before it
        between = 2 * F.size(F.filter("b.e", lambda e: e < F.col("a.v"))) + F.array_contains("b.e", F.col("a.v")).cast("int")
        classed = _meet(big, laid, own).select("a.*", between.alias("c"))
        upto = Window.partitionBy(*own).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = classed.groupBy(*own, "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
        counts = counts.withColumn("end", F.col("below") + F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
        hit = _staged(_meet(ranks, counts, own).where("k >= start AND k < end").select("a.*", "b.c", "b.start", "b.n", "b.low"), "hits")
        found = found.unionAll(hit.where("c % 2 = 1").select(*groups, "k", F.col("low").alias("x")))
        kept = hit.where("c % 2 = 0")
        ranks = kept.select(*groups, "k", F.col("start").alias("below"))
        live = _staged(_meet(classed, kept.select(*own, "c", "start", "n").distinct(), [*own, "c"])
                       .select(*(f"a.{g}" for g in groups), "a.v", F.col("b.start").alias("below"), F.col("b.n").alias("inside")), "live")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], continuous: bool = True,
                    edges: int = EDGES, small: int = SMALL, names: tuple[str, str] = ("p", "q")) -> DataFrame:
    """A row per group and probability: by, ``p``, ``q`` (or other ``names``).

    ``continuous`` interpolates between the two ranks around p (n - 1), as
    ``percentile`` and ``quantile_cont`` do; else q is the value at rank
    ceil(p n), as ``percentile_disc``.  Values are taken as doubles; nulls
    and NaN don't count; a group without values has no row.  No task holds more
    than some ``small`` values of a group."""
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    groups = [f"g{i}" for i in range(len(by))] or ["g0"]  # one group of all where none is named
    named = [col_ref(b) for b in by] or [F.lit(0)]
    x = col_ref(value).cast("double")
    rows = df.select(*(c.alias(g) for c, g in zip(named, groups)), x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = _staged(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = sizes.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in dict.fromkeys(probs)))))
    place: Column = F.col("p") * (F.col("n") - 1) if continuous else F.greatest(F.ceil(F.col("p") * F.col("n")) - 1, F.lit(0)).cast("double")
    wanted = wanted.withColumn("h", place).withColumns({"lo": F.floor("h"), "hi": F.ceil("h")})
    ranks = wanted.select(*groups, F.explode(F.array("lo", "hi")).alias("k")).distinct()
    # staged: both ends of a quantile read the same answers
    stats = _staged(order_statistics(rows, sizes, ranks, groups, edges, small), "answers")
    for side, name in (("lo", "x0"), ("hi", "x1")):
        wanted = _meet(wanted.withColumn("k", F.col(side)), stats, [*groups, "k"]).select("a.*", F.col("b.x").alias(name)).drop("k")
    q = F.when(F.col("lo") == F.col("hi"), F.col("x0")).otherwise(F.col("x0") * (F.col("hi") - F.col("h")) + F.col("x1") * (F.col("h") - F.col("lo")))
    return wanted.select(*(F.col(g).alias(b) for g, b in zip(groups, by)), F.col("p").alias(names[0]), q.alias(names[1]))


def sketch_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], error: float = 0.001) -> DataFrame:
    """As ``exact_quantiles`` by one pass and a mergeable summary: ``q`` is a
    value of the group whose rank is within ``error`` n of p n."""
    probs = list(dict.fromkeys(probs))
    (rows,) = free_names(1, df)
    x = col_ref(value).cast("double")
    kept = df.withColumn(rows, F.when(~F.isnan(x), x)).groupBy(*map(col_ref, by)).agg(
        F.percentile_approx(rows, F.array(*(F.lit(float(p)) for p in probs)), int(1 / error) + 1).alias(rows))
    return kept.where(F.col(rows).isNotNull()).select(*map(col_ref, by), F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in probs)).alias("p"), F.col(rows).alias("q"))).alias(rows)) \
        .select(*map(col_ref, by), f"{rows}.p", f"{rows}.q")
