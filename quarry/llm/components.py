"""Connected components of a table of links, by alternating large-star and
small-star steps (each a grouped minimum and a join, so a node of many links
is aggregated before it is shuffled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import staged


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in a link; the component is the least
    node.  Links may repeat, run either way or join a node to itself."""
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "cc")
    last = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        # large star: the larger neighbours of u hang on u's least neighbour
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # small star: u and its smaller neighbours hang on the least of them
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u != v").distinct(), "cc")
        now = _checksum(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
