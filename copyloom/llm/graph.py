"""Connected components of a table of links, without a driver or task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import stored


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on the smallest one: of each node's larger ones, or of each node and its smaller ones."""
    near = edges
    if both_ways:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u").withColumn("m", F.least("u", "m"))
    if both_ways:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`a, b` → `id, component_id` (smallest id reachable) for every linked id.

    Alternating large and small stars: each round reduces before it shuffles and
    is stored in the shared folder; the number of rounds grows with the
    logarithm of the longest chain. Links of an id with itself or null don't count.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        edges = stored(_stars(_stars(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
