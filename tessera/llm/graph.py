"""Connected components of an undirected graph, by alternating large and small stars.

Every round replaces the edges by ones that point to smaller nodes; it ends with a star around the
smallest node of each component. Edges live in the shared folder between rounds; only a row count
and a checksum reach the driver. A hub's smallest neighbour is aggregated partially; the join that sends
it to the hub's edges is left to AQE, which splits skewed partitions (hubs apart in a broadcast join, as
join_counted has it, would double every round's plan, and the driver's memory is bounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang each larger neighbour on the smallest; small: the node and its smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("m"))
    joined = both.join(lowest, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge. Columns of edges: a, b."""
    now = materialize(edges.select("a", "b").filter("a != b").distinct(), "edges")
    before = None
    while (found := _sum(now)) != before:
        before, last = found, now
        now = materialize(_star(_star(now, True), False), "edges")
        release(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
