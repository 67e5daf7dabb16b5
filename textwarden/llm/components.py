"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.sources.checkpoints import cut_lineage, let_go


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame) -> DataFrame:
    """Tie what stands next to u, and u, to the least of them all; pairs: u, v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges u, v (longs).

    Rounds tie nodes to ever smaller neighbours until the edges are stars around the
    smallest nodes. Each is two joins on partially aggregated minima, written to the shared
    folder; hubs are rows of a join, never a list. The driver sees a count and a sum a
    round. Loops name nodes of their own component; an empty input gives no rows.
    """
    edges = cut_lineage(edges.select("u", "v"))
    nodes = cut_lineage(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    given, edges = edges, cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    let_go(given)
    before = None
    while (now := _state(edges)) != before:
        before = now
        large = _star(_both_ways(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        small = _star(large.where("u > v"))
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        old, edges = edges, cut_lineage(tied.where("u > v").distinct())
        let_go(old, large)
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
