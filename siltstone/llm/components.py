"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included. Distinct."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("larger"))
    return larger.join(least, "u").select(F.col("larger").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. One row for each of edges, the node's own for the edge to the least."""
    least = _least(edges)
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Of edges with u > v: whether each u has one v and is no v. Then v is the least node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    nodes = ends.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max(F.col("to").isNull()).alias("below"))
    return nodes.agg(F.coalesce(F.max((F.col("least") < F.col("most")) | (F.col("least").isNotNull() & F.col("below"))), F.lit(False))).first()[0] is False


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v long; those with u = v don't count, and edges may repeat. One row (id, component) per node that has an edge; component is the least node reachable.

    Each round is a table in the shared folder. Rounds grow with the logarithm of the longest path; stars that point at their
    least node need none. Ends when all is such stars, which one aggregate tells: a round more to see that nothing changes
    would be several stages, and each stage and each small join costs the driver's heap a broadcast. Edges are made distinct once a round,
    between its steps, and not when they are staged: on small tables a round's time is that of its shuffles."""
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while not _are_stars(now):
        now = staged(_small_star(_large_star(now)), "edges")
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))
    return now.select(F.inline(ends)).groupBy("id").agg(F.min("component").alias("component"))
