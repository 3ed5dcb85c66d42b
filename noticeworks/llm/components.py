"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two joins and two aggregations whose results are written to the shared folder, so neither the
edges nor the components ever pass through the driver. The number of rounds grows with the logarithm of the
longest path. A hub's edges are one key of these joins, dealt to parts; see spread_join. Where the nodes are few, they are
broadcast instead, so that a small table isn't cut into many small tasks and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_join, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each there once, are stars already: no node has two parents, and no parent has one."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    at = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return at.filter("up > 1 or up = 1 and down = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    return few_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = few_join(edges, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node of its component.

    edges: columns u and v of one orderable type. Self links, repeated edges and nulls are allowed and add
    nothing; an empty table gives an empty result. Nodes without an edge to another node aren't returned.
    """
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        if _settled(links):
            break
        links = materialize(_small_star(materialize(_large_star(links), "links")), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
