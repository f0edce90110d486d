"""Connected components of an edge table by alternating large and small stars, with every round in a scratch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import discard, materialize


def _star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node u to the smallest node among u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node u, and u, to the smallest of them. In edges, u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    rest = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return rest.union(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge (u, v); root is the smallest node of its component.

    The joins are on u with one pre-aggregated side, so adaptive execution can split a node with very many neighbours.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        following = materialize(_small(_star(now)), "cc")
        discard(spark, now)
        now, before = following, mark
        # Converged when every node has one edge, to a node that has none itself: a star for each component.
        mark = now.agg(F.count("u"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
