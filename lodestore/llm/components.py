"""Connected components by alternating large-star and small-star, as DataFrame aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.shared import stash_at, unstash


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour larger than a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``edges(u, v)``; a component is its smallest node.

    Nodes are longs. Null ends and loops are ignored, repeated links count once; no links give no rows. Every round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").select("u", "v").distinct()
    now, path = stash_at(edges, "links", compact=True)
    seen = None
    while True:
        nxt = _small_star(_large_star(now).where("u <> v")).where("u <> v").distinct()
        out, out_path = stash_at(nxt, "links", compact=True)
        # an unchanged sum over all links means that neither star moved one
        sign = out.select(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first()
        unstash(spark, path)
        now, path = out, out_path
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
