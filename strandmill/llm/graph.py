"""Connected components of edge tables by alternating large and small stars.

Each round joins every node with the least of its neighbours, which is an aggregate with partial sums, so a node with
very many neighbours is no hot spot; rounds follow the logarithm of the longest path.  Edges stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, durable


def _stars(edges: DataFrame, large: bool, scratch: list[str]) -> DataFrame:
    """Hang each node's neighbours (the larger ones, or the smaller ones and itself) on the least of them.

    The least neighbours are written before they are joined, so that a node with very many is a skewed join of two
    tables, which adaptive execution deals to several tasks.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = durable(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), scratch)
    moved = near.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """node, component_id (the least node that is reachable) for all nodes of edges (u, v); loops and repeats do no harm.

    kept: a list that learns the folder of the result.
    """
    spark, mine = edges.sparkSession, []
    edges = durable(edges.select("u", "v").where("u <> v").distinct(), mine)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
    seen = None
    now = mark(edges)
    while now != seen and now[0]:
        scratch, mine = mine, []
        half = durable(_stars(edges, True, scratch), scratch)
        edges = durable(_stars(half, False, scratch), mine)
        seen, now = now, mark(edges)
        discard(spark, scratch)
    if kept is not None:
        kept += mine
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id"))).distinct()
