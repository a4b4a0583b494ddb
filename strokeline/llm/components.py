"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge: then components are stars around their smallest nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("edges")).where("up > 0 and edges > 1").count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node it reaches) of every node of the edges.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour, until all
    edges lead to a component's smallest node, which is looked at after each round; rounds grow with the logarithm of a component's size. Edges are narrow rows that stay distributed, and each
    round is written to the shared folder, so a lost executor costs no more than a round. Null ends are left out.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = written(now.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u")
        small = inner.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges")
        dropped(spark, now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
