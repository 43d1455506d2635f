"""Property-graph steps as joins: both directions of relations and expansion by two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(relations: DataFrame) -> DataFrame:
    """(rel, src, dst) in both directions."""
    return relations.select("rel", "src", "dst").union(relations.select("rel", F.col("dst").alias("src"), F.col("src").alias("dst")))


def expand(relations: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(node, depth, rel): nodes reached from ``start`` (column node); of several relations the smallest one counts."""
    edges = both_ways(relations)
    seen = start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("rel"))
    frontier = start
    for hop in range(1, hops + 1):
        found = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "rel").join(seen.select("node"), "node", "left_anti")
        first = found.groupBy("node").agg(F.min("rel").alias("rel")).select("node", F.lit(hop).alias("depth"), F.col("rel").cast("long"))
        seen = seen.unionByName(first)
        frontier = first.select("node")
    return seen.where("depth > 0")


def degrees(relations: DataFrame) -> DataFrame:
    return both_ways(relations).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def first_relation(relations: DataFrame, key: list[str], order: str) -> DataFrame:
    return relations.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
