"""Ranks inside groups that one task needn't hold: salted top k, and full ranks by range buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, part: list[str], k: int, *order: Column, shares: int = 64) -> DataFrame:
    """The first k rows of each group. A group is cut into shares by a hash of the row, each reduced to k first."""
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares))).withColumn("_n", place(*part, "_share")).where(F.col("_n") <= k)
    return some.withColumn("_n", place(*part)).where(F.col("_n") <= k).drop("_n", "_share")


def rank_in_groups(rows: DataFrame, part: list[str], bucket: Column, *order: Column, name: str = "rank") -> DataFrame:
    """Every row with its rank in its group. ``bucket`` must rise with the order (equal rows in one bucket), so that a
    task ranks one bucket of a group and the rows of earlier buckets are counted, one row per bucket."""
    cut = rows.withColumn("_bucket", bucket)
    counts = cut.groupBy(*part, "_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*part, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(*order))
    return cut.withColumn("_inner", inner).join(base, [*part, "_bucket"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_bucket", "_inner", "_base")
