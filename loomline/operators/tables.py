"""Keyed-table maintenance: upserts, replacement, cascades, retention, eviction, sequence numbers, integrity checks.

All take and return DataFrames; a caller writes the result. Keys are compared null-safely nowhere: keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.ranking import rank_in_groups
from loomline.operators.work import written


def keep_latest(rows: DataFrame, key: list[str], *recency: Column) -> DataFrame:
    """One row per key: the first by the given order. A single shuffle by key."""
    first = Window.partitionBy(*key).orderBy(*recency)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], protect: Column | None = None) -> DataFrame:
    """Insert new keys, replace old rows of known keys, except old rows for which ``protect`` holds."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    guarded = F.col("_new") if protect is None else F.when((F.col("_new") == 0) & protect, 2).otherwise(F.col("_new"))
    return keep_latest(both.withColumn("_new", guarded), key, F.col("_new").desc()).drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and those new rows whose key isn't there yet."""
    return old.unionByName(new.join(old, key, "left_anti"))


def replace_partition(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Rows of ``old`` whose partition ``new`` doesn't hold, and all of ``new``."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children less the keys in ``gone`` (one column named ``parent_key``)."""
    return parents.join(gone, parent_key, "left_anti"), children.join(gone.withColumnRenamed(parent_key, child_key), child_key, "left_anti")


def evict(rows: DataFrame, capacity: int, first_out: Column, bucket: Column, *age: Column) -> DataFrame:
    """At most ``capacity`` rows: those for which ``first_out`` holds leave first, oldest first.

    ``bucket`` rises with the age order (a day, say). Rows are ranked inside (first_out, bucket) and buckets are
    counted, so no task orders all rows and nothing is subtracted.
    """
    excess = rows.count() - capacity
    if excess <= 0:
        return rows
    marked = rows.withColumn("_all", F.lit(0))
    place = F.struct(F.when(first_out, 0).otherwise(1).alias("late"), bucket.alias("b"))
    return rank_in_groups(marked, ["_all"], place, *age, name="_rank").where(F.col("_rank") > excess).drop("_rank", "_all")


def next_numbers(old: DataFrame, new: DataFrame, part: str, number: str, order: str) -> DataFrame:
    """Number ``new`` rows per ``part`` after the highest number in ``old``."""
    top = old.groupBy(part).agg(F.max(number).alias("_top"))
    at = F.row_number().over(Window.partitionBy(part).orderBy(order))
    return new.join(top, part, "left").withColumn(number, (F.coalesce("_top", F.lit(0)) + at).cast("long")).drop("_top")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent: the integrity check behind a foreign key."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> Column:
    """Multiset equality as a one-row DataFrame (equal boolean)."""
    only = a.exceptAll(b).select(F.lit(1).alias("x")).unionAll(b.exceptAll(a).select(F.lit(1).alias("x")))
    return only.agg((F.count("*") == 0).alias("equal"))


def same_sequence(a: DataFrame, b: DataFrame, value: str, order_a: Column, order_b: Column) -> DataFrame:
    """Equality of two results in order as a one-row DataFrame: place by place, by a range sort without one task's window."""

    def placed(rows: DataFrame, order: Column) -> DataFrame:
        whole = written(rows.orderBy(order).select(value).withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        sizes = whole.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition
        base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return whole.withColumn("_part", part).join(F.broadcast(base), "_part").select(value, (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_place"))

    return same_rows(placed(a, order_a), placed(b, order_b))
