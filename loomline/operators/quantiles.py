"""Exact quantiles of groups of any size by distributed selection.

What is wanted is the value at some ranks. Groups of up to ``LIMIT`` rows are ranked as they are. In a larger one each
round cuts the range that holds a rank into ``BUCKETS`` parts between its least and greatest value, counts them (inside
the tasks first) and goes on with the one part that the rank falls into; a range of one value is done. So no task gathers
or sorts a group: what is shuffled is one row per task, group, rank and bucket, and at last at most ``LIMIT`` rows.
Nulls are left out, and a null key is a group. NaN and infinite values have no place in a range: an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.work import written

LIMIT, BUCKETS = 50_000, 1024


def _ranks(kind: str, q: float) -> list[Column]:
    """The ranks from 0 in a group of ``n`` that a quantile needs."""
    n = F.col("n")
    if kind == "linear":  # between two values
        return [F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q))]
    if kind == "floor":  # at floor(n * q)
        return [F.least(n - 1, F.floor(n * F.lit(q)))]
    if kind == "least":  # the first value that a share q of the values doesn't exceed
        return [F.greatest(F.lit(0).cast("long"), F.ceil(n * F.lit(q)) - 1)]
    raise ValueError(kind)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]], limit: int = LIMIT, buckets: int = BUCKETS, rounds: list[int] | None = None) -> DataFrame:
    """(keys, one column per quantile): ``wanted`` maps a name to ("linear", "floor" or "least", share). ``rounds`` receives the ranges open in each round."""
    plain = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    legal = F.when(F.isnan("v") | (F.abs("v") == float("inf")), F.raise_error(F.lit("quantiles of NaN or infinite values"))).otherwise(F.col("v"))
    plain = plain.withColumn("v", legal)
    sizes = written(plain.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    ranks = F.array_distinct(F.array(*[r.cast("long") for kind, q in wanted.values() for r in _ranks(kind, q)]))
    state = written(sizes.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), "lo", "hi"))
    wide = (F.col("size") > limit) & (F.col("lo") < F.col("hi"))
    while opened := state.where(wide).count():
        if rounds is not None:
            rounds.append(opened)
        big = state.where(wide).select(*[F.col(k).alias(f"_{k}") for k in keys], "rank", "below", "lo", "hi")
        match = reduce(lambda x, y: x & y, [plain[k].eqNullSafe(big[f"_{k}"]) for k in keys], F.col("v").between(F.col("lo"), F.col("hi")))
        part = F.least(F.lit(buckets - 1).cast("long"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))
        found = plain.join(big, match).select(*keys, "rank", "below", part.alias("bucket"), "v")
        counts = found.groupBy(*keys, "rank", "below", "bucket").agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = Window.partitionBy(*keys, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        inside = counts.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("size")))
        state = written(state.where(~wide).unionByName(inside.drop("bucket")))
    left = state.where("lo < hi").select(*[F.col(k).alias(f"_{k}") for k in keys], "rank", "below", "lo", "hi")
    match = reduce(lambda x, y: x & y, [plain[k].eqNullSafe(left[f"_{k}"]) for k in keys], F.col("v").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys, "rank").orderBy("v")  # at most ``limit`` rows
    placed = plain.join(left, match).select(*keys, "rank", "below", "v").withColumn("at", F.row_number().over(order)).where("at = rank - below + 1").select(*keys, "rank", "v")
    values = placed.unionByName(state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
    known = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = sizes.join(known, _same(sizes, known, keys)).select(*[sizes[k] for k in keys], "n", "at")

    def result(kind: str, q: float) -> Column:
        low, *high = [F.col("at")[r.cast("long")] for r in _ranks(kind, q)]
        if not high:
            return low
        share = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        return low * (1 - share) + high[0] * share

    return out.select(*keys, *[result(kind, q).alias(name) for name, (kind, q) in wanted.items()])
