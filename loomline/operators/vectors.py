"""A stored vector index: inverted lists by pivot, searched exactly by the triangle inequality.

Vectors are scaled to length one, where the cosine falls as the distance grows. Pivots are vectors picked by hash, a
bounded number of them (``PIVOTS``); they need no training, as they decide only how much is read, never the result.
Each vector goes to the list (a folder) of its nearest pivot with its distance to it, and lists are sorted by that.
A query's distance to a member lies within the member's distance of the query's distance to the pivot. So a search reads
the nearest lists first, and then of each list only the ring that can hold something as near as the k-th so far.
Vectors with a null or non-finite component, or of length zero, have no direction: they are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.operators.work import kept, shared_folder

PIVOTS = 256  # at most; about the root of the number of vectors below that
_SLACK = 1e-5  # for rounding in distances and in scores of six decimals


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: the vectors' table with ``list`` and ``gap``, the distance to the list's pivot; pivots; per list its least and greatest gap."""

    rows: DataFrame
    key: str
    pivots: np.ndarray
    rings: dict[int, tuple[float, float]]

    def top(self, query: list[float], k: int, floor: float | None = None, scope: Column | None = None, leave: Column | None = None, first: int = 2, read: list[int] | None = None) -> DataFrame:
        """(key, similarity) of the k most similar vectors in ``scope``, rounded to six decimals, equal ones by key; ``leave`` are left out.

        ``read`` receives the number of lists, and of those read.
        """
        q = np.asarray(query, np.float64)
        size = np.linalg.norm(q)
        if not np.isfinite(size) or size == 0 or not self.rings:
            return self._scored(self.rows.limit(0), query)
        ways = np.linalg.norm(self.pivots - q / size, axis=1)
        least = {n: max(0.0, ways[n] - high, low - ways[n]) for n, (low, high) in self.rings.items()}
        order = sorted(least, key=lambda n: (least[n], ways[n], n))
        inside = self.rows
        for c in (scope, None if leave is None else ~F.coalesce(leave, F.lit(False))):
            inside = inside if c is None else inside.where(c)
        near = self._best(inside.where(F.col("list").isin(order[:first])), query, k, floor).collect()  # k rows
        limit = 2.0 if floor is None else float(np.sqrt(max(0.0, 2 - 2 * floor)))
        if len(near) == k:
            limit = min(limit, float(np.sqrt(max(0.0, 2 - 2 * near[-1]["similarity"]))))
        limit += _SLACK
        open_lists = [n for n in order if least[n] <= limit]
        if read is not None:
            read += [len(self.rings), len(open_lists)]
        if not open_lists:
            return self._scored(self.rows.limit(0), query)
        rings = [(F.col("list") == n) & F.col("gap").between(float(ways[n] - limit), float(ways[n] + limit)) for n in open_lists]
        ring = rings[0]
        for r in rings[1:]:
            ring = ring | r
        return self._best(inside.where(F.col("list").isin(open_lists) & ring), query, k, floor)

    def _scored(self, rows: DataFrame, query: list[float]) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in query])
        return rows.select(self.key, F.round(scores.cosine(F.col("embedding"), q), 6).alias("similarity"))

    def _best(self, rows: DataFrame, query: list[float], k: int, floor: float | None) -> DataFrame:
        found = self._scored(rows, query)
        found = found if floor is None else found.where(F.col("similarity") >= floor)
        return found.orderBy(F.desc("similarity"), self.key).limit(k)


def write_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS) -> VectorIndex:
    """The index of a table of vectors; all its columns are kept."""
    spark = vectors.sparkSession
    v = F.col(column)
    whole = vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    n = whole.count()
    width = whole.select(F.size(v).alias("n")).limit(1).collect()
    if not width:
        empty = whole.withColumn("gap", F.lit(0.0)).withColumn("list", F.lit(0))
        return VectorIndex(empty, key, np.empty((0, 0)), {})
    picked = whole.where(F.size(v) == width[0]["n"]).orderBy(F.xxhash64(key), key).limit(max(1, min(pivots, int(n**0.5)))).select(column).collect()
    centers = np.array([r[0] for r in picked], np.float64)
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            gaps = np.sqrt(np.maximum(0, 2 - 2 * x @ centers.T))
            nearest = gaps.argmin(axis=1)
            exact = np.linalg.norm(x - centers[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exact), pa.array(nearest.astype(np.int32))], [*batch.schema.names, "gap", "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields) + ", gap double, list int"
    placed = whole.where(F.size(v) == width[0]["n"]).mapInArrow(assign, schema)
    folder = shared_folder(spark, "vectors")
    placed.repartition("list").sortWithinPartitions("list", "gap").write.partitionBy("list").parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder)
    rings = {r["list"]: (r["low"], r["high"]) for r in rows.groupBy("list").agg(F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}  # a row per pivot
    return VectorIndex(rows, key, centers, rings)


def kept_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """The index of a table of vectors, written once per application and state of the table."""
    return kept(spark, path, "vectors", write_vectors, lambda index: index.rows)
