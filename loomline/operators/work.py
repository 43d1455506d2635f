"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

T = TypeVar("T")


def pieces(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in parts with about ``limit`` bytes of text each: only one part's texts are Python strings at a time."""
    text = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in text), np.full(batch.num_rows, 64)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def flat_mapped(rows: DataFrame, one: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``one`` makes of each row, Arrow batches in and out, in pieces on both sides."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = [x for row in part.to_pylist() for x in one(row)]
                columns = list(zip(*out)) or [()] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    return rows.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, label: str = "work") -> str:
    """A new folder below ``spark.checkpoint.dir``; only local mode may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table, for what is used twice and costs more to make than to read."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _files(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, path: str, kind: str, make: Callable[[DataFrame], T], rows: Callable[[T], DataFrame]) -> T:
    """What ``make`` built from the table at ``path``, built once per application and state of its files (names, sizes,
    times), and again if its own table (``rows``) is gone."""
    place, files = _files(spark, path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(place)))
    key = (spark.sparkContext.applicationId, path, kind, state)
    known = _KEPT.get(key)
    if known is not None:
        own = rows(known).inputFiles()
        if own:
            first, where = _files(spark, own[0])
            known = known if where.exists(first) else None
    if known is None:
        known = _KEPT[key] = make(spark.read.parquet(path))
    return known
