"""Small helpers that several operators share: inputs, shared work folder, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ``[\x20\x09-\x0D]`` matches. ``bytes.split()`` and ``bytes.strip()`` use the same six characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB unless the session says otherwise; Spark's own 64 MB take some hundred MB of every task."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folders_by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``folders_by`` names a column with few values that gets a folder per value, so that a filter on it prunes files.
    Spark deletes the shuffle files of the write as soon as the table stands, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    small_batches(spark)
    path, before = new_path(spark, label), spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.options(**options).parquet(path, partitionBy=folders_by)
    finally:
        spark.conf.unset(CLEANUP_SETTING) if before is None else spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_row``, so that their names can't clash with an operator's own."""
    return F.struct(*[df[c] for c in df.columns]).alias("_row")


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no lazily evaluated result needs any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, value: Column) -> DataFrame:
    """Per (group, bucket): the sum of ``value`` in all earlier buckets of the group, as ``base``.

    Each task sums its own rows first, so one row per bucket is shuffled; the window sees one row per bucket.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    order = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(order), F.lit(0)).cast("long").alias("base"))


def bloom(places: DataFrame, bits: int) -> bytes:
    """A Bloom filter of 2**bits bits, those at the ``p`` of ``places`` set; its size does not depend on the data."""
    words = places.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("v"))
    got = words.toArrow()
    out = np.zeros(1 << max(0, bits - 5), np.uint32)
    out[got["word"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return out.tobytes()


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts with about ``limit`` bytes of text each, so that few texts are Python strings at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
