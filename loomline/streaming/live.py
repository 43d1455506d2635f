"""Live indexing and windowed counts with Structured Streaming; micro-batches run the batch operators.

Results are tables in a folder that driver and executors share, written by ``foreachBatch`` under the batch's number,
so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import transcripts
from loomline.operators.work import shared_folder  # noqa: F401  (plans take it from here)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A table as a stream of its files; ``path`` may be a file or a folder, so it is given as a pattern that fits just it."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


BUCKETS = 32  # folders that conversations are kept in


def _bucket() -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def index_live(stream: DataFrame, folder: str) -> None:
    """Chunks of conversations as their turns arrive (available data, then stop); ``live_chunks`` reads them.

    A micro-batch keeps its turns under its number and chunks the conversations that it touches anew, from all their
    turns so far, so that a conversation split over batches is chunked as a whole. Only folders of touched conversations
    are read. A batch that runs again replaces its own turns and chunks.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/turns/batch={number}")
        turns = spark.read.option("basePath", f"{folder}/turns").parquet(f"{folder}/turns").where(F.col("batch") <= number)
        now = turns.where(F.col("batch") == number).select("conv_id", "bucket").distinct()
        buckets = [r["bucket"] for r in now.select("bucket").distinct().collect()]  # ``BUCKETS`` at most
        touched = turns.where(F.col("bucket").isin(buckets)).join(now.select("conv_id"), "conv_id", "left_semi").drop("batch", "bucket")
        chunks = transcripts.chunk_turns(transcripts.preprocess(transcripts.segments(touched)))
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        now.select("conv_id").write.mode("overwrite").parquet(f"{folder}/touched/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def live_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each conversation as of the last batch that touched it."""
    newest = spark.read.parquet(f"{folder}/touched").groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/chunks").join(newest, ["conv_id", "batch"]).drop("batch")


def windowed_counts(stream: DataFrame, folder: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> None:
    """Counts and sums per window and event type; ``slide`` makes windows overlap. ``newest_counts`` reads them.

    Each batch writes the windows that it changed under its number (update mode), so nothing is rewritten, and a batch
    that runs again replaces its own rows. Windows that end more than ``late`` before the newest event leave the state;
    rows for them come too late and are dropped.
    """
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def newest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(start, event_type, n, total) of each window as last updated."""
    rows = spark.read.parquet(f"{folder}/counts").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return rows.select("start", "event_type", "r.n", "r.total")


def append_stream(rows: DataFrame, folder: str) -> None:
    """Write a stream's rows as Parquet until the available data is read."""
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
