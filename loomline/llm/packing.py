"""Packing: concatenate and cut.

Pass 1 encodes each task's documents, ends each with the end id and writes the ids with the partition number and the
ids before them in the partition. The partitions' totals (one row each) give global offsets by a prefix sum. Pass 2
cuts fixed windows: a document that crosses windows gives one boundary record per window. Only the very last window
has padding. No row is shuffled: order is partition by partition, as written once.

Null and empty texts give the end id alone. Repeated rows, ties and null ids are packed one by one; an empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.common import materialize, slices, table

WINDOW, END = 1024, 0


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, part, before, ids): ids as little-endian integers, ``before`` counts ids of the partition before them."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, total = tokens.coder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], coder.dtype).tobytes()
        for batch in batches:
            for some in slices(batch, 1):
                codes = [c + tail for c in coder.encode([t or "" for t in some.column(1).to_pylist()])]
                sizes = np.array([len(c) // coder.dtype.itemsize for c in codes], np.int64)
                before = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(some.num_rows, part, np.int32)), pa.array(before), pa.array(sizes), pa.array(codes, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian), ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokens.default_path(tokens.BYTE_LEVEL)
    done = materialize(encoded(docs, path, end), "encoded")
    totals = done.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokens.coder(path).dtype
        for batch in batches:
            out: list[tuple] = []
            for doc_id, part, before, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
                where, wide = base[part] + before, np.frombuffer(ids, dtype).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(where + start, window)
                    length = min(window - offset, n - start)
                    piece = wide[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return done.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
