"""Exact dedup with a log-structured merge index.

1. *Memtables.* Each task reads its share of the documents into a bounded memtable keyed by the digest of the
   normalised text. A hit in the memtable is compared byte for byte on the spot. A full memtable is flushed as a run
   sorted by digest; the Parquet writer adds a Bloom filter on the digest to each run file, which ``lookup`` uses.
2. *Compaction.* Runs are merged by digest; the entry kept is the one with the most code points in the original text,
   then the smallest id (null ids last). Map-side combine leaves one entry per digest and task to shuffle.
3. *Verification.* A digest that occurs in several runs is verified on the texts: each task sends each different text
   once, guarded by a bounded Bloom filter of those digests, and the smallest and greatest text of a digest must be
   equal. Digests that fail are grouped by the whole text instead, so a collision never merges different texts.

The merge is one aggregate by digest: the runs' order and their filters serve ``lookup``, not the merge.

Nulls count as empty texts. Repeated rows are copies like any other: exactly one row of a group is kept. A very long
text passes the memtable alone. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import BLANKS, bloom, materialize, slices, table, whole_row

_BLANK_BYTES = BLANKS.encode()
_RUN_SCHEMA = pa.schema([("sha", pa.binary()), ("rid", pa.int64()), ("run", pa.int64()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("clash", pa.bool_())])


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _BLANK_BYTES)


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    rows.sort()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_SCHEMA.types)], schema=_RUN_SCHEMA)


def write_runs(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 48 << 20, memtable_rows: int = 200_000) -> DataFrame:
    """Flush the documents as sorted runs: full digest, row id, run, code points, id and whether a memtable hit differed."""

    def memtables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run, seq, held, seen, rows = part << 24, 0, 0, {}, []
        for part_of in (p for batch in batches for p in slices(batch, 1)):
            for doc_id, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist()):
                data = normalise(text)
                sha = hashlib.sha256(data).digest()
                first = seen.setdefault(sha[:digest_bytes], data)
                held += 64 + len(data) * (first is data)
                rows.append((sha, (part << 40) + seq, run, len(text or ""), doc_id, first != data))
                seq += 1
                if held > memtable_bytes or len(rows) >= memtable_rows:
                    yield _flush(rows)
                    run, held, seen, rows = run + 1, 0, {}, []
        if rows:
            yield _flush(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(memtables, "sha binary, rid long, run long, n_chars long, doc_id long, clash boolean")


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs into one entry per digest."""
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    merged = runs.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size"), F.min("run").alias("lo"), F.max("run").alias("hi"), F.max("clash").alias("clash"))
    return merged.select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.rid").alias("keep_rid"), "group_size", (F.col("lo") < F.col("hi")).alias("spread"), "clash")


def lookup(index: DataFrame, texts: list[str]) -> DataFrame:
    """Entries of the given texts; run files whose Bloom filter excludes the digests are skipped by the reader."""
    return index.where(F.col("digest").isin([bytearray(hashlib.sha256(normalise(t)).digest()) for t in texts]))


def _bloom(digests: DataFrame, bits: int) -> bytes:
    """A Bloom filter of 2**bits bits with two probes a digest."""
    probe = lambda at: F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("long") % (1 << bits)
    return bloom(digests.select(F.explode(F.array(probe(1), probe(5))).alias("p")), bits)


def _texts(docs: DataFrame, digest_bytes: int, wanted: bytes, bits: int, hold_bytes: int = 48 << 20) -> DataFrame:
    """(digest, data): each different text of a task once, as far as the filter lets its digest through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mask = np.frombuffer(shared.value, np.uint32), (1 << bits) - 1
        seen: set[tuple[bytes, bytes]] = set()
        held, out = 0, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "data"])

        for batch in (p for whole in batches for p in slices(whole, 0)):
            for text in batch.column(0).to_pylist():
                data = normalise(text)
                digest = hashlib.sha256(data).digest()[:digest_bytes]
                if all(words[p >> 5] >> np.uint32(p & 31) & np.uint32(1) for p in (int.from_bytes(digest[:4], "big") & mask, int.from_bytes(digest[4:8], "big") & mask)):
                    key = (digest, data)
                    if key not in seen:
                        seen.add(key)
                        out.append(key)
                        held += len(data) + 100
            if held > hold_bytes:
                seen, held = set(), 0
            if out:
                yield batch_of(out)
                out = []

    return docs.select(F.col("text").cast("string")).mapInArrow(scan, "digest binary, data binary")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, filter_bits: int = 24, memtable_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    ``digest_bytes`` (8 to 32) shortens the index key; results don't change, as hits are verified on the bytes.
    ``filter_bits`` bounds the broadcast filter to 2**filter_bits / 8 bytes whatever the input size.
    """
    filters = lambda c: {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": "100000"}
    runs = materialize(write_runs(docs, digest_bytes, memtable_bytes), "runs", **filters("sha")).withColumn("digest", F.substring("sha", 1, digest_bytes))
    index = materialize(compact(runs), "index", **filters("digest"))
    clashes = index.where("clash").select("digest")
    spread = index.where("spread").select("digest")
    texts = _texts(docs, digest_bytes, _bloom(spread, filter_bits), filter_bits)
    differ = texts.groupBy("digest").agg((F.min("data") != F.max("data")).alias("d")).where("d").select("digest")
    bad = materialize(clashes.union(differ).distinct(), "clashes")
    if not bad.take(1):
        return _result(runs, index)
    return _by_text(docs, runs, index, bad, digest_bytes)


def _result(runs: DataFrame, index: DataFrame) -> DataFrame:
    joined = runs.select("digest", "sha", "doc_id", "rid").join(index.select("digest", "keep_id", "keep_rid", "group_size"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _by_text(docs: DataFrame, runs: DataFrame, index: DataFrame, bad: DataFrame, digest_bytes: int) -> DataFrame:
    """Documents under a digest that different texts share: grouped by the whole normalised text."""
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "").alias("norm"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"))
    full = full.withColumn("full", F.unhex(F.sha2("norm", 256))).withColumn("digest", F.substring("full", 1, digest_bytes))
    full = materialize(full.join(bad, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id()), "clashing")
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    groups = full.groupBy("norm").agg(best.alias("b"), F.count("*").alias("group_size"))
    apart = full.join(groups, "norm").select("doc_id", F.col("b.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("b.rid")).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"))
    rest = runs.join(bad, "digest", "left_anti")
    return _result(rest, index).unionByName(apart)


def keep_first(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, all columns unchanged; of rows with equal id and equal normalised text, the longest original."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    sha = F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256)
    key = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id"))
    stay = exact_dedup(docs).where("kept").select(F.col("text_sha256").alias("_sha"), key(F.col("keep_id")).alias("_id"))
    rows = docs.select(whole_row(docs), sha.alias("_sha"), key(doc_id).alias("_id"), F.struct(-F.char_length(text), text).alias("_order"))
    return rows.join(stay, ["_sha", "_id"], "left_semi").groupBy("_sha", "_id").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
