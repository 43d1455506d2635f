"""Token ids in binary shards: a wavelet matrix per shard file.

The matrix holds one bit-plane per bit of the ids, highest first; a plane's zeros go before its ones in the next. A
stored directory counts the ones before every 512 bits of a plane, so ranks look at one block. They give access to any
token, counts of an id and its occurrences from the one compressed file, without the sequence itself.

File format, little-endian: 8 bytes ``LWM2`` + planes + word size; int64 tokens, documents and end id (-1: none); then
frames, each after its int64 length: document ids (int64, with a validity byte each); document starts in the shard
(int64), empty where every document has the end id once, as its last: starts are then found by ``select``; and per
plane the int32 directory and the packed bits. Frames are compressed by zstd.

Documents go to shards in ascending id (null ids last, repeated ids by checksum of the text): texts are ranged by id
and encoded by the task that writes their shard, so a shard holds a contiguous range. Null and empty texts hold the end
id alone; a very long text may fill a shard of its own. Extra columns are ignored. An empty table writes no file.
Shards are written under names of their own, and only the names that successful tasks report are read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.common import bucket_offsets, materialize, new_path, slices, table

END, SHARD_TOKENS, RANGE_BYTES, MAGIC = 1, 1 << 20, 256 << 20, b"LWM2"
BLOCK = 512  # bits that one entry of the directory covers
_MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64())])


class Plane:
    """A bit vector of ``n`` bits with rank and select: 64-bit words, lowest bit first, and ones before each block."""

    def __init__(self, words: np.ndarray, before: np.ndarray, n: int) -> None:
        self.words, self.before, self.n = words, before, n

    @classmethod
    def build(cls, bit: np.ndarray) -> Plane:
        packed = np.zeros(-(-len(bit) // BLOCK) * (BLOCK // 8), np.uint8)
        packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
        words = packed.view("<u8")
        ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        return cls(words, np.concatenate([[0], np.cumsum(ones)]).astype("<i4"), len(bit))

    @property
    def zeros(self) -> int:
        return self.n - int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to n)."""
        block, word = at // BLOCK, (at >> 6) % (BLOCK // 64)
        inside = np.zeros((len(at), BLOCK // 64), np.int64)
        full = block < len(self.before) - 1
        held = self.words.reshape(-1, BLOCK // 64)[block[full]]
        counts = np.bitwise_count(held).astype(np.int64)
        counts[np.arange(BLOCK // 64) >= word[full, None]] = 0
        inside[full] = counts
        part = np.zeros(len(at), np.int64)
        low = (np.uint64(1) << (at[full] & 63).astype(np.uint64)) - np.uint64(1)
        part[full] = np.bitwise_count(held[np.arange(len(held)), word[full]] & low)
        return self.before[block].astype(np.int64) + inside.sum(axis=1) + part

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones (or zeros), counted from 0."""
        blocks = np.arange(len(self.before), dtype=np.int64)
        before = self.before.astype(np.int64) if one else blocks * BLOCK - self.before
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 14):
            some = k[a : a + (1 << 14)]
            block = np.searchsorted(before, some, side="right") - 1
            held = self.words.reshape(-1, BLOCK // 64)[block]
            held = held if one else ~held
            ends = np.cumsum(np.bitwise_count(held).astype(np.int64), axis=1)
            left = some - before[block]
            word = (ends <= left[:, None]).sum(axis=1)
            left = left - np.where(word > 0, ends[np.arange(len(some)), word - 1], 0)
            bits = np.unpackbits(np.ascontiguousarray(held[np.arange(len(some)), word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bit = (np.cumsum(bits, axis=1, dtype=np.int16) <= left[:, None]).sum(axis=1)
            out[a : a + (1 << 14)] = block * BLOCK + word * 64 + bit
        return out


class WaveletMatrix:
    """Access, rank and select over a sequence of ids below 2**planes."""

    def __init__(self, planes: list[Plane], n: int) -> None:
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        made, now = [], ids
        for level in range(planes - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)).astype(bool)
            made.append(Plane.build(bit))
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(made, len(ids))

    def sequence(self) -> np.ndarray:
        """All ids in order: the last order is undone plane by plane, each in one pass."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for place, plane in enumerate(reversed(self.planes)):
            bit, zeros = plane.bits(), plane.zeros
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:zeros]
            before[np.flatnonzero(bit)] = now[zeros:] | now.dtype.type(1 << place)
            now = before
        return now

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank(at)
            out = (out << 1) | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        at = np.array([0, end], np.int64)
        for level, plane in enumerate(self.planes):
            ones = plane.rank(at)
            at = plane.zeros + ones if value >> (len(self.planes) - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def rank(self, value: int, end: int | None = None) -> int:
        """How often ``value`` occurs before ``end``."""
        lo, hi = self._range(value, self.n if end is None else end)
        return hi - lo

    def select(self, value: int) -> np.ndarray:
        """All places of ``value``, ascending: its range in the last order, mapped back plane by plane."""
        lo, hi = self._range(value, self.n)
        at = np.arange(lo, hi)
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            one = bool(value >> (len(self.planes) - 1 - level) & 1)
            at = plane.select(at - plane.zeros if one else at, one)
        return at


class Shard:
    """A shard file's matrix and documents; planes are unpacked when they are first asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self._planes, _ = struct.unpack_from("<HH", data, 4)
        self.n, self._docs, self.end = struct.unpack_from("<qqq", data, 8)
        at, self._frames = 32, []
        for _ in range(2 * self._planes + 2):
            (size,) = struct.unpack_from("<q", data, at)
            self._frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size

    def _frame(self, k: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._frames[k])

    @cached_property
    def matrix(self) -> WaveletMatrix:
        planes = [Plane(np.frombuffer(self._frame(2 * k + 3), "<u8"), np.frombuffer(self._frame(2 * k + 2), "<i4"), self.n) for k in range(self._planes)]
        return WaveletMatrix(planes, self.n)

    @cached_property
    def doc_ids(self) -> list:
        data = self._frame(0)
        known = np.frombuffer(data, np.uint8, self._docs, 8 * self._docs)
        return [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", self._docs), known)]

    @cached_property
    def starts(self) -> np.ndarray:
        """Where each document begins: after the end id of the one before it."""
        if self.end < 0:
            return np.frombuffer(self._frame(1), "<i8")
        return np.concatenate([[0], self.matrix.select(self.end)[:-1] + 1]).astype(np.int64)[: self._docs]


def to_bytes(ids: np.ndarray, doc_ids: list, starts: np.ndarray, planes: int, end: int = -1) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    matrix, out = WaveletMatrix.build(ids, planes), io.BytesIO()
    found = np.flatnonzero(ids == end) if end >= 0 else None
    closed = found is not None and np.array_equal(found, np.append(starts[1:], len(ids)) - 1)
    out.write(MAGIC + struct.pack("<HH", planes, 8) + struct.pack("<qqq", len(ids), len(doc_ids), end if closed else -1))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes(), b"" if closed else starts.astype("<i8").tobytes()]
    for plane in matrix.planes:
        parts += [plane.before.tobytes(), plane.words.tobytes()]
    for part in parts:
        frame = pack(part)
        out.write(struct.pack("<q", len(frame)) + frame)
    return out.getvalue()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards; (file, part, seq, tokens) of each. One file has ``shard_tokens`` ids or one document more."""
    path = path or tokens.default_path(tokens.WORD_END)
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = (F.col("doc_id").asc_nulls_last(), F.crc32("text"))
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = tokens.coder(path), TaskContext.get().partitionId(), 0
        dtype, tail = coder.dtype, np.array([end], coder.dtype).tobytes()
        held, ids, codes = 0, [], []
        store, root = _open(folder)
        store.create_dir(root, recursive=True)

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(c) // dtype.itemsize for c in codes], np.int64)
            name = f"shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.lwm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(np.frombuffer(b"".join(codes), dtype), ids, np.cumsum(sizes) - sizes, 8 * dtype.itemsize, end))
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "seq": seq, "tokens": int(sizes.sum())}], _MANIFEST)

        for some in (p for batch in batches for p in slices(batch, 1, 4 << 20)):
            for doc_id, code in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist())):
                ids.append(doc_id)
                codes.append(code + tail)
                held += len(codes[-1]) // dtype.itemsize
                if held >= shard_tokens:
                    yield flush()
                    held, ids, codes, seq = 0, [], [], seq + 1
        if ids:
            yield flush()

    return ranged.mapInArrow(write, "file string, part int, seq int, tokens long")


def _read(manifest: DataFrame, folder: str, one: Callable[[Shard, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``one`` makes of each shard and the ids before it. Offsets are prefix sums over the manifest."""
    base = bucket_offsets(manifest, [], "part", F.col("tokens"))  # one row per range partition
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(base, "part")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files.select("file", (F.col("base") + F.col("inner")).alias("at")).repartition(parts, "file")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as source:
                    shard = Shard(source.read())
                yield from one(shard, at)

    return files.mapInArrow(read, schema)


def _documents(shard: Shard, rows: int = 2000) -> Iterator[tuple[list, np.ndarray, list[memoryview]]]:
    """Document ids, starts and ids as 32-bit little-endian numbers, in slices."""
    starts, whole = shard.starts, shard.matrix.sequence()
    ends = np.append(starts[1:], shard.n)
    for a in range(0, len(starts), rows):
        lo, hi = int(starts[a]), int(ends[min(a + rows, len(starts)) - 1])
        data = memoryview(whole[lo:hi].astype("<u4").tobytes())
        yield shard.doc_ids[a : a + rows], starts[a : a + rows], [data[4 * (int(s) - lo) : 4 * (int(e) - lo)] for s, e in zip(starts[a : a + rows], ends[a : a + rows])]


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids) of all documents from the files; ids as 32-bit little-endian numbers."""

    def one(shard: Shard, at: int) -> Iterator[pa.RecordBatch]:
        for ids, starts, pieces in _documents(shard):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at + starts), pa.array(list(map(bytes, pieces)), pa.binary())], ["doc_id", "start", "ids"])

    return _read(manifest, folder, one, "doc_id long, start long, ids binary")


def digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents from the files."""

    def one(shard: Shard, at: int) -> Iterator[pa.RecordBatch]:
        for ids, starts, pieces in _documents(shard):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at + starts), pa.array([len(p) // 4 for p in pieces], pa.int64()), pa.array(list(map(zlib.crc32, pieces)), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, folder, one, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, folder: str, value: int) -> DataFrame:
    """(places, start): per shard that holds it, the places of an id in the whole sequence, by ``select`` alone."""

    def one(shard: Shard, at: int) -> Iterator[pa.RecordBatch]:
        places = shard.matrix.select(value)
        if len(places):
            yield pa.RecordBatch.from_arrays([pa.array([(at + places).tolist()], pa.list_(pa.int64())), pa.array([at], pa.int64())], ["places", "start"])

    return _read(manifest, folder, one, "places array<long>, start long")


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "wavelet")
    return digests(materialize(write_shards(table(spark, sf_dir, "documents"), folder), "manifest"), folder)
