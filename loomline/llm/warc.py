"""WARC archives as a PySpark Python data source (``format("warc")``).

Writing: each task streams its rows into ``.warc.gz`` files of bounded size under names of its own; the driver commits
the names of the successful tasks in a manifest, so a retried task leaves no records behind. Each record is a gzip
member whose extra field ``sl`` holds the compressed and the full length, as Annex D of the WARC standard suggests.

Reading: files are planned as partitions, large ones cut at record borders that the manifest lists. Predicates on
``record_type`` and other header columns are pushed down. The reader unpacks a member only up to the end of its
headers, tests the predicates, and goes on to the next member by the ``sl`` length; a payload is unpacked only if the
record qualifies and the payload column is wanted (option ``payload``).

Columns: page_id long, url string, record_type string, payload_digest string (bare hex SHA-256), payload_bytes long,
refers_to long, payload binary. Revisit records carry no payload; digest and length are those of the full payload.

Null html is an empty payload, null ids and urls stay null. Repeated rows are records of their own, and one of equal
payloads is the response. An empty table gives an empty archive. A record of 4 GiB or more is refused with an error;
a smaller one is held by a task alone. Other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomline.llm.common import materialize, new_path, table

FILE_BYTES, SPLIT_BYTES, LEAST = 128 << 20, 8 << 20, 100
_DDL = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_HEADS = {"page_id": "WARC-Page-ID", "url": "WARC-Target-URI", "record_type": "WARC-Type", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To-Page-ID"}
_NUMBERS = ("page_id", "payload_bytes", "refers_to")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(row: dict) -> bytes:
    """One record as a gzip member; its extra field tells both lengths."""
    body = row["payload"] or b""
    heads = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    heads += [(name, str(row[c])) for c, name in _HEADS.items() if c != "record_type" and row[c] is not None]
    if row["record_type"] == "revisit":
        heads.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    heads += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split()) if k != 'WARC-Target-URI' else _escape(v)}\r\n" for k, v in heads) + "\r\n"
    record = text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    deflated = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(deflated) + 8
    if max(size, len(record)) > 0xFFFFFFFF:
        raise ValueError("a record of 4 GiB or more has no place in the extra field's 32 bits")
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record))
    return head + deflated + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _escape(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescape(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def parse_heads(text: bytes) -> dict:
    found = dict(line.split(": ", 1) for line in text.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    row = {c: found.get(name) for c, name in _HEADS.items()}
    row.update((c, int(row[c])) for c in _NUMBERS if row[c] is not None)
    if row["url"] is not None:
        row["url"] = _unescape(row["url"])
    return row


def records(source, start: int, end: int, wanted, payload: bool) -> Iterator[dict]:
    """Records that begin in [start, end) and whose headers are ``wanted``; other payloads are not unpacked."""
    source.seek(start)
    at = start
    while at < end:
        head = source.read(24)
        if len(head) < 24:
            return
        size = struct.unpack_from("<I", head, 16)[0]
        data = source.read(size - 24)
        unpack, text, pos = zlib.decompressobj(-15), b"", 0
        while b"\r\n\r\n" not in text and pos < len(data):
            text += unpack.decompress(data[pos : pos + 1024])
            pos += 1024
        heads, _, body = text.partition(b"\r\n\r\n")
        row = parse_heads(heads)
        if wanted(row):
            row["payload"] = None
            if payload and row["record_type"] != "revisit":
                row["payload"] = (body + unpack.decompress(data[pos:]) + unpack.flush())[:-4]
            yield row
        at += size


@dataclass
class Written(WriterCommitMessage):
    files: list  # (name, bytes, record borders every SPLIT_BYTES)


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int) -> None:
        self.path, self.overwrite, self.file_bytes = path, overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, at, name, borders = [], None, 0, "", []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, at, borders = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(row)
                if at - borders[-1] >= SPLIT_BYTES:
                    borders.append(at)
                out.write(data)
                at += len(data)
                if at >= self.file_bytes:
                    out.close()
                    files.append((name, at, borders))
                    out = None
        if out is not None:
            out.close()
            files.append((name, at, borders))
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and store.get_file_info(f"{root}/_manifest.json").is_file:
            with store.open_input_stream(f"{root}/_manifest.json") as source:
                files = json.loads(source.read()) + files
        with store.open_output_stream(f"{root}/_manifest.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in _HEADS:
                self.tests.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and f.attribute[0] in _HEADS:
                self.tests.append((f.attribute[0], tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/_manifest.json") as source:
            files = json.loads(source.read())
        return [Split(name, a, b) for name, size, borders in files for a, b in zip(borders, borders[1:] + [size])] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        wanted = lambda row: all(row[c] in values for c, values in self.tests)
        held, size = [], 0
        with store.open_input_file(f"{root}/{partition.name}") as source:
            for row in records(source, partition.start, partition.end, wanted, self.payload):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class WarcDataSource(DataSource):
    """Options: ``path`` (a URI that executors reach), ``payload`` (read payloads, default true), ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let Python data sources take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write one record per page: of equal payloads of ``least`` bytes or more, the smallest page is the response.

    Null html is an empty payload; null ids come last in the choice. Of rows equal in id and payload one is the response
    (the first by url, null last), and the others revisit it.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")).where(F.col("payload_bytes") >= least)
    ids = slim.groupBy("payload_digest", "page_id").agg(F.count("*").alias("c"))
    groups = ids.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "c")).alias("b"), F.sum("c").alias("c")).where("c > 1")
    groups = materialize(groups.select("payload_digest", F.col("b.page_id").alias("first"), (F.col("b.c") > 1).alias("tied")), "copies")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"), body.alias("payload"))
    rows = rows.join(groups, "payload_digest", "left").withColumn("copy", F.col("tied").isNotNull() & (F.col("payload_bytes") >= least))
    rows = rows.withColumn("leads", F.col("copy") & F.col("page_id").eqNullSafe(F.col("first"))).withColumn("revisit", F.col("copy") & ~F.col("leads"))
    if groups.where("tied").take(1):  # only rows that share the smallest id with an equal row are numbered
        place = F.row_number().over(Window.partitionBy("payload_digest").orderBy(F.col("url").asc_nulls_last()))
        tied = rows.where("leads AND tied").withColumn("revisit", place > 1)
        rows = rows.where("NOT (leads AND coalesce(tied, false))").unionByName(tied)
    revisit = F.col("revisit")
    out = rows.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes", F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    out.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _measured(rows: DataFrame) -> DataFrame:
    """Digest and length of responses, from their payloads as read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data])], ["page_id", "payload_bytes", "payload_digest"])

    return rows.select("page_id", "payload").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    full = read_archive(spark, path).where("record_type = 'response'")
    first = _measured(full).select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    return first.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, url FROM pages),
f AS (SELECT *, sha256(html) AS payload_digest, first_value(page_id) OVER w AS first, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id, url))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND place > 1 THEN first END AS refers_to FROM f
"""
