"""Documents from files, and sinks: text by extension and byte order mark, JSON lines, Markdown.

Files are read as bytes by Spark's own reader, so any store that Spark reads will do; decoding is built-in expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions taken, and the limits.
EXTENSIONS = [".txt", ".md", ".markdown", ".json", ".csv", ".tsv", ".xml", ".html", ".htm", ".log", ".docx"]
MOST_BYTES, SNIFFED_BYTES = 50 * 1024 * 1024, 2048


def decode(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 by its mark in either order, else UTF-8 with any mark off, bad bytes replaced."""
    mark = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, MOST_BYTES)
    even = F.expr("int(length(content) / 2) * 2")  # half a character at the end goes
    wide = F.substring(content, F.lit(3), even - 2)
    plain = lambda c: F.make_valid_utf8(c.cast("string"))
    return F.when(mark.startswith("FFFE"), F.decode(wide, "UTF-16LE")).when(mark.startswith("FEFF"), F.decode(wide, "UTF-16BE")).when(mark == "EFBBBF", plain(rest(3))).otherwise(plain(content))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, bytes, sha256, text, refused) of the files below ``path``, as ``documents`` says; files without
    bytes are skipped by Spark's reader."""
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


def documents(files: DataFrame) -> DataFrame:
    """(path, extension, bytes, sha256, text, refused) of (path, length, content): refused says why a file has no text, else null.

    PDF files are refused, as nothing here decodes them, and so are files above 50 MB, files with a zero byte near their
    beginning that no mark of UTF-16 explains, and broken DOCX files. Of DOCX files the paragraphs of the body are read.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    slim = files.select("path", extension.alias("extension"), F.col("length").alias("bytes"), "content")
    boxed = F.col("extension") == ".docx"
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    binary = ~wide & ~boxed & F.hex(F.substring("content", 1, SNIFFED_BYTES)).rlike("^(?:..)*?00")
    refused = F.when(~F.col("extension").isin(EXTENSIONS), "extension").when(F.col("bytes") > MOST_BYTES, "too large").when(binary, "binary")
    slim = slim.withColumn("refused", refused).withColumn("sha256", F.sha2("content", 256))
    columns = ["path", "extension", "bytes", "sha256"]
    plain = slim.where(~boxed | F.col("refused").isNotNull()).select(*columns, F.when(F.col("refused").isNull(), decode(F.col("content"))).alias("text"), "refused")
    docx = slim.where(boxed & F.col("refused").isNull()).select(*columns, "content").mapInPandas(_unboxed, "path string, extension string, bytes long, sha256 string, text string, refused string")
    return plain.unionByName(docx)


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")  # what XML can't hold
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """The paragraphs of a DOCX file's body, one a line, with tabs and breaks; None if it isn't one.

    A file that would unpack to more than ``MOST_BYTES`` isn't read: what is stored says so before it is unpacked, and
    reading stops there whatever it says.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as box:
            if box.getinfo("word/document.xml").file_size > MOST_BYTES:
                return None
            with box.open("word/document.xml") as part:
                source = part.read(MOST_BYTES + 1)
        if len(source) > MOST_BYTES or b"<!DOCTYPE" in source[:4096] or b"<!ENTITY" in source[:4096]:
            return None
        body = ElementTree.fromstring(source)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError, RuntimeError, NotImplementedError, zlib.error):
        return None
    lines = []
    for paragraph in body.iter(f"{_W}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                parts.append("\t" if node.tag == f"{_W}tab" else "\n")
        lines.append("".join(parts))
    return "\n".join(lines)


def docx_bytes(text: str) -> bytes:
    """A DOCX file with a paragraph per line: what Word needs to open it, and no more."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_CONTROL.sub(chr(0xFFFD), line), {chr(13): "&#13;"})}</w:t></w:r></w:p>' for line in text.split("\n"))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, body in parts.items():
            box.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def _unboxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        pdf["text"] = [docx_text(bytes(c)) for c in pdf.pop("content")]
        pdf["refused"] = [None if t is not None else "broken" for t in pdf["text"]]
        yield pdf


def boxed(rows: DataFrame) -> DataFrame:
    """(id, content) of (id, text): each text as a DOCX file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "content": [docx_bytes(t) for t in pdf["text"]]})

    return rows.select("id", "text").mapInPandas(run, "id long, content binary")


def append_rows(rows: DataFrame, path: str) -> None:
    """Bulk insert: all rows or none become visible, by the writer's commit."""
    rows.write.mode("append").parquet(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def card_markdown(title: Column, facts: dict[str, Column], body: Column) -> Column:
    """One card as Markdown: heading, facts, body."""
    lines = [F.concat(F.lit(f"- **{name}**: "), value.cast("string")) for name, value in facts.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *lines, F.lit(""), body)


def export_lines(lines: DataFrame, size: int, path: str) -> None:
    """(value) as text files. ``size`` bytes are dealt over files of about an eighth of ``MOST_BYTES``, however
    large the tasks are, as ``documents`` refuses files above it."""
    lines.repartition(max(1, -(-8 * size // MOST_BYTES))).write.text(path)


def export_markdown(cards: DataFrame, path: str) -> None:
    """(pack, markdown) as text files, one folder per pack."""
    cards.select("pack", F.col("markdown").alias("value")).write.partitionBy("pack").mode("overwrite").text(path)
