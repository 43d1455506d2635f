"""One response for each payload, whatever repeats: ids, urls, whole rows, nulls; names that clash; records too long to mark."""

from __future__ import annotations

from collections import Counter

import pytest

from loomline.llm import warc
from loomline.llm.common import new_path


def test_repeated_rows_have_one_response(spark):
    a, b, c = "a" * 100, "b" * 150, "é" * 50
    rows = [(5, "u", a), (5, "u", a), (5, "t", a), (9, "s", a), (None, "n", b), (None, None, b), (None, "n", b), (1, "x", c), (2, "x", c), (2, "x", c), (3, "y", "é" * 49), (3, "y", "é" * 49)]
    pages = spark.createDataFrame([(*r, 1, "z", True, "q") for r in rows], "page_id long, url string, html string, first long, payload string, leads boolean, record_type string").repartition(4)
    path = new_path(spark, "warc")
    warc.archive(pages, path)
    got = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path).collect())
    assert got == Counter(
        [(5, "t", "response", None), (5, "u", "revisit", 5), (5, "u", "revisit", 5), (9, "s", "revisit", 5)]
        + [(None, "n", "response", None), (None, "n", "revisit", None), (None, None, "revisit", None)]
        + [(1, "x", "response", None), (2, "x", "revisit", 1), (2, "x", "revisit", 1), (3, "y", "response", None), (3, "y", "response", None)]
    )


def test_a_record_of_four_gigabytes_is_refused(monkeypatch):
    row = {"page_id": 1, "url": "u", "record_type": "response", "payload_digest": "d", "payload_bytes": 3, "refers_to": None, "payload": b"abc"}
    assert warc.member(row)[:2] == b"\x1f\x8b"

    class Packer:
        def compress(self, data):
            return Huge()

        def flush(self):
            return Huge()

    class Huge:
        def __add__(self, other):
            return self

        def __len__(self):
            return 1 << 32

    monkeypatch.setattr(warc.zlib, "compressobj", lambda *a: Packer())
    with pytest.raises(ValueError, match="4 GiB"):
        warc.member(row)
