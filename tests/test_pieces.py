"""Arrow batches are worked in pieces, on the way in and on the way out."""

from __future__ import annotations

import pyarrow as pa

from loomline.operators.extraction import flat_map
from loomline.operators.work import pieces


def test_pieces_are_bounded():
    texts = ["x" * n for n in (10, 900, 0, 5000, 20, 30)] + [None]
    parts = list(pieces(pa.record_batch({"n": list(range(7)), "text": pa.array(texts, pa.string())}), 1100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 1, 3] or all(sum(len(x or "") for x in p.column(1).to_pylist()) <= 1100 or p.num_rows == 1 for p in parts)
    assert len(parts) > 2


def test_rows_leave_in_small_batches(spark):
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
    found = flat_map(docs, lambda row: [(w,) for w in row["text"].split()], "doc_id", "term string")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    most = [r["n"] for r in found.mapInArrow(sizes, "n long").collect()]
    assert sum(most) == 400_000
    assert max(most) < 100_000
