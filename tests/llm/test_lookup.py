"""Lookups in the index of exact dedup."""

from __future__ import annotations

from loomline.llm import exact_dedup
from loomline.llm.common import materialize


def test_lookup_finds_kept_entries(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "ab  c\n"), (3, "other"), (4, None)], "doc_id long, text string")
    runs = materialize(exact_dedup.write_runs(docs, memtable_rows=1), "runs").withColumnRenamed("sha", "digest")
    index = materialize(exact_dedup.compact(runs), "index")
    found = {(r["keep_id"], r["group_size"]) for r in exact_dedup.lookup(index, ["abc", "", "absent"]).collect()}
    assert found == {(2, 2), (4, 1)}
