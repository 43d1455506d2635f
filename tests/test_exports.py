"""Exported lines come back whole however large the export is, and a filtered top k looks past the nearest rows."""

from __future__ import annotations

import __spark_entry__
from loomline.sources import files


def test_export_above_the_limit_of_a_file(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    run = __spark_entry__.queries()["a6_document_source"]
    want = run(spark, folder).collect()
    size = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(files, "MOST_BYTES", size // 2)
    assert run(spark, folder).collect() == want


def test_filter_beyond_the_nearest_rows(spark, tmp_path):
    vectors = [(7, [1.0, 0.0])] + [(100 + n, [1.0, 0.001 * n]) for n in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "src2" if i < 150 else "src1", 60) for i, _ in vectors], "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["f5_post_filtered"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(150, 160))
    assert {r["shortfall"] for r in got} == {0}
