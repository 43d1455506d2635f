"""The stored index against a plain BM25: blocks skipped by bound, folders read, nulls, repeats and empty tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

from loomline.operators import postings
from loomline.operators.retrieval import query_terms


def _docs():
    rng = random.Random(8)
    words = [f"w{c}{d}x" for c in "abcdefgh" for d in range(9)]
    weights = [1 / (1 + i) for i in range(len(words))]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(400)]
    out += [(i, "wh8x " * 12 + "wa0x") for i in (33, 35)]  # one promising range
    return [*out, (900, None), (901, ""), (902, "a b"), (5, out[5][1]), (905, "It's the WA0X's o'clock")]


def _bm25(docs, terms, k1, b):
    counts = [(d, Counter(query_terms(t or ""))) for d, t in docs]
    avg = sum(sum(c.values()) for _, c in counts) / len(docs)
    score = Counter()  # by place: rows with one id are separate
    for t in terms:
        df = sum(t in c for _, c in counts)
        idf = max(0.0, math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)))
        for place, (_, c) in enumerate(counts):
            if t in c:
                score[place] += idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avg))
    return [(docs[place][0], round(s, 6)) for place, s in score.items()]


def test_stored_index(spark):
    docs = _docs()
    index = postings.write_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), reach=16)
    assert (index.n_docs, round(index.avg_len, 9)) == (len(docs), round(sum(len(query_terms(t or "")) for _, t in docs) / len(docs), 9))
    want = Counter((t, d, n) for d, text in docs for t, n in Counter(query_terms(text or "")).items() if t in ("wa0x", "wh8x"))
    assert Counter((r["term"], r["key"], r["tf"]) for r in index.postings(["wa0x", "wh8x", "none"]).collect()) == want
    for terms, k1 in ((["wa0x", "wh8x", "wb3x", "wa0x"], 1.5), (["wc1x"], 1.2), (["none"], 1.5)):
        score = _bm25(docs, terms, k1, 0.75)
        assert sorted((r["key"], round(r["score"], 6)) for r in index.scores(terms, k1).collect()) == sorted(score)
        got = [(r["key"], r["score"]) for r in index.top(terms, 5, k1, first=1).collect()]
        assert got == [(d, -s) for s, d in sorted((-s, d) for d, s in score)[:5]]
    read = []
    assert {r["key"] for r in index.top(["wh8x", "wa0x"], 2, first=1, read=read).collect()} == {33, 35}
    assert read[1] < read[0] / 2  # ranges that can't reach the second score aren't scored


def test_a_search_reads_the_folders_of_its_terms(spark):
    index = postings.write_index(spark.createDataFrame(_docs(), "doc_id long, text string"))
    folders = {r["f"] for r in index.of(["wa0x", "wb0x"]).selectExpr("regexp_extract(input_file_name(), 'bucket=([0-9]+)', 1) AS f").collect()}
    assert folders == {str(zlib.crc32(t) % postings.BUCKETS) for t in (b"wa0x", b"wb0x")}
    empty = postings.write_index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.top(["wa0x"], 3).collect() == [] == empty.scores(["wa0x"]).collect()


def test_the_index_of_a_table_is_written_once(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(_docs()[:50], "doc_id long, text string").write.parquet(path)
    first = postings.kept_index(spark, path)
    assert postings.kept_index(spark, path) is first
    spark.createDataFrame(_docs()[50:60], "doc_id long, text string").write.mode("append").parquet(path)
    second = postings.kept_index(spark, path)
    assert second is not first and (first.n_docs, second.n_docs) == (50, 60)
