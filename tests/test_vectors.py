"""The vector index against comparing everything: scopes, floors, ties, repeats, vectors without direction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomline.operators import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.15, 16)).astype(np.float32).tolist(), i % 5) for i in range(600)]
    odd = [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None] * 16, 1)]
    return [*rows, *odd, (600, rows[24][1], 4), (600, rows[24][1], 4), (601, [2 * x for x in rows[24][1]], 4)]


def _best(rows, query, k, keep=lambda r: True, floor=-2.0):
    q = np.array(query, np.float64)
    out = []
    for r in rows:
        if keep(r) and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]):
            x = np.array(r[1], np.float64)
            s = round(float(x @ q / (np.linalg.norm(x) * np.linalg.norm(q))), 6)
            if s >= floor:
                out.append((-s, r[0]))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_vector_index(spark):
    rows = _rows()
    index = vectors.write_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for at in (0, 7, 24):
        read = []
        got = index.top(rows[at][1], 10, leave=F.col("vec_id") == at, read=read)
        assert [tuple(r) for r in got.collect()] == _best(rows, rows[at][1], 10, lambda r, at=at: r[0] != at)
        assert read[1] < read[0] / 2
        scoped = index.top(rows[at][1], 200, scope=F.col("label") == 3, floor=0.1)
        assert [tuple(r) for r in scoped.collect()] == _best(rows, rows[at][1], 200, lambda r: r[2] == 3, 0.1)
    assert len(index.top(rows[0][1], 5000).collect()) == 603
    assert index.top([0.0] * 16, 3).collect() == []


def test_a_search_reads_the_folders_of_its_lists(spark):
    index = vectors.write_vectors(spark.createDataFrame(_rows(), SCHEMA))
    got = index.top(_rows()[0][1], 5)
    assert len(got.inputFiles()) >= 1 and "PartitionFilters: [list" in got._jdf.queryExecution().toString()
    none = vectors.write_vectors(spark.createDataFrame(_rows()[600:602], SCHEMA))
    assert none.top([1.0] * 16, 3).collect() == []
