"""The containment join against comparing all pairs."""

from __future__ import annotations

import random

from loomline.operators.similarity import containment_join


def test_containment_join(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (1 + i) for i in range(60)]
    some = lambda n: sorted(set(rng.choices(words, weights, k=n)))
    left = [(i, j, some(rng.randint(1, 14))) for i in range(60) for j in range(3)] + [(99, 0, []), (99, 1, ["w0"]), (99, 2, ["odd", "other"])]
    right = [(i, some(rng.randint(1, 20))) for i in range(40)] + [(90, []), (91, ["w0"]), (92, left[0][2]), (93, left[0][2])]
    got = containment_join(spark.createDataFrame(left, "doc_id long, line int, w array<string>"), ["doc_id", "line"], spark.createDataFrame(right, "item_id long, w array<string>"), ["item_id"])
    want = {(d, n, i, len(set(a) & set(b))) for d, n, a in left for i, b in right if a and b and len(set(a) & set(b)) / min(len(a), len(b)) >= 0.6}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
