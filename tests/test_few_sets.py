"""A small right side that tasks hold whole joins as a large one does."""

from __future__ import annotations

import random

from loomline.operators.similarity import containment_join


def test_few_sets_join_as_many(spark):
    random.seed(3)
    some = lambda: random.sample([f"w{n}" for n in range(12)], random.randint(0, 8))
    left = spark.createDataFrame([(n, n % 3, some() + ([f"own{n}"] if n % 4 == 0 else [])) for n in range(700)], "doc_id long, line int, w array<string>")
    right = spark.createDataFrame([(n, some()) for n in range(40)], "item_id long, w array<string>")
    keys = ["doc_id", "line"], right, ["item_id"]
    few, many = containment_join(left, *keys), containment_join(left, *keys, few_sets=0)
    assert few.columns == many.columns
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "MapInArrow" in few._jdf.queryExecution().optimizedPlan().toString()
