"""Selection by rounds of counting against sorting each group."""

from __future__ import annotations

import math
import random

import pytest

from loomline.operators.quantiles import quantiles

WANTED = {"mid": ("linear", 0.5), "high": ("linear", 0.95), "least": ("linear", 0.0), "most": ("floor", 1.0), "rank": ("floor", 0.5), "disc": ("least", 0.95)}


def _values():
    rng = random.Random(1)
    out = [("even", float(i)) for i in range(501)] + [("same", 7.0)] * 200 + [("one", -3.5)] + [("two", 1.0), ("two", 2.0)]
    out += [("steep", 10.0 ** rng.uniform(-12, 12)) for _ in range(400)] + [(None, rng.gauss(0, 1)) for _ in range(150)]
    out += [("ties", rng.choice([0.0, 0.0, 0.0, 5.0, 5.5, 1e9])) for _ in range(300)] + [("even", None), ("none", None)]
    return out


@pytest.mark.parametrize("limit,buckets", [(50_000, 1024), (10, 16)])
def test_quantiles(spark, limit, buckets):
    rows, rounds = _values(), []
    got = quantiles(spark.createDataFrame(rows, "k string, x double").repartition(3), ["k"], "x", WANTED, limit, buckets, rounds)
    want = {}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        n = len(v)

        def linear(q, v=v, n=n):
            low = math.floor(q * (n - 1))
            share = q * (n - 1) - low
            return v[low] * (1 - share) + v[min(n - 1, low + 1)] * share

        want[k] = (linear(0.5), linear(0.95), v[0], v[-1], v[min(n - 1, n // 2)], v[max(0, math.ceil(n * 0.95) - 1)])
    assert {r["k"]: tuple(pytest.approx(x, rel=1e-12) for x in r[1:]) for r in got.collect()} == want
    assert bool(rounds) == (limit < 1000)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert quantiles(none, ["k"], "x", WANTED).collect() == []
    with pytest.raises(Exception, match="infinite"):
        quantiles(spark.createDataFrame([("a", float("inf"))], none.schema), ["k"], "x", WANTED).collect()
