"""Selections over a thousand candidates a query, against the plain rule over the whole list."""

from __future__ import annotations

import random

import pytest

from loomline.operators import selection

TERMS = {"a", "b", "c", "d", "e"}
SCHEMA = "query_id long, id long, score double, tokens long, file string, section long, text string, terms array<string>, priority long"


def _candidates(seed):
    rng = random.Random(seed)
    out = []
    for q, n in ((1, 1200), (2, 900), (3, 3)):
        for i in range(n):
            tokens = rng.choice([rng.randint(1, 60), rng.randint(400, 3000), rng.randint(5000, 9000)]) if seed % 2 else rng.randint(900, 2500)
            mark = rng.randint(0, 60)
            out.append((q, i, round(rng.random(), 2), 1000 + mark if seed == 3 else tokens, f"f{rng.randint(0, 30)}", rng.randint(0, 5), f"t{mark}" if seed == 3 else f"t{i}", sorted(rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))), rng.randint(1, 9)))
    return out


def _by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["place"], r["id"]))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def _per_query(data, choose):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in data]
    return {q: ids for q in (1, 2, 3) if (ids := [c["id"] for c in choose([r for r in rows if r["query_id"] == q])])}


def _budget(c, budget=4000, top_k=8):
    used, out = 0, []
    for x in sorted(c, key=lambda x: (-x["score"], x["id"])):
        if len(out) < top_k and used + x["tokens"] <= budget:
            out.append(x)
            used += x["tokens"]
        elif used + x["tokens"] > budget and 2 * len(out) >= top_k:
            break
    return out


def _evict(blocks, budget=9000, protected=4):
    kept = sorted(blocks, key=lambda b: (b["priority"], b["id"]))
    total = sum(b["tokens"] for b in kept)
    for b in sorted(kept, key=lambda b: (-b["priority"], -b["id"])):
        if total > budget and b["priority"] > protected:
            kept.remove(b)
            total -= b["tokens"]
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_selections_over_many_candidates(spark, seed):
    data = _candidates(seed)
    rows = spark.createDataFrame(data, SCHEMA).repartition(3).cache()
    assert _by_query(selection.fold_budget(rows, 4000, 8).collect()) == _per_query(data, _budget)
    floors = selection.choose_floors_and_caps(rows.drop("terms", "text", "priority"), 6000, 10)
    assert _by_query(floors.collect()) == _per_query(data, lambda c: selection.floors_and_caps(c, 6000, 10))
    assert _by_query(selection.choose_packed(rows, 5000, 12).collect()) == _per_query(data, lambda c: selection.pack_context(c, 5000, 12))
    assert _by_query(selection.choose_sufficient(rows, TERMS).collect()) == _per_query(data, lambda c: selection.smallest_sufficient(c, TERMS))
    budget = 9000 if seed == 1 else 2_000_000
    kept = _per_query(data, lambda c: _evict(c, budget))
    assert _by_query(selection.evict_blocks(rows, budget, reach=64).collect()) == kept
    if seed == 1:
        assert len(kept[1]) > 400  # protected blocks far beyond any top k
    rows.unpersist()
