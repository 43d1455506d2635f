"""Merging in order against comparing with every kept text; sections and their caps; the timeline."""

from __future__ import annotations

import random

import pytest

from loomline.operators import summaries


def _plain(texts, like=0.8, ratio=0.6):
    kept = []
    for n, t in enumerate(texts):
        mine = summaries.merge_words(t)
        for k in kept:
            other = summaries.merge_words(k[0])
            if mine and other and min(len(mine), len(other)) / max(len(mine), len(other)) >= ratio and 2 * len(mine & other) / (len(mine) + len(other)) >= like:
                k[0] = t if len(t.strip()) > len(k[0].strip()) else k[0]
                k[1] = [*k[1], n][:3]
                break
        else:
            kept.append([t, [n]])
    return kept


def _texts(rng, n):
    words = [f"{c}{'x' * (i % 5)}{i}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 2)]
    base = [rng.sample(words, rng.randint(1, 12)) for _ in range(25)]
    out = ["", "the of", "The OF!"]
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t) + rng.choice(["", " and the", "!", "  "]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_leaders_are_those_of_comparing_with_all(seed):
    texts = _texts(random.Random(seed), 400)
    got = summaries.Leaders()
    for n, t in enumerate(texts):
        got.add(t, n)
    assert [[t, e] for t, e in zip(got.texts, got.evidence)] == _plain(texts)


def test_a_huge_conversation_is_compared_with_few():
    rng, got = random.Random(9), summaries.Leaders()
    for n in range(6000):
        got.add(" ".join(f"w{rng.randrange(3000)}" for _ in range(9)), n)
    assert got.compared < 6000 * len(got.texts) / 200


def test_sections_and_timeline(spark):
    texts = _texts(random.Random(3), 90)
    found = [(c, n, ["Decisions", " actions", "Other", "ACTIONS "][n % 4], t) for c in (1, 2) for n, t in enumerate(texts)] + [(3, 0, "Actions", None)]
    rows = spark.createDataFrame(found, "conv_id long, seq long, section string, text string").repartition(3)
    got = [tuple(r) for r in summaries.sections(rows, ["Actions", "Decisions", "Empty"], 12).orderBy("conv_id", "section", "place").collect()]
    want = []
    for c in (1, 2):
        for title, kinds in (("Actions", (1, 3)), ("Decisions", (0,))):
            kept = _plain([t for n, t in enumerate(texts) if n % 4 in kinds and t.strip()])
            want += [(c, title, i, t, len(e), max(0, len(kept) - 12)) for i, (t, e) in enumerate(kept[:12])]
    assert got == want
    items = [(1, n, n % 3, "k", f"t{n}", None if n == 7 else (n * 37 % 50) * 1000) for n in range(60)] + [(2, 0, 0, "k", "x", 5)]
    line = summaries.timeline(spark.createDataFrame(items, "conv_id long, seq long, order int, kind string, title string, at_ms long"))
    order = sorted((i for i in items if i[0] == 1), key=lambda i: (i[5] or 0, i[2], i[1]))[:20]
    assert [(r["title"], r["place"]) for r in line.where("conv_id = 1").orderBy("place").collect()] == [(i[4], n) for n, i in enumerate(order)]
