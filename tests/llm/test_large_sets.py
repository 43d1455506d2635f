"""Large shingle sets: class counts rule pairs out before whole sets are moved, and no text is shuffled for its set."""

from __future__ import annotations

import random

import numpy as np

from loomline.llm import simhash


def _random_sets(rng, n: int, m: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.unique(rng.integers(0, 1 << 64, n + m, np.uint64))
    rng.shuffle(every)
    return every[:n], every[n - both : n - both + m]


def test_counts_never_say_more_than_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in [(512, 512, 512), (600, 1100, 400), (1023, 1024, 900), (3000, 3300, 2800), (5000, 4200, 0), (40_000, 33_000, 32_000)]:
        x, y = _random_sets(rng, n, m, both)
        bound = simhash._least_apart(simhash._class_counts(x), simhash._class_counts(y))
        assert bound == simhash._least_apart(simhash._class_counts(y), simhash._class_counts(x)) <= n + m - 2 * both
        assert both or bound > (n + m) / 9  # 0.8 leaves a ninth of both sizes
    assert simhash._class_counts(x[:511]) is None


def test_counts_over_a_byte():
    many = np.arange(70_000, dtype=np.uint64) << np.uint64(40)  # all in one class
    bound = simhash._least_apart(simhash._class_counts(many), simhash._class_counts(many[:69_900]))
    assert bound <= 100


def _texts(rng, n: int) -> list[str]:
    """Pairs of texts that share a passage of 100 words, of 1,500 each, among others that fill the buckets of shingles."""
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(n):
        passage = say(100)
        out += [" ".join(say(900) + passage + say(500)), " ".join(say(200) + passage + say(1200))]
    return out + [" ".join(say(1500)) for _ in range(150)]


def test_sets_of_unlike_large_texts_are_not_moved(spark, monkeypatch):
    moved, decide = [], simhash._jaccard_at_least

    def counted(pairs, least):
        moved.append(pairs.count())
        return decide(pairs, least)

    monkeypatch.setattr(simhash, "_jaccard_at_least", counted)
    texts = _texts(random.Random(2), 15)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 180 and moved == [0, 0]


def test_large_texts_around_the_similarity(spark):
    rng, texts, stay = random.Random(9), [], []
    for swapped in (1, 20, 31, 36, 60):  # each changes 5 of 1,496 shingles; 33 leave 0.801, 34 leave 0.795
        w = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        other = list(w)
        for at in range(10, 10 + 20 * swapped, 20):
            other[at] = f"x{rng.randrange(10**6)}"
        stay += [len(texts)] + [len(texts) + 1] * (swapped > 33)
        texts += [" ".join(w), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == stay


def test_wanted_sets_come_without_a_shuffle(spark):
    texts = spark.createDataFrame([(i, f"a b c {i} e f") for i in range(400)] + [(400, None)], "id long, text string")
    wanted = spark.createDataFrame([(3,), (77,), (77,), (400,)], "id long")
    sets = simhash._shingle_sets(texts, 5, wanted)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: bytes(r["hashes"]) for r in sets.collect()}
    assert {3, 77, 400} <= set(got) and len(got) < 10 and got[3] == simhash.shingle_hashes("a b c 3 e f", 5).tobytes()
    assert {r["id"] for r in simhash._shingle_sets(texts, 5, wanted, bits=5).collect()} >= {3, 77, 400}
    assert simhash._shingle_sets(texts, 5, wanted.limit(0)).count() == 0
