"""keep_one finds every pair of texts whose shingle sets have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import random

from loomline.llm import simhash


def _shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _kept(texts: list[str]) -> list[int]:
    """Smallest place of each component of the pairs with a similarity of 0.8 or more, by brute force."""
    sets, low = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(a: int) -> int:
        while low[a] != a:
            a = low[a]
        return a

    for b in range(len(sets)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                low[max(ra, rb)] = min(ra, rb)
    return [k for k in range(len(texts)) if root(k) == k]


def _got(spark, texts: list[str]) -> list[int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())


def test_pairs_just_over_the_similarity(spark):
    rng, texts = random.Random(1), []
    for _ in range(60):
        w = [f"w{rng.randrange(50000)}" for _ in range(229)]  # 225 shingles; 5 swapped words change 25 of them: 200 / 250
        other = list(w)
        for at in range(20, 220, 40):
            other[at] = f"x{rng.randrange(50000)}"
        texts += [" ".join(w), " ".join(other)]
    assert _kept(texts) == list(range(0, 120, 2)) == _got(spark, texts)


def test_copy_with_a_repeated_passage(spark):
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w), " ".join(w + w[:150] * 4), "\t\n" + " ".join(w[:5]), " ".join(w[:5])]
    assert _kept(texts) == [0, 2] == _got(spark, texts)


def test_families_that_share_passages(spark):
    rng, texts = random.Random(5), []
    say = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    for _ in range(6):
        base = say(150)  # shared by the family, which is alike at 0.6 to 0.8 and more
        for _ in range(15):
            own = base + say(rng.randint(15, 45))
            texts.append(" ".join(own))
            if rng.random() < 0.5:
                copy = list(own)
                for at in rng.sample(range(len(copy)), rng.randint(1, 4)):
                    copy[at] = f"x{rng.randrange(50000)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    expected = _kept(texts)
    assert 10 < len(expected) < len(texts) - 10 and _got(spark, texts) == expected
