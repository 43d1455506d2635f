"""The pipeline's stages against a brute-force version, and the registry's entries."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from loomline.llm import registry, repetition

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(say(rng.randint(60, 200))) for _ in range(60)]
    texts += [texts[0], texts[0] + " ", texts[1].replace(" ", "  ")]
    for t in texts[10:20]:
        w = t.split()
        texts.append(" ".join([*w[:30], "swapped", *w[31:]]))
    texts += ["too short", None, "", "again and again and again we say it " * 9]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, rows


def _shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(docs).collect()}
    left = [r for r in rows if verdict[r[0]]]
    good = corpus_pipeline.quality(spark, docs, path)
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r[0] for r in left) and len(left) == len(rows) - 4

    best: dict = {}
    for r in left:
        key = "".join(r[1].split())
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    once = corpus_pipeline.exact(spark, good, path)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r[0] for r in best.values())

    kept: list = []
    for r in sorted(best.values()):
        mine = _shingles(r[1])
        if not any(len(mine & s) / len(mine | s) >= 0.8 for _, s in kept):
            kept.append((r[0], mine))
    near = corpus_pipeline.near(spark, once, path)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [k for k, _ in kept]

    words = {r["doc_id"]: len(r["text"].split()) for r in near.collect()}
    mixed = corpus_pipeline.mix(spark, near, path)
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(r["text"].split())
    assert mixed.columns == docs.columns and all(n <= 3 * words[k] for k, n in taken.items())
    assert abs(sum(taken.values()) - sum(words.values())) <= 128 * 4


def test_run(spark, folder):
    path, _ = folder
    ids = Counter()
    rows = corpus_pipeline.run(spark, path).collect()
    for r in rows:
        ids[r["sequence_id"]] += r["length"]
    assert sorted(ids) == list(range(len(ids))) and all(n == 1024 for k, n in ids.items() if k < len(ids) - 1)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
