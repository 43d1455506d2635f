"""Sources, extraction helpers, gates and new folds on worked examples, and selections against plain folds."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import rules
from loomline.operators import extraction, selection, tables, transcripts
from loomline.operators.ranking import rank_in_groups, top_per_group
from loomline.plans.evidence import search_limit
from loomline.sources import files
from loomline.streaming import folds


def test_files_are_decoded_or_refused(spark, tmp_path):
    made = {"a.txt": "héllo".encode(), "b.md": b"\xff\xfe" + "x é".encode("utf-16-le"), "c.csv": b"\xfe\xff" + "ü,1".encode("utf-16-be"), "d.html": b"\xef\xbb\xbf<p>", "e.log": b"ab\x00cd", "f.txt": b"", "g.exe": b"MZ", "h.txt": b"bad \xff byte", "i.pdf": b"%PDF"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert {n: r["text"] for n, r in got.items() if r["text"] is not None} == {"a.txt": "héllo", "b.md": "x é", "c.csv": "ü,1", "d.html": "<p>", "h.txt": "bad � byte"}
    assert {n: r["refused"] for n, r in got.items() if r["refused"]} == {"e.log": "binary", "g.exe": "extension", "i.pdf": "extension"}
    assert "f.txt" not in got  # Spark's reader skips files without bytes
    assert all(r["sha256"] == hashlib.sha256(made[n]).hexdigest() for n, r in got.items())


def test_quantities_and_tokens():
    assert extraction.quantities("about two hundred and fifty of 1,250,000") == ["1250000", "250", "1250000"]
    assert {"10000"} <= set(extraction.quantities("10,000")) & set(extraction.quantities("ten thousand")) & set(extraction.quantities("10k"))
    assert "1500000" in extraction.quantities("1.5 million") and "1500000" in extraction.quantities("1.5m")
    assert extraction.lexical_tokens("Green's TECH-SMALL can't") == ["green", "tech-small", "cant", "tech", "small"]


def test_front_matter_and_relations():
    text = "[Page 1]\nTitle On Robots\nDate 21 June 2025 Number of pages 67 Language English\nSupervisors Dr. A, Prof. B and C\nprose about Language models\n[Page 9]\nAuthor Nobody"
    assert extraction.front_matter(text) == [("title", "On Robots", [], 1), ("date", "21 June 2025", [], 1), ("page_count", "67", [], 1), ("language", "English", [], 1), ("supervisor", "Dr. A, Prof. B and C", ["Dr. A", "Prof. B", "C"], 1)]
    names = ["Redis", "Kafka", "Spark"]
    assert extraction.relations("Redis", "Redis uses Kafka. Redis extends Spark.", names) == [("uses", "Kafka", "low"), ("extends", "Spark", "high")]
    assert extraction.relations("Redis", "Redis, not related to Spark, uses a laptop.", names) == []
    assert extraction.relations("Redis", "Redis is unlike Spark.", names) == [("contrasts_with", "Spark", "medium")]
    assert extraction.relations("Redis", "Redis is based on Kafka (Spark).", names) == []


def test_document_chunks_point_into_the_text():
    rng = random.Random(1)
    body = " ".join(" ".join(f"w{rng.randrange(99)}" for _ in range(12)) + "." for _ in range(60))
    text = f"1 Start ........ 1\n[Page 1] {body}"
    made = extraction.document_chunks(text)
    assert made[0][0] == "toc" and len(made) > 4 and all(text[s:e] == t for _, s, e, t in made if s is not None)
    assert [c[0] for c in extraction.document_chunks("a,b\n1,2\n3,4")] == ["table"]


def test_interim_novelty():
    final = "so tell me about the last project"
    assert folds.interim_novelty(f"{final}, and then what", [final], 0) == ("inject", "and then what")
    assert folds.interim_novelty(final + "!", ["x", final], 0) == ("no_novel_content", "")
    assert folds.interim_novelty(final, [final], 0) == ("duplicate", "") and folds.interim_novelty("hi", [], 40_000) == ("stale", "") and folds.interim_novelty("  ", [], 0) == ("empty", "")
    action, text = folds.interim_novelty("word " * 400, [], 0)
    assert action == "inject" and len(text) <= 1200 and text.startswith("word")


def test_pending_question_ignores_echoes_and_old_ones():
    fold, out = folds.pending_question(), []
    state = dict(fold.start)
    for at, own, text in [(0, 1, "I like the blue one"), (1000, 0, "the blue one"), (2000, 0, "why is that so"), (2500, 0, "and when"), (9000, 0, "next"), (200_000, 0, "late")]:
        state, rows = fold.step(state, {"at_ms": at, "own": own, "text": text})
        out += [(r["pending"], r["echo"], r["fired"]) for r in rows]
    assert out == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (2, 0, 0), (1, 0, 1), (1, 0, 0)]


@pytest.mark.parametrize("limit", [0, 201, True, 2.5])
def test_search_limits(limit):
    assert search_limit(None) == 20 and search_limit(200) == 200
    with pytest.raises(ValueError):
        search_limit(limit)


def test_question_similarity_caps(spark):
    pairs = [("tell me about your best decision", "tell me about your worst decision"), ("how do you scale", "how do you scale redis clusters"), ("", ""), ("can you tell me", "can you tell me about kafka")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(rules.question_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert rows[0]["s"] <= 0.6 and rows[1]["s"] == pytest.approx(0.9) and rows[2]["s"] == 1.0 and rows[3]["s"] > 0.6


def test_ranks_and_evictions(spark):
    rng = random.Random(4)
    data = [(i, "hot" if i % 3 else f"g{i % 7}", rng.randrange(50)) for i in range(900)]
    rows = spark.createDataFrame(data, "id long, g string, v long")
    want: dict[str, list] = {}
    for i, g, v in sorted(data, key=lambda x: (-x[2], x[0])):
        want.setdefault(g, []).append(i)
    got = {(r["g"], r["rank"]): r["id"] for r in rank_in_groups(rows, ["g"], -F.floor(F.col("v") / 5), F.desc("v"), F.col("id")).collect()}
    assert got == {(g, n + 1): i for g, ids in want.items() for n, i in enumerate(ids)}
    assert {r["id"] for r in top_per_group(rows, ["g"], 5, F.desc("v"), F.col("id")).collect()} == {i for ids in want.values() for i in ids[:5]}
    kept = {r["id"] for r in tables.evict(rows, 200, F.col("g") == "hot", F.floor(F.col("v") / 10), F.col("v"), F.col("id")).collect()}
    assert kept == {i for i, *_ in sorted(data, key=lambda x: (x[1] != "hot", x[2], x[0]))[-200:]}


def test_selections_follow_their_rules(spark):
    rng = random.Random(6)
    data = [(q, i, round(rng.random(), 3), rng.randrange(50, 900)) for q in range(3) for i in range(40)]
    rows = spark.createDataFrame(data, "query_id long, id long, score double, tokens long")
    got: dict[int, list] = {}
    for r in selection.fold_budget(rows, 2000, 8).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(3):
        used, want = 0, []
        for _, i, _, t in sorted((x for x in data if x[0] == q), key=lambda x: (-x[2], x[1])):
            if len(want) < 8 and used + t <= 2000:
                want.append(i)
                used += t
            elif used + t > 2000 and 2 * len(want) >= 8:
                break
        assert got[q] == want


def test_long_transcripts_are_cut_with_a_carry():
    rows = [("x" * 4 * n, at) for at, n in enumerate([10, 20, 30, 40, 25, 35])]
    assert list(transcripts.fold_long(rows[:2], 100, 30, 60, 6)) == [rows[:2]]
    assert list(transcripts.fold_long(rows, 70, 30, 50, 6)) == [rows[0:3], rows[2:4], [rows[4], rows[5]]]


def test_action_lines_and_weak_sentences(spark):
    from loomline.operators import tables

    lines = ["We need to call Bob by Friday.", "I must finish", "todo:  plan   the trip", "Nothing here", "", "please review it on Monday"]
    got = [r["a"] and tuple(r["a"]) for r in spark.createDataFrame([(x,) for x in lines], "t string").select(rules.action_item(F.col("t")).alias("a")).collect()]
    assert got == [("call Bob", "We", "Friday"), ("finish", "Me", None), ("plan the trip", None, None), None, None, ("it", None, "Monday")]
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    cards = [("one two three four. five six seven eight", "one two three four and five"), ("short. one two", "x")]
    low = spark.createDataFrame(cards, "b string, s string").select(rules.weakest_sentence(F.col("b"), F.col("s"), words).alias("w")).collect()
    assert [r["w"] for r in low] == [0.25, None]
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "k long, v string").repartition(3)
    assert tables.same_sequence(rows, rows.repartition(5), "v", F.col("k"), F.col("k")).first()["equal"]
    assert not tables.same_sequence(rows, rows, "v", F.col("k"), F.desc("k")).first()["equal"]
