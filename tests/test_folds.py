"""Ordered folds, chunkers and selections on worked examples; streams equal batches."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from loomline.operators import chunks, graph, selection, tables
from loomline.streaming import folds, live
from loomline.streaming.stateful import fold_batch


def _run(fold: folds.Fold, rows: list[dict]) -> list[dict]:
    state, out = dict(fold.start), []
    for row in rows:
        state, found = fold.step(state, row)
        out += found
    return out


def test_voice_activity_has_two_thresholds_and_a_hangover():
    levels = [(0, 50), (20, 190), (40, 120), (60, 90), (80, 150), (700, 90), (720, 200)]
    assert [o["state"] for o in _run(folds.voice_activity(), [{"at_ms": t, "level": v} for t, v in levels])] == ["idle", "speech", "speech", "hangover", "hangover", "idle", "speech"]


def test_silence_is_sent_on_and_then_suppressed():
    rows = [(0, 100), (20, 1), (100, 1), (240, 1), (260, 1), (400, 1)]
    assert [(o["action"], o["edge"]) for o in _run(folds.suppress_silence(), [{"at_ms": t, "level": v} for t, v in rows])] == [("send", "started"), ("send", ""), ("send", ""), ("silence", "ended"), ("suppress", ""), ("silence", "")]


def test_joint_state_absorbs_repeated_edges():
    rows = [("a", True, 0), ("a", True, 5), ("b", True, 30), ("a", False, 50), ("b", False, 60)]
    out = _run(folds.joint_state(), [{"channel": c, "speaking": s, "at_ms": t} for c, s, t in rows])
    assert [(o["joint"], o["since_other"]) for o in out] == [("a", -1), ("both", 30), ("b", 20), ("neither", 10)]


def test_near_repeats_are_measured_from_the_row_kept():
    rows = [("x", 0), ("x", 400), ("x", 499), ("x", 500), ("y", 510), ("x", 520)]
    assert len(_run(folds.drop_near_repeats(), [{"what": w, "at_ms": t} for w, t in rows])) == 4


def test_transcripts_merge_by_their_longest_overlap():
    assert folds.merge_chunks("we met on", "We met on Monday") == "We met on Monday"
    assert folds.merge_chunks("we met on Monday", "on monday") == "we met on Monday"
    assert folds.merge_chunks("we met on Monday", "Monday at noon") == "we met on Monday at noon"
    assert folds.merge_chunks("one", "two") == "one two" and folds.merge_chunks("", "two") == "two" and folds.merge_chunks("one", " ") == "one"


def test_rolling_text_drops_the_oldest_segments():
    out = _run(folds.rolling_text(20), [{"text": t, "final": f} for t, f in [("first part", True), ("second", False), ("second part", True)]])
    assert [(o["chars"], o["segments"]) for o in out] == [(10, 1), (16, 1), (11, 1)]


def test_log_compaction_keeps_markers():
    assert _run(folds.compact_log(3, 2), [{}] * 6)[-1] == {"held": 2, "markers": 2}


def test_chunkers():
    assert chunks.by_characters("ab" * 5, 6, 2) == ["ababab", "ababab"] and chunks.by_characters("") == []
    assert chunks.by_sentences("One. Two! Three?", 10, 0) == ["One. Two!", "Three?"]
    assert chunks.by_words(" ".join(map(str, range(10))), 4, 1, 2)[0] == "0 1 2 3"
    assert chunks.table_rows("a,b\n1,2\n3,4") == ["a: 1; b: 2", "a: 3; b: 4"] and chunks.table_rows("Just one line, of prose here") == []
    assert chunks.page_sections("[Page 2]\n1.1 The heading here\nbody text") == ["[Page 2] [Section 1.1 The heading here] body text"]


def _candidate(i, score, tokens, **more):
    return {"id": i, "score": score, "tokens": tokens, "file": "f", "section": "s", "text": str(i), **more}


def test_selection_under_a_budget(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 50), (1, 2, 0.8, 60), (1, 3, 0.7, 40), (2, 9, 0.1, 5)], "query_id long, id long, score double, tokens long")
    assert {(r["query_id"], r["id"]) for r in selection.fold_budget(rows, 100, 4).collect()} == {(1, 1), (1, 3), (2, 9)}
    some = [_candidate(1, 0.9, 10), _candidate(2, 0.8, 10, text="1"), _candidate(3, 0.7, 95), _candidate(4, 0.6, 10)]
    assert [c["id"] for c in selection.pack_context(some, 100, 5)] == [1, 4]
    blocks = spark.createDataFrame([(1, i, p, 10) for i, p in enumerate([1, 9, 4, 6])], "query_id long, id long, priority long, tokens long")
    assert [[r["id"] for r in selection.evict_blocks(blocks, n).orderBy("place").collect()] for n in (20, 5)] == [[0, 2], [0, 2]]
    cover = [_candidate(1, 0.9, 1, terms=["x"]), _candidate(2, 0.5, 1, terms=["x", "y", "z"]), _candidate(3, 0.4, 1, terms=["q"])]
    assert [c["id"] for c in selection.smallest_sufficient(cover, {"x", "y", "z"}, 5, 2)] == [2, 1]
    floors = [_candidate(i, 1 - i / 10, 10, file="a" if i < 4 else "b") for i in range(6)]
    assert [c["id"] for c in selection.floors_and_caps(floors, 40, 4)] == [0, 4, 1, 5]


def test_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.upsert(old, new, ["k"], F.col("v") == "b")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(tables.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(tables.replace_partition(old, new, "k")) == [(1, "a"), (2, "B"), (3, "C")]


def test_expansion_takes_the_smallest_relation(spark):
    relations = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "c", "b"), (4, "c", "d")], "rel long, src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, graph.expand(relations, start).collect())) == [("b", 1, 1), ("c", 2, 3)]


def test_batch_fold_equals_the_plain_fold(spark):
    fold = folds.drop_near_repeats()
    rows = [(k, 200 * i, "ab"[i // 3 % 2]) for k in range(5) for i in range(40)]
    got = Counter((r["k"], r["at_ms"]) for r in fold_batch(spark.createDataFrame(rows, "k long, at_ms long, what string").repartition(4), "k", "at_ms", fold, "kept string").collect())
    kept: dict = {}
    want: Counter = Counter()
    for k, at, what in rows:
        if k not in kept or kept[k][0] != what or at - kept[k][1] >= 500:
            kept[k] = (what, at)
            want[k, at] += 1
    assert got == want


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    live.windowed_counts(live.read_stream(spark, f"{tmp_path}/events.parquet", 2), f"{tmp_path}/out", late="30 days")
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
    got = live.newest_counts(spark, f"{tmp_path}/out").select(*want.columns)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
