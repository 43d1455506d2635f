"""Streams against batches: conversations over several micro-batches, sliding windows, rows in time and too late."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomline.operators import transcripts
from loomline.streaming import live


def _plain(rows):
    return Counter(str(sorted(r.asDict().items())) for r in rows)


def test_a_conversation_over_three_batches_is_chunked_whole(spark, tmp_path):
    say = lambda c, n: f"Well {c} said number {n} of it and then some more words follow here " * (1 + n % 7)
    rows = [(c, n, ("user", "assistant")[n // 2 % 2], say(c, n)) for c in range(4) for n in range(18)]
    schema = "conv_id long, turn long, role string, text string"
    parts = [[r for r in rows if r[1] < 5 or r[0] == 3], [r for r in rows if r[0] < 3 and 5 <= r[1] < 11], [r for r in rows if r[0] < 2 and r[1] >= 11]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}/c.parquet")
    folder = f"file://{tmp_path}/out"
    for i in range(3):  # each start goes on where the last ended
        for f in (tmp_path / f"{i}/c.parquet").glob("part-*.parquet"):
            (tmp_path / "all.parquet").mkdir(exist_ok=True)
            f.rename(tmp_path / "all.parquet" / f.name)
        live.index_live(live.read_stream(spark, f"{tmp_path}/all.parquet", 1), folder)
    whole = spark.createDataFrame([r for part in parts for r in part], schema)
    want = transcripts.chunk_turns(transcripts.preprocess(transcripts.segments(whole)))
    got = live.live_chunks(spark, folder)
    assert _plain(got.select(*want.columns).collect()) == _plain(want.collect())
    assert {r["batch"] for r in spark.read.parquet(f"{folder}/chunks").select("batch").distinct().collect()} == {0, 1, 2}


def test_late_rows(spark, tmp_path):
    day = datetime(2026, 1, 10)
    parts = [[(1, day, "click", 1.0)], [(2, day + timedelta(days=4), "click", 2.0)], [(3, day + timedelta(days=3), "click", 4.0), (4, day + timedelta(hours=1), "click", 8.0)], [(5, day + timedelta(days=4, hours=7), "click", 16.0)]]
    folder = f"file://{tmp_path}/out"
    (tmp_path / "e.parquet").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for f in (tmp_path / str(i)).glob("part-*.parquet"):
            f.rename(tmp_path / "e.parquet" / f.name)
        live.windowed_counts(live.read_stream(spark, f"{tmp_path}/e.parquet", 1), folder, slide="12 hours")
    got = {(r["start"], r["n"], r["total"]) for r in live.newest_counts(spark, folder).select(F.col("start"), "n", "total").collect()}
    half = timedelta(hours=12)
    at = day + timedelta(days=4)
    # the row of day 3 is a day late and counts; that of day 0 is four days late, behind the watermark, and doesn't
    assert got == {(day - half, 1, 1.0), (day, 1, 1.0), (at - half, 2, 18.0), (at, 2, 18.0), (day + timedelta(days=3) - half, 1, 4.0), (day + timedelta(days=3), 1, 4.0)}
