"""Conversations as segments: sessionising, cleaning, chunking, lookback windows.

A segment is (conv_id, seq, speaker, text, timestamp_ms). Everything but the chunkers is windows over a conversation;
the chunkers are ordered folds over rows that Spark sorts and streams, so a task holds one chunk, not a conversation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as tx

GAP_MS, LONG_GAP_MS = 5000, 7 * 60 * 1000


def segments(conversations: DataFrame) -> DataFrame:
    """The non-empty lines of all turns as segments, with the fixtures' clock (4 s apart, every fifth 2 s late)."""
    lines = conversations.select("conv_id", "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where("text <> ''")
    rows = lines.withColumn("seq", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "line")) - 1).cast("long"))
    clock = F.col("seq") * 4000 + F.when(F.col("seq") % 5 == 4, 2000).otherwise(0)
    return rows.select("conv_id", "seq", "speaker", "text", clock.alias("timestamp_ms"))


def merge_turns(rows: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Neighbouring segments of one speaker less than ``gap_ms`` apart become one (gaps and islands)."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    new = ~F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) | (F.col("timestamp_ms") - F.lag("timestamp_ms").over(order) >= gap_ms)
    marked = rows.withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    out = marked.groupBy("conv_id", "island", "speaker").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.min("seq").alias("seq"))
    return out.drop("island")


def preprocess(rows: DataFrame) -> DataFrame:
    """Merged, cleaned segments of three words or more with speaker names and question, decision and action flags."""
    clean = merge_turns(rows).withColumn("text", tx.clean_spoken(F.col("text")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    clean = clean.where(words >= 3)
    return clean.select("conv_id", "seq", tx.speaker_name(F.col("speaker")).alias("speaker"), "text", "start_ms", "end_ms", tx.is_question(F.col("text")).alias("is_question"), tx.is_decision(F.col("text")).alias("is_decision"), tx.is_action(F.col("text")).alias("is_action"))


def drop_repeats(rows: DataFrame) -> DataFrame:
    """Segments less those equal to the one kept before them (speaker and text, any case)."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    same = F.lag(F.lower("speaker")).over(order).eqNullSafe(F.lower("speaker")) & F.lag(F.lower("text")).over(order).eqNullSafe(F.lower("text"))
    return rows.withColumn("_same", same & (F.lag("seq").over(order).isNotNull())).where(~F.col("_same")).drop("_same")


def normalise(rows: DataFrame) -> DataFrame:
    """Evidence segments: assistant turns, noise and repeats out; stable speaker ids."""
    human = rows.where(tx.speaker_id(F.col("speaker")) != "assistant").withColumn("text", tx.clean_line(F.col("text")))
    kept = drop_repeats(human.where(~tx.is_interim_noise(F.col("text"))))
    return kept.withColumn("speaker_id", tx.speaker_id(F.col("speaker"))).withColumn("uncertain", F.col("speaker_id").isin("unknown", "speaker_1") & F.lower("speaker").isin("", "unknown", "speaker", "system", "audio"))


def quality(rows: DataFrame) -> DataFrame:
    """Per conversation: segments, speakers, dropped, long gaps, and speaker quality good, mixed or poor."""
    kept = normalise(rows)
    order = Window.partitionBy("conv_id").orderBy("seq")
    before = F.last(F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("long_gap", F.coalesce((F.col("timestamp_ms") > 0) & (F.col("timestamp_ms") - before > LONG_GAP_MS), F.lit(False)))
    found = kept.groupBy("conv_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker_id").alias("speakers"), F.count_if("uncertain").alias("unsure"), F.count_if("long_gap").alias("long_gaps"))
    total = rows.where(tx.speaker_id(F.col("speaker")) != "assistant").groupBy("conv_id").agg(F.count("*").alias("total"))
    out = total.join(found, "conv_id", "left").fillna(0, ["segments", "speakers", "unsure", "long_gaps"])
    share = F.when(F.col("segments") == 0, 1.0).otherwise(F.col("unsure") / F.greatest("segments", F.lit(1)))
    grade = F.when(share > 0.5, "poor").when((share > 0.15) | (F.col("speakers") <= 1), "mixed").otherwise("good")
    return out.select("conv_id", "segments", "speakers", (F.col("total") - F.col("segments")).alias("dropped"), "long_gaps", grade.alias("quality"))


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def fold_turns(rows: Iterable[tuple], most: int = 400, least: int = 100, overlap: int = 50) -> Iterator[list[tuple]]:
    """Groups of (speaker, text, start, end): speaker turns up to ``most`` tokens, at most two segments carried over."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        cost = _tokens(row[1])
        if held and (row[0] != held[0][0] or (size + cost > most and size >= least)):
            yield held
            carry: list[tuple] = []
            if row[0] == held[-1][0]:
                spent = 0
                for old in reversed(held):
                    spent += _tokens(old[1])
                    if carry and spent > overlap:
                        break
                    carry.insert(0, old)
                    if len(carry) == 2:
                        break
            held, size = carry, sum(_tokens(c[1]) for c in carry)
        held = [*held, row]
        size += cost
        if size > most and len(held) == 1:
            yield held
            held, size = [], 0
    if held:
        yield held


def fold_sorted(rows: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` turns a conversation's rows, in order, into output tuples; rows stream by, sorted by Spark."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (row for pdf in frames for row in pdf.itertuples(index=False))
        out: list[tuple] = []
        for key, own in groupby(every, key=lambda row: row.conv_id):
            for made in fold(own):
                out.append((key, *made))
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(run, schema)


def chunk_turns(clean: DataFrame) -> DataFrame:
    """Speaker-turn chunks of preprocessed segments: 400 tokens at most, overlap of about 50 within a speaker."""

    def fold(rows: Iterable) -> Iterator[tuple]:
        for n, group in enumerate(fold_turns((r.speaker, r.text, r.start_ms, r.end_ms) for r in rows)):
            joined = " ".join(g[1] for g in group)
            yield n, group[0][0], group[0][2], group[-1][3], joined, _tokens(joined)

    return fold_sorted(clean.select("conv_id", "seq", "speaker", "text", "start_ms", "end_ms"), fold, "conv_id long, chunk int, speaker string, start_ms long, end_ms long, text string, tokens long")


def fold_long(rows: Iterable, most: int, overlap: int, short: int, carry_rows: int) -> Iterator[list[tuple]]:
    """Groups of (text, at): one if all is at most ``short`` tokens, else up to ``most`` with the last rows carried over."""
    rows, first, total = iter(rows), [], 0
    for row in rows:
        first.append(row)
        total += _tokens(row[0])
        if total > short:
            break
    if total <= short:
        yield first
        return
    held: list[tuple] = []
    size = 0
    for row in chain(first, rows):
        cost = _tokens(row[0])
        if held and size + cost > most:
            yield held
            carry: list[tuple] = []
            size = 0
            for old in reversed(held):
                if len(carry) == carry_rows or size + _tokens(old[0]) > overlap:
                    break
                carry.insert(0, old)
                size += _tokens(old[0])
            held = carry
        held = [*held, row]
        size += cost
    yield held


def chunk_long(rows: DataFrame, most: int = 3000, overlap: int = 300, short: int = 1500, carry_rows: int = 6) -> DataFrame:
    """Whole-transcript chunks: one if it is short, else up to ``most`` tokens with the last segments carried over."""

    def fold(own: Iterable) -> Iterator[tuple]:
        for n, group in enumerate(fold_long(((r.text, r.timestamp_ms) for r in own), most, overlap, short, carry_rows)):
            yield n, group[0][1], group[-1][1], len(group), "\n".join(g[0] for g in group)

    return fold_sorted(rows.select("conv_id", "seq", "text", "timestamp_ms"), fold, "conv_id long, chunk int, start_ms long, end_ms long, segments int, text string")
