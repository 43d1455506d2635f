"""Mixing sources to target weights, by blocks.

The words of each source, documents in a fixed pseudorandom order, are packed into blocks of ``block_words``. Targets
come from water-filling: sources share all words by weight, none above three times its own. The output is dealt in
shards of ``slots_per_shard`` blocks; each shard draws multinomial source counts with the probabilities of what the
sources still lack, so the totals meet the targets. The j-th draw of a source takes block P(j mod b) of its b blocks,
where P is a keyed permutation of [0, b): every block is used once before any is used again, and three times at most.
Draws and blocks are joined by (source, block).

Null texts have no words; null ids and sources are values like any other (null sources come last). Documents without
words take 0. Ties and repeated rows are placed one by one, an empty table gives an empty result, extra columns and
their names don't matter. Draws depend on ``seed`` and the data alone, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import bucket_offsets, materialize, table, whole_row

WEIGHTS, MOST, BLOCK_WORDS, SLOTS_PER_SHARD, GROUPS, SEED = (5, 2, 1), 3, 128, 1 << 14, 4096, 11
BUCKETS = 512


def n_words(text: Column) -> Column:
    """Number of words; runs of blanks collapse, then blanks are counted."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(one) == 0, F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of all words by weight; what exceeds ``most`` times a source's size is shared anew among the others."""
    left, total, out = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while left:
        weight = sum(weights[i % len(weights)] for i in left)
        share = {i: total * weights[i % len(weights)] / weight for i in left}
        full = {i for i in left if share[i] > most * sizes[i]}
        if not full:
            for i in left:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            total -= out[i]
        left -= full
    return out


def placed_words(docs: DataFrame) -> DataFrame:
    """Every row with ``_src`` (source number), ``_size`` (words) and ``_start`` (words of its source before it)."""
    rows = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_size", F.lit(SEED)), F.lit(BUCKETS)).cast("int"))
    base = bucket_offsets(rows, ["_src"], "_bucket", F.col("_size"))
    order = Window.partitionBy("_src", "_bucket").orderBy("doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    return rows.join(base, ["_src", "_bucket"]).withColumn("_start", F.col("_start") + F.col("base")).drop("base", "_bucket")


def lacking(sizes: list[int], goals: list[float], block_words: int) -> list[int]:
    """Blocks that each source is to give, repeats counted."""
    lack = []
    for size, goal in zip(sizes, goals):
        b = math.ceil(size / block_words)
        rounds, rest = divmod(goal, size) if size else (0, 0)
        lack.append(min(int(rounds) * b + round(rest / block_words), MOST * b))
    return lack


def draw(need: np.ndarray, slots: int, seed: int | list[int]) -> Iterator[np.ndarray]:
    """Per output shard of ``slots`` blocks: multinomial source counts, by what the sources still lack, until none lacks any."""
    need, rng = np.array(need, np.int64), np.random.default_rng(seed)
    while need.sum() > 0:
        room, counts = min(slots, int(need.sum())), np.zeros(len(need), np.int64)
        while room > 0:  # draws beyond what a source lacks are drawn again among the others
            got = np.minimum(rng.multinomial(room, (need - counts) / (need - counts).sum()), need - counts)
            counts += got
            room -= int(got.sum())
        need = need - counts
        yield counts


def shard_plan(spark: SparkSession, need: list[int], slots_per_shard: int, seed: int) -> DataFrame:
    """(shard, _src, first, n): each shard's draws of each source, ``first`` counts the source's draws before.

    The driver draws for at most GROUPS groups of whole shards; tasks draw the shards of a group, seeded by its number.
    """
    per_group = -(-max(1, -(-sum(need) // slots_per_shard)) // GROUPS)
    done, rows = np.zeros(len(need), np.int64), []
    for g, counts in enumerate(draw(np.array(need), slots_per_shard * per_group, seed)):
        rows.append((g, done.tolist(), counts.tolist()))
        done = done + counts
    groups = spark.createDataFrame(rows, "g int, done array<long>, need array<long>")

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for g, first, want in zip(pdf["g"], pdf["done"], pdf["need"]):
                first = np.array(first, np.int64)
                for k, counts in enumerate(draw(np.array(want, np.int64), slots_per_shard, [seed, int(g)])):
                    out += [(int(g) * per_group + k, int(i), int(first[i]), int(counts[i])) for i in np.flatnonzero(counts)]
                    first = first + counts
            yield pd.DataFrame(out, columns=["shard", "_src", "first", "n"])

    return groups.repartition(_parts(spark), "g").mapInPandas(unfold, "shard int, _src int, first long, n long")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def permuted(j: Column, b: Column, key: Column, rounds: int = 12) -> Column:
    """A keyed permutation of [0, b) at j mod b: the swap-or-not shuffle, which pairs x with k - x in every round."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(SEED)), b) - x, b)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, other)), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.pmod(j, b), step)


def mix(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From rows with doc_id, source and ``_size``: (rows with _rid, _src, _start, _goal, _total; pieces taken).

    Pieces: _rid, shard, slot, epoch, first word, number of words. One row per source is gathered on the driver, to
    fill targets and to draw; sources are few by nature.
    """
    spark = slim.sparkSession
    totals = slim.groupBy("source").agg(F.sum("_size").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [int(r["n"]) for r in totals]
    goals = targets(sizes, weights)
    known = spark.createDataFrame([(r["source"], i, s, g) for i, (r, s, g) in enumerate(zip(totals, sizes, goals))], "_name string, _src int, _total long, _goal double")
    rows = slim.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = materialize(placed_words(rows).withColumn("_rid", F.monotonically_increasing_id()), "placed")
    first = F.floor(F.col("_start") / block_words)
    last = F.floor((F.col("_start") + F.col("_size") - 1) / block_words)
    parts = rows.where("_size > 0").select("_rid", "_src", "_start", "_size", F.explode(F.sequence(first, last)).alias("block"))
    word = F.greatest(F.col("block") * block_words, F.col("_start"))
    parts = parts.select("_rid", "_src", "block", (word - F.col("_start")).alias("word"), (F.least((F.col("block") + 1) * block_words, F.col("_start") + F.col("_size")) - word).alias("n"))
    plan = materialize(shard_plan(spark, lacking(sizes, goals, block_words), slots_per_shard, seed), "plan")
    counts = spark.createDataFrame([(i, math.ceil(s / block_words)) for i, s in enumerate(sizes)], "_src int, b long")
    # A shard's draws of a source are cut into runs of 512, so that no task unfolds a large range.
    runs = plan.select("_src", "shard", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 512))).alias("run")).repartition(_parts(spark), "_src", "shard", "run")
    begin = F.col("first") + F.col("run") * 512
    slots = runs.select("_src", "shard", F.explode(F.sequence(begin, F.least(F.col("first") + F.col("n"), begin + 512) - 1)).alias("slot"))
    slots = slots.join(F.broadcast(counts), "_src").select("_src", "shard", "slot", F.floor(F.col("slot") / F.col("b")).cast("int").alias("epoch"), permuted(F.col("slot"), F.col("b"), F.col("_src")).alias("block"))
    return rows, slots.join(parts, ["_src", "block"]).select("_rid", "shard", "slot", "epoch", "word", "n")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("_size")), "sized")
    rows, taken = mix(slim)
    got = taken.groupBy("_rid").agg(F.sum("n").alias("got"))
    return rows.join(got, "_rid", "left").select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_goal").alias("target"), F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row per document and epoch in which blocks of it were drawn, with the words drawn.

    A document whose words are all drawn in an epoch keeps its text as it is; otherwise the words drawn are joined by
    single spaces in their order. Columns stay those of ``docs``; n_chars, where there is one, follows the new text.
    Texts are shuffled once, to meet their spans: rows are known by id, a hash of all columns and, for equal rows, a number.
    """
    names = docs.columns
    key = F.xxhash64(*names).alias("_key")
    number = lambda df, doc_id: df.withColumn("_nth", F.row_number().over(Window.partitionBy(doc_id, "_key").orderBy(F.lit(1))))
    slim = materialize(number(docs.select("doc_id", "source", key, n_words(F.col("text")).alias("_size")), "doc_id"), "sized")
    rows, taken = mix(slim, seed=seed)
    spans = taken.groupBy("_rid", "epoch").agg(F.sum("n").alias("_got"), F.array_sort(F.collect_list(F.struct("word", "n"))).alias("_spans"))
    spans = rows.join(spans, "_rid").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("_nth").alias("_n"), "_size", "_got", "_spans")
    full = number(docs.select(whole_row(docs), F.col("doc_id").alias("_own"), key), "_own")
    out = full.join(spans, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & (F.col("_nth") == F.col("_n")))
    text = F.col("_row.text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform(F.col("_spans"), lambda s: F.slice(words, (s["word"] + 1).cast("int"), s["n"].cast("int")))), " ")
    out = out.select("_row", F.when(F.col("_got") == F.col("_size"), text).otherwise(cut).alias("_new"))
    new = {"text": F.col("_new")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length("_new").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in names])
