"""Set similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

FEW_SETS, FEW_WORDS, STEP = 500, 50_000, 256  # a right side that tasks hold whole: 25 MB at most; sets compared at a time


def _needed(n: Column, share: float) -> Column:
    """How many words of the smaller set of size n must be shared."""
    return F.ceil(n * F.lit(share) - 1e-9).cast("int")


def _rare(rows: DataFrame, keys: list[str], other: DataFrame, share: float) -> DataFrame:
    """(keys, n, word): the words of each set that a partner at least as large must hold one of.

    All but ``needed - 1`` of a set's words are such; the rarest of the other side are taken. Words that the other side
    lacks come first and have no partner, so they are counted but never joined.
    """
    words = rows.select(*keys, F.size("w").alias("n"), F.explode("w").alias("word")).join(other, "word")
    known = words.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("known"))
    take = F.size("known") - _needed(F.col("n"), share) + 1  # n - needed + 1, less the n - size(known) unknown ones
    return known.where(take > 0).select(*keys, "n", F.explode(F.slice("known", F.lit(1), take)["word"]).alias("word"))


def _few(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], share: float) -> DataFrame:
    """``containment_join`` beside a small right side, which every task holds as a table of words by sets."""
    sets = right.select(*right_keys, "w").collect()
    words = pa.array(sorted({w for r in sets for w in r["w"]}), pa.string())
    at, table = {w: n for n, w in enumerate(words.to_pylist())}, np.zeros((len(words), len(sets)), np.uint8)
    for n, r in enumerate(sets):
        table[[at[w] for w in r["w"]], n] = 1
    sizes = np.array([len(r["w"]) for r in sets], np.int64)
    out = StructType([*(left.schema[k] for k in left_keys), *(right.schema[k] for k in right_keys), StructField("shared", IntegerType())])
    made = to_arrow_schema(out)
    known = [pa.array([r[k] for r in sets], made.field(k).type) for k in right_keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                w = part.column(len(left_keys))
                size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
                word = pc.fill_null(pc.index_in(w.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), size)[word >= 0]
                lines, first = np.unique(row, return_index=True)
                if not len(lines):
                    continue
                shared = np.add.reduceat(table[word[word >= 0]], first, axis=0, dtype=np.int32)
                i, j = np.nonzero(shared / np.minimum.outer(size[lines], sizes) >= share)
                yield pa.RecordBatch.from_arrays([*(part.column(n).take(pa.array(lines[i])) for n in range(len(left_keys))), *(c.take(pa.array(j)) for c in known), pa.array(shared[i, j], pa.int32())], schema=made)

    return left.select(*left_keys, "w").mapInArrow(run, out)


def containment_join(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], share: float = 0.6, few_sets: int = FEW_SETS) -> DataFrame:
    """(left keys, right keys, shared): pairs whose sets ``w`` share at least ``share`` of the smaller one.

    Candidates meet in a rare word of the smaller set (see ``_rare``); the sizes decide which that is. Frequent words are
    joined only for sets that have too few others. Candidates are then compared whole. Keys must tell rows apart; sets
    hold each word once; empty sets have no partners. A right side of few words and sets (they are counted) goes to every
    task instead, where shared words are added up without a shuffle.
    """
    l, r = left.where(F.size("w") > 0), right.where(F.size("w") > 0)
    held = r.agg(F.sum(F.size("w")).alias("words"), F.count("*").alias("sets")).first()
    if held["sets"] and held["sets"] <= few_sets and held["words"] <= FEW_WORDS:
        return _few(l, left_keys, r, right_keys, share)
    words = lambda rows, keys: rows.select(*keys, F.size("w").alias("m"), F.explode("w").alias("word"))
    counts = lambda rows: rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    by_left = _rare(l, left_keys, counts(r), share).join(words(r, right_keys), "word").where("n <= m").select(*left_keys, *right_keys)
    rare_right = _rare(r, right_keys, counts(l), share)
    by_right = rare_right.join(words(l, left_keys), "word").where("n < m").select(*left_keys, *right_keys)
    pairs = by_left.unionByName(by_right).distinct()
    whole = pairs.join(l.select(*left_keys, F.col("w").alias("_l")), left_keys).join(r.select(*right_keys, F.col("w").alias("_r")), right_keys)
    shared = whole.select(*left_keys, *right_keys, F.size(F.array_intersect("_l", "_r")).alias("shared"), F.least(F.size("_l"), F.size("_r")).alias("small"))
    return shared.where(F.col("shared") / F.col("small") >= share).select(*left_keys, *right_keys, "shared")
