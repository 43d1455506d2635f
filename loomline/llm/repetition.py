"""Quality rules on repetition, from a suffix array over the words of each text.

A task builds one suffix array (prefix doubling, refining only classes that are not yet single) for a block of
documents at a time. Words carry their document's number, so no common prefix reaches over a document's end. The
longest common prefixes of neighbouring suffixes give the maximal repeats; their spans are united. ``kept`` needs the
base rules, a share of words covered by repeats of ``min_repeat`` words or more of at most ``max_covered`` percent, and
no repeat longer than ``max_repeat`` words.

Nulls count as texts without words; texts without words fail the base rules. Rows are judged on their own: repeated
rows, ties and extra columns change nothing. Memory: about 150 bytes a word of a block or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.common import BLANKS, slices, small_batches, table

SYMBOLS = "#*$%&|<>"
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 20, 200
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def longest_repeats(tokens: np.ndarray) -> np.ndarray:
    """Per position: the longest prefix of the suffix from there that also begins elsewhere."""
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(new)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n])).astype(np.int32)
    array, levels, h = order, [rank.copy()], 1
    single = np.zeros(n, bool)
    while True:
        bounds = np.flatnonzero(np.r_[rank[array[1:]] != rank[array[:-1]], True])
        sizes = np.diff(np.r_[-1, bounds])
        single = np.repeat(sizes == 1, sizes)
        if single.all():
            break
        slots = np.flatnonzero(~single)  # places in the array that are not settled yet
        at = array[slots]
        second = rank[np.minimum(at + h, n)].astype(np.int64)
        first = rank[at].astype(np.int64)
        key = first * (n + 2) + second + 1
        by = np.argsort(key, kind="stable")
        at, key, first = at[by], key[by], first[by]
        array[slots] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        mine = np.arange(len(at))
        within = np.maximum.accumulate(np.where(fresh, mine, 0))
        head = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], mine, 0))
        rank[at] = (first + within - head).astype(np.int32)
        levels.append(rank.copy())
        h *= 2
    a, b = array[:-1].copy(), array[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + common] == levels[k][b + common]
        common += same.astype(np.int64) << k
    most = np.zeros(n, np.int64)
    np.maximum.at(most, a, common)
    np.maximum.at(most, b, common)
    return most


def covered(most: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more."""
    n = len(most)
    starts = np.flatnonzero(most >= least)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + most[starts], -1)
    return np.cumsum(steps[:-1]) > 0


def repeat_spans(words: list, least: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """The united spans (first word, length) of one text's maximal repeats."""
    names: dict = {}
    mask = covered(longest_repeats(np.array([names.setdefault(w, len(names)) for w in words], np.int64)), least)
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2])]


def _judge(ids: list, texts: list[str], min_repeat: int, max_covered: int, max_repeat: int) -> pa.RecordBatch:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    names: dict[bytes, int] = {}
    flat = np.array([names.setdefault(w, len(names)) for words in split for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    most = longest_repeats(doc * (len(names) + 1) + flat)
    count = lambda mask: np.bincount(doc[mask], minlength=len(texts)).astype(np.int64)
    repeat_words, covered_words = count(covered(most, 5)), count(covered(most, min_repeat))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, most)
    longest[longest < min_repeat] = 0
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup_lines.append(len(lines) - len(set(lines)))
    chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    failed = (sizes < 10) | (100 * repeat_words > 20 * sizes)
    kept = ~failed & (100 * covered_words <= max_covered * sizes) & (longest <= max_repeat)
    columns = [ids, sizes, chars, symbols, np.array(dup_lines, np.int64), repeat_words, failed, kept, covered_words, longest]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=_SCHEMA)


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT, block_chars: int = 1 << 20) -> DataFrame:
    """One row of figures and verdicts per document; no shuffle."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, block_chars):
                yield _judge(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], min_repeat, max_covered, max_repeat)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, _DDL)


def keep_unrepetitive(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT, block_chars: int = 1 << 20) -> DataFrame:
    """The documents that pass, all columns unchanged; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            for part in slices(batch, at, block_chars):
                block = _judge([0] * part.num_rows, [t or "" for t in part.column(at).to_pylist()], min_repeat, max_covered, max_repeat)
                yield part.filter(block.column("kept"))

    return docs.mapInArrow(keep, docs.schema)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def _covered_sql(name: str, k: int) -> str:
    """Words in windows of k words that are found twice or more in their text."""
    return f"""{name}_g AS (SELECT doc_id, i, list_slice(ws, i, i + {k} - 1) AS g FROM w, unnest(range(1, len(ws) - {k} + 2)) AS r(i)),
{name} AS (SELECT doc_id, count(DISTINCT p) AS c FROM (
  SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM {name}_g) WHERE n > 1) GROUP BY doc_id)"""


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
{_covered_sql("five", 5)},
{_covered_sql("many", MIN_REPEAT)},
{_covered_sql("far", MAX_REPEAT + 1)},
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.dups, 0) AS n_dup_lines, coalesce(five.c, 0) AS n_repeat_words,
  coalesce(many.c, 0) AS covered_words, far.c IS NOT NULL AS too_long
  FROM w LEFT JOIN five USING (doc_id) LEFT JOIN many USING (doc_id) LEFT JOIN far USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_words <= {MAX_COVERED} * n_words AND NOT too_long AS kept FROM b
"""
