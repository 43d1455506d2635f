"""Ranked lexical search over a tiered index.

*Index.* Each task turns its documents into segments of bounded size (``SEGMENT_BYTES`` of text). A segment holds the
postings of all its terms: (place of the document in the segment, occurrences). A term's postings are ordered by impact,
which is the part of the score that depends on the document, and cut into tiers: tier 0 holds the highest impacts, and
short lists whole, tier 1 the next quarter, tier 2 the rest. Each list keeps, per tier, the residual: the highest impact
in the tiers below. Postings never leave their segment, so none is shuffled and a hot term is split as documents are.

*Search.* Tier 0 is read first. In a segment, a document's score lies between the sum of what was read and that sum plus
the residuals of the terms for which the document wasn't met. The tenth best lower bound over all segments is the item's
threshold. An item is proven in a segment when every document whose score isn't exact stays below the threshold; items
without proof fall through there: the segment's next tiers are read for them, until the last tier leaves no residual.
So the result is exact, ties included, and lower tiers are read only where they can matter.

Each item is scored in a segment by one task; per item and segment at most twice ``k`` candidates and a bound leave it.
Items are dealt into groups of about ``GROUP``, so that no list of items grows. The items' terms are broadcast if their
counted number is at most ``BROADCAST_TERMS``, and joined by shuffle otherwise.

Null and term-less documents and items have no rows. Repeated documents rank one by one, equal ids by their segment and
place; null ids come last among equal scores. Items equal in id and text are one; items that share only the id rank
apart under that id. A very long text is a segment of its own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialize, slices, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
TIERS = 3
WHOLE = 32  # lists of up to so many postings in a segment are in tier 0
SEGMENT_BYTES, SEGMENT_DOCS = 12 << 20, 60_000
GROUP, BROADCAST_TERMS = 256, 200_000
_IN_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if _IN_TERM[b] else 32 for b in range(256))
_BLOCKS = pa.schema([("tier", pa.int32()), ("term", pa.string()), ("seg", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("rest", pa.int64())])
_ROWS = "qid long, seg long, place int, doc_id long, score long, exact boolean"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, nulls as empty, and the borders of its rows in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in (p for b in batches for p in slices(b, 0)):
            data, ends = _bytes(batch.column(0))
            inside = _IN_TERM[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = ends[:-1][ends[:-1] < len(data)]
            begins[first] = inside[first]  # a text's first byte follows no byte
            upto = np.concatenate([[0], np.cumsum(begins)])
            sizes = upto[ends[1:]] - upto[ends[:-1]]
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select(F.col("text").cast("string")).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


class _Lexicon(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _cut(values: np.ndarray, starts: np.ndarray, dtype: str) -> pa.Array:
    """Binary values: ``values`` cut at ``starts``."""
    data = values.astype(dtype)
    borders = np.append(starts, len(values)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _segment(seg: int, ids: list[int | None], texts: list[np.ndarray], lexicon: _Lexicon, n_docs: int, n_terms: int, whole: int) -> pa.RecordBatch:
    """The rows of a segment: one of tier -1 with ids and lengths of its documents, and one per term and tier."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    known = sorted(lexicon)
    rank = np.empty(len(known), np.int64)
    rank[[lexicon[t] for t in known]] = np.arange(len(known))
    keys = np.concatenate([rank[texts[i]] << 16 | place for place, i in enumerate(order)] or [np.empty(0, np.int64)])
    keys, counts = np.unique(keys, return_counts=True)
    term, place = keys >> 16, keys & 0xFFFF
    weight = impact(counts, lengths[place], n_docs, n_terms)
    by_impact = np.lexsort((-weight, term))
    term, place, counts, weight = term[by_impact], place[by_impact], counts[by_impact], weight[by_impact]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(starts, append=len(term))
    at, size = np.arange(len(term)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    high = np.maximum(whole, -(-size // 16))
    tier = (at >= high).astype(np.int64) + (at >= high + size // 4)
    heads = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tier, prepend=-1) != 0))
    ends = np.append(heads[1:], len(term))
    after = np.minimum(ends, max(0, len(term) - 1))
    rest = np.where((ends < len(term)) & (term[after] == term[heads]), weight[after], 0) if len(term) else np.empty(0, np.int64)
    inside = np.lexsort((place, tier, term))  # within a list: by place
    none = sum(i is None for i in ids)
    own = np.array([ids[i] or 0 for i in order], "<i8")
    first = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([seg]), pa.array([len(ids)]), pa.array([own.tobytes()], pa.binary()), pa.array([lengths.astype("<u4").tobytes()], pa.binary()), pa.array([none])], schema=_BLOCKS)
    terms = pa.array(known, pa.binary()).cast(pa.string()).take(pa.array(term[heads]))
    lists = pa.RecordBatch.from_arrays([pa.array(tier[heads].astype(np.int32)), terms, pa.array(np.full(len(heads), seg)), pa.array(ends - heads), _cut(place[inside], heads, "<u2"), _cut(counts[inside], heads, "<u4"), pa.array(rest)], schema=_BLOCKS)
    return pa.Table.from_batches([first, lists]).combine_chunks().to_batches()[0]


def impact(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's occurrences in a document of that length are worth; at most 1,000,000."""
    m = 100 - 90 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


@dataclass(frozen=True)
class TieredIndex:
    """``rows``: the lists and, as tier -1, the segments; ``n_docs`` and ``n_terms`` as the scores need them."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, whole: int = WHOLE) -> TieredIndex:
    """The index of all documents and all terms, as a table with a folder per tier.

    A segment has at most ``segment_bytes`` of text, or one document; lists of up to ``whole`` postings are all tier 0.
    """
    n_docs, n_terms = statistics(docs)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, held, ids, texts, lexicon = TaskContext.get().partitionId() << 24, 0, [], [], _Lexicon()
        for batch in (p for b in batches for p in slices(b, 1)):
            data, ends = _bytes(batch.column(1))
            plain = data.tobytes().translate(_LOWER)
            for doc_id, begin, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if words := plain[begin:end].split():
                    if ids and (held + end - begin > segment_bytes or len(ids) >= SEGMENT_DOCS):
                        yield _segment(seg, ids, texts, lexicon, n_docs, n_terms, whole)
                        seg, held, ids, texts, lexicon = seg + 1, 0, [], [], _Lexicon()
                    ids.append(doc_id)
                    texts.append(np.fromiter(map(lexicon.__getitem__, words), np.int32, len(words)))
                    held += end - begin
        if ids:
            yield _segment(seg, ids, texts, lexicon, n_docs, n_terms, whole)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(index, "tier int, term string, seg long, n long, docs binary, counts binary, rest long")
    return TieredIndex(materialize(rows.sortWithinPartitions("tier", "term"), "tiers", "tier", compression="zstd"), n_docs, n_terms)


def _best(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of the places ``among``, equal scores by place."""
    if len(among) > 4 * k:
        among = among[score[among] >= np.partition(score[among], len(among) - k)[len(among) - k]]
    return among[np.argsort(-score[among], kind="stable")][:k]


def _score(lists: DataFrame, segments: DataFrame, index: TieredIndex, k: int) -> DataFrame:
    """Candidates of each item and segment, and the highest score that an inexact document can have there (place -1)."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            seg, own, lengths, none, wanted = (right.column(c)[0].as_py() for c in ("seg", "ids", "lengths", "none", "open"))
            own, lengths = np.frombuffer(own, "<i8"), np.frombuffer(lengths, "<u4").astype(np.int64)
            wanted, terms = wanted and set(wanted), {}
            for term, tier, docs, counts, rest, items in zip(*[left.column(c).to_pylist() for c in ("term", "tier", "docs", "counts", "rest", "items")]):
                places = np.frombuffer(docs, "<u2")
                got = terms.setdefault(term, [[], [], -1, 0, items])
                got[0].append(places)
                got[1].append(impact(np.frombuffer(counts, "<u4").astype(np.int64), lengths[places], n_docs, n_terms))
                if tier > got[2]:
                    got[2], got[3] = tier, rest
            queries: dict[int, list] = {}
            for places, worth, _, rest, items in terms.values():
                places, worth = np.concatenate(places), np.concatenate(worth)
                for item in items:
                    if not wanted or item["qid"] in wanted:
                        queries.setdefault(item["qid"], []).append((places, worth, rest, item["w"]))
            for qid, parts in queries.items():
                total, slack = np.zeros(len(own), np.int64), np.full(len(own), sum(w * rest for _, _, rest, w in parts), np.int64)
                for places, worth, rest, w in parts:
                    total[places] += w * worth
                    if rest:
                        slack[places] -= w * rest
                inexact, met = slack > 0, np.flatnonzero(total)
                if inexact.any():
                    out.append((qid, seg, -1, None, int((total + slack)[inexact].max()), False))
                for place in {*_best(total, met, k).tolist(), *_best(total, met[~inexact[met]], k).tolist()}:
                    out.append((qid, seg, place, None if place >= len(own) - none else int(own[place]), int(total[place]), not inexact[place]))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()])], ["qid", "seg", "place", "doc_id", "score", "exact"])

    return lists.groupBy("part", "seg").cogroup(segments.groupBy("part", "seg")).applyInArrow(score, _ROWS)


def search(index: TieredIndex, items: DataFrame, k: int = K, falls: list[int] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    ``falls`` receives, per tier after the first, in how many (item, segment) pairs that tier was read.
    """
    spark = items.sparkSession
    own = materialize(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().withColumn("qid", F.monotonically_increasing_id()), "items")
    parts = max(1, -(-own.count() // GROUP))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = own.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")), "asked")
    few = asked.select("term").distinct().count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    lists = index.rows.where("tier >= 0")
    df = lists.select("term", "n").join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = materialize(asked.join(df.withColumn("w", weight), "term").groupBy("part", "term").agg(F.collect_list(F.struct("qid", "w")).alias("items")), "terms")  # at most the items of a part
    segments = index.rows.where("tier = -1").select(F.col("seg").alias("seg"), F.col("docs").alias("ids"), F.col("counts").alias("lengths"), F.col("rest").alias("none"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def stage(tier: int, open_items: DataFrame | None) -> DataFrame:
        found = lists.where(F.col("tier") <= tier).join(small(terms), "term")
        if open_items is None:
            return _score(found, segments.withColumn("open", F.lit(None).cast("array<long>")), index, k)
        grouped = open_items.join(asked.select("qid", "part").distinct(), "qid").groupBy("part", "seg").agg(F.collect_list("qid").alias("open"))
        return _score(found.join(grouped.select("part", "seg"), ["part", "seg"], "left_semi"), segments.join(grouped, ["part", "seg"]), index, k)

    rows = materialize(stage(0, None), "tier-0")
    for tier in range(1, TIERS):
        documents = rows.where("place >= 0")
        order = Window.partitionBy("qid").orderBy(F.desc("score"))
        least = documents.select("qid", "score", F.row_number().over(order).alias("r")).where(F.col("r") <= k).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        bounds = rows.where("place = -1").join(least, "qid", "left").where("score >= coalesce(least, 1)").select("qid", "seg")
        unproven = materialize(bounds, "unproven")
        if falls is not None:
            falls.append(unproven.count())
        if not unproven.take(1):
            break
        before = rows
        rows = materialize(rows.join(unproven, ["qid", "seg"], "left_anti").unionByName(stage(tier, unproven)), f"tier-{tier}")
        discard(before)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "seg", "place")
    best = rows.where("exact").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(own.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2.0 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g WHERE term IN (SELECT term FROM q) GROUP BY term, nn
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
