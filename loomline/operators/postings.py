"""A stored inverted index: posting blocks in folders by term bucket, with what bounds a block's scores.

``write_index`` reads the texts once. A row's tokens are counted in the row, so postings leave it counted; they are
shuffled once, by bucket of the term and stripe of ids, so a very common term is spread over tasks. A block holds the
postings of one term for ids of one range. A search names the buckets of its terms, so that other folders aren't listed,
and the terms, so that row groups (sorted by term) are skipped by their statistics.

``top`` reads the blocks' bounds first (four numbers a block), scores the ids of the most promising ranges exactly, and
then only ranges whose bound reaches the k-th score so far: the result is exact.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators.work import dropped, kept, shared_folder

BUCKETS, REACH, STRIPE = 64, 4096, 256  # term folders; ids in a block; blocks that go to one task
K1, B = 1.5, 0.75
_ROUND = 1e-6  # scores are compared after rounding to six decimals


def _once(c: Column) -> Column:
    """Computed once a row although it is used several times: projections are not merged over a generator."""
    return F.explode(F.array(c))


def counted(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, len, terms): [(term, tf)] of a row's sorted words: where a run begins, and how far it is to the next.

    What is used in a lambda is a column of its own, or it would be computed for every element.
    """
    words = docs.select(*keys, _once(F.sort_array(F.coalesce(text.tokens(F.col("text")), F.array().cast("array<string>")))).alias("w"))
    begins = F.filter(F.transform("w", lambda x, i: F.when(~x.eqNullSafe(F.get("w", i - 1)), i)), lambda i: i.isNotNull())
    runs = words.select(*keys, "w", _once(begins).alias("b"))
    each = F.transform("b", lambda at, n: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("b", n + 1), F.size("w")) - at).cast("long").alias("tf")))
    return runs.select(*keys, F.size("w").cast("long").alias("len"), each.alias("terms"))


@dataclass(frozen=True)
class PostingIndex:
    """``blocks``: (bucket, term, range, n, cf, tf_top, len_least, ids, rows, tfs, lens); documents and their mean length."""

    blocks: DataFrame
    n_docs: int
    avg_len: float

    def of(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms, read from their folders alone."""
        return self.blocks.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(list(dict.fromkeys(terms))))

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, key, tf, len)."""
        return _open(self.of(terms)).drop("row")

    def idf(self, terms: list[str]) -> dict[str, float]:
        """One row per term to the driver; terms without documents are missing."""
        n = self.n_docs
        row = F.greatest(F.lit(0.0), F.log(1 + (n - F.sum("n") + 0.5) / (F.sum("n") + 0.5)))
        return dict(self.of(terms).groupBy("term").agg(row.alias("idf")).collect())

    def _weights(self, terms: list[str]) -> Column | None:
        """Inverse frequency times the number of times that the query holds the term."""
        idf = self.idf(terms)
        if not idf:
            return None
        return F.create_map(*[x for t, v in idf.items() for x in (F.lit(t), F.lit(v * terms.count(t)))])[F.col("term")]

    def _part(self, weight: Column, tf: Column, length: Column, k1: float, b: float) -> Column:
        return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(self.avg_len)))

    def scores(self, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """(key, score) of all documents with a term."""
        return self._scored(self.of(terms), self._weights(terms), k1, b)

    def _scored(self, blocks: DataFrame, weight: Column | None, k1: float, b: float) -> DataFrame:
        part = F.lit(0.0) if weight is None else self._part(weight, F.col("tf"), F.col("len"), k1, b)
        return _open(blocks).groupBy("key", "row").agg(F.sum(part).alias("score")).drop("row")

    def top(self, terms: list[str], k: int, k1: float = K1, b: float = B, first: int = 4, read: list[int] | None = None) -> DataFrame:
        """(key, score): the k best, by score rounded to six decimals and key. ``read`` receives the ranges there are and those scored."""
        weight = self._weights(terms)
        if weight is None:
            return self._scored(self.of(terms), None, k1, b)
        bound = self._part(weight, F.col("tf_top"), F.col("len_least"), k1, b)
        ranges = self.of(terms).groupBy("range").agg(F.sum(bound).alias("bound"))
        best = [r["range"] for r in ranges.orderBy(F.desc("bound")).limit(first).collect()]
        rows = self._scored(self.of(terms).where(F.col("range").isin(best)), weight, k1, b).select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)
        sure = [r["score"] for r in rows.collect()]
        least = sure[-1] - 2 * _ROUND if len(sure) == k else 0.0
        open_ranges = ranges.where(F.col("bound") >= least).select("range")
        if read is not None:
            read += [ranges.count(), open_ranges.count()]
        found = self._scored(self.of(terms).join(open_ranges, "range", "left_semi"), weight, k1, b)
        return found.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def _open(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", F.inline(F.arrays_zip("ids", "rows", "tfs", "lens"))).toDF("term", "key", "row", "tf", "len")


def write_index(docs: DataFrame, key: str = "doc_id", reach: int = REACH) -> PostingIndex:
    """The index of (key, text) rows. Null texts are documents without tokens; equal keys are separate documents with one key."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "postings")
    rows = counted(docs.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), "text"), ["id", "row"])
    rows.write.parquet(f"{folder}/counted")
    held = spark.read.schema(rows.schema).parquet(f"{folder}/counted")
    spread = held.select("id", "row", "len", F.inline("terms")).withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")).withColumn("range", F.floor(F.col("id") / reach))
    dealt = spread.withColumn("stripe", F.floor(F.col("range") / STRIPE)).repartition("bucket", "stripe")
    each = F.sort_array(F.collect_list(F.struct("id", "row", "tf", "len")))  # at most ``reach`` different ids
    blocks = dealt.groupBy("bucket", "stripe", "term", "range").agg(F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("tf_top"), F.min("len").alias("len_least"), each.alias("p"))
    flat = blocks.withColumn("p", _once(F.col("p"))).select("bucket", "term", "range", "n", "cf", "tf_top", "len_least", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("id", "row", "tf", "len")])
    flat.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    sizes = held.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    dropped(spark, f"{folder}/counted")
    return PostingIndex(spark.read.schema(flat.schema).parquet(f"{folder}/blocks"), sizes["n"], sizes["avg"] or 1.0)


def kept_index(spark: SparkSession, path: str) -> PostingIndex:
    """The index of a table of documents, written once per application and state of the table."""
    return kept(spark, path, "postings", lambda docs: write_index(docs.select("doc_id", "text")), lambda index: index.blocks)
