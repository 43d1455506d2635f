"""Lexical, vector and fused retrieval as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import scores, text
from loomline.operators.work import written


def query_terms(query: str) -> list[str]:
    """The tokens of a query, as ``functions.text.tokens`` cuts them."""
    import re

    lower = re.sub("['’]", "", re.sub(r"['’]s(?![A-Za-z0-9_])", "", query.lower()))
    return [w for w in re.sub(r"[^a-z0-9-]+", " ", lower).split(" ") if len(w) > 2]


def once(words: Column) -> Column:
    """A column that is used several times, computed once a row: projections are not merged over a generator."""
    return F.explode(F.array(words))


def with_words(docs: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, w): each row's different tokens, cut once a row, however often ``w`` is used."""
    return docs.select(*keys, once(F.array_distinct(text.tokens(F.col("text")))).alias("w"))


def term_counts(docs: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, len, tf0, tf1, ...): the tokens of each document and how often each term is among them."""
    words = docs.select(*keys, once(text.tokens(F.col("text"))).alias("w"))
    hits = words.select(*keys, F.size("w").cast("long").alias("len"), once(F.filter("w", lambda x: x.isin(terms))).alias("h"))
    count = lambda t: F.size(F.filter("h", lambda x: x == t)).cast("long")
    return hits.select(*keys, "len", *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])


def bm25_scan(docs: DataFrame, key: str, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of all documents with a term: texts are cut up once, and a row of counts per document is written."""
    different = list(dict.fromkeys(terms))
    counts = written(term_counts(docs, [key], different))
    tf = [F.col(f"tf{i}") for i in range(len(different))]
    sums = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(x > 0).alias(f"d{i}") for i, x in enumerate(tf)]).first()
    score = F.lit(0.0)
    for i, term in enumerate(different):
        idf = max(0.0, math.log(1 + (sums["n"] - sums[f"d{i}"] + 0.5) / (sums[f"d{i}"] + 0.5)))
        score = score + F.lit(terms.count(term) * idf) * tf[i] * (k1 + 1) / (tf[i] + k1 * (1 - b + b * F.col("len") / F.lit(sums["avg"] or 1.0)))
    return counts.where(F.greatest(F.lit(0), *tf) > 0).select(key, score.alias("score"))


def bm25_many(index: DataFrame, queries: DataFrame, n_docs: int, avg_len: float, key: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) for a table of (query_id, term) against an index: one join by term, one aggregate.

    Terms of queries are joined by hash; Spark splits a very common term's side.
    """
    wanted = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    used = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = wanted.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    return used.join(weighted, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))


def cosine_search(vectors: DataFrame, query: DataFrame, key: str = "vec_id", floor: float | None = None, scope: Column | None = None) -> DataFrame:
    """(key, similarity) of all vectors in scope against one query vector (a one-row frame with column ``q``)."""
    rows = vectors if scope is None else vectors.where(scope)
    out = rows.crossJoin(F.broadcast(query)).select(key, scores.cosine(F.col("embedding"), F.col("q")).alias("similarity")).where("similarity IS NOT NULL")
    return out if floor is None else out.where(F.col("similarity") >= floor)


def fuse_arms(semantic: DataFrame, lexical: DataFrame, key: str, weight: float = 0.6) -> DataFrame:
    """Full outer merge of (key, semantic) and (key, lexical) with the combined score."""
    return semantic.join(lexical, key, "full_outer").withColumn("score", scores.hybrid(F.col("semantic"), F.col("lexical"), weight))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of a total order; every task keeps its own k, so nothing is sorted whole."""
    return rows.orderBy(*order).limit(k)


def rrf(ranked: DataFrame, key: str = "id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (source, key, rank from 1[, weight]): sum of weight / (k + rank) and the sources."""
    weight = F.col("weight") if "weight" in ranked.columns else F.lit(1.0)
    return ranked.groupBy(key).agg(F.sum(weight / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("sources"))


def rank_each(rows: DataFrame, k: int, *order: Column, part: list[str] | None = None) -> DataFrame:
    """The first k rows (of each part) with their rank; parts are cut to k before they are ranked where there is one part."""
    if part:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)
    first = rows.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def keep_best(hits: DataFrame, key: str, score: str, seq: str, carry: list[str]) -> DataFrame:
    """Best hit per key (first of ties); columns in ``carry`` that it lacks come from the next best that has them."""
    order = Window.partitionBy(key).orderBy(F.desc(score), seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = hits.select("*", *[F.first(c, ignorenulls=True).over(order).alias(f"_{c}") for c in carry], F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), seq)).alias("_n"))
    kept = filled.where("_n = 1")
    for c in carry:
        kept = kept.withColumn(c, F.col(f"_{c}"))
    return kept.drop("_n", *[f"_{c}" for c in carry])


def normalise_by_max(rows: DataFrame, score: str) -> DataFrame:
    """Divide by the greatest score; all 0 if that isn't positive. The maximum is one aggregated row."""
    high = rows.agg(F.max(score).alias("_max"))
    return rows.crossJoin(F.broadcast(high)).withColumn(score, F.when(F.col("_max") > 0, F.col(score) / F.col("_max")).otherwise(0.0)).drop("_max")
