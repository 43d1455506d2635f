"""Centroid clustering by Ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that no member exceeds. Before each round the driver finds, for each ball,
its neighbours: centroids less than two radii away, by distance. A task then handles the members of a ball together:

* *stable core*: members nearer to their centroid than half the way to the nearest neighbour; they stay, uncompared;
* *annuli*: a member beyond half the way to the first r neighbours is compared with those r exactly, and with no other.

A member keeps its ball as written in the work table (``ball``). The comparison is exact whatever that ball is, so the
table is written again only when more than ``REWRITE`` of the members have left it; the radius is then the greatest
distance at the time of writing plus the way that the centroid has moved since. Every round sums by cluster inside the
tasks: one row per task, cluster and component is shuffled, one row per cluster and component reaches the driver.
Vectors are never shuffled.

Rows whose vector is null, has another number of components, or holds a null, NaN or infinite component are left out.
Components beyond +-32768 can't be summed in 64 bits: an error. Repeated rows count one by one; equal start hashes (equal
ids) are ordered by the vector; a null id hashes as the empty string. With fewer vectors than centroids there are as many
centroids as vectors; an empty table gives no rows. Equal distances go to the smaller number. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialize, table

K, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
LARGEST = 1 << 25  # greatest component: four squared distances of 64 of them stay below 2**63
REWRITE = 0.1
_BATCH = 4096  # vectors at a time
HEAD = N, MOVED, COMPARED = -3, -2, -1  # what is summed beside the components


@dataclass(frozen=True)
class Balls:
    """Centroids and, per ball, the neighbours by distance with the squared ways to them."""

    centroids: np.ndarray
    near: tuple[np.ndarray, ...]
    ways: tuple[np.ndarray, ...]


def balls(centroids: np.ndarray, radii: list[int] | None = None) -> Balls:
    """Balls with their neighbours; without radii every other centroid is one."""
    near, ways = [], []
    for j, c in enumerate(centroids):
        gaps = ((centroids - c) ** 2).sum(axis=1)
        order = np.argsort(gaps, kind="stable")
        order = order[order != j]
        if radii is not None:
            order = order[gaps[order] <= 4 * radii[j] ** 2]
        near.append(order)
        ways.append(gaps[order])
    return Balls(centroids, tuple(near), tuple(ways))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, ball: np.ndarray, known: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances that took. ``ball`` is any guess."""
    cluster, distance, compared = ball.copy(), np.empty(len(x), np.int64), 0
    for j in np.unique(ball):
        rows = np.flatnonzero(ball == j)
        best = _squares(x[rows], known.centroids[j])
        to = np.full(len(rows), j, ball.dtype)
        reach = np.searchsorted(known.ways[j], 4 * best, side="right")  # 0: the stable core
        compared += len(rows) + int(reach.sum())
        for r in range(int(reach.max(initial=0))):
            i, some = known.near[j][r], np.flatnonzero(reach > r)
            new = _squares(x[rows[some]], known.centroids[i])
            won = (new < best[some]) | ((new == best[some]) & (i < to[some]))
            best[some[won]], to[some[won]] = new[won], i
        cluster[rows], distance[rows] = to, best
    return cluster, distance, compared


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def members_of(vectors: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v, ball): kept vectors as 32-bit little-endian integers floor(scale * x), all in ball 0."""

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _BATCH) for b in batches for at in range(0, b.num_rows, _BATCH)):
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if np.abs(x).max(initial=0) > LARGEST:
                raise OverflowError(f"components beyond {LARGEST / scale} can't be clustered in 64-bit integers")
            data = x.astype("<i4").tobytes()
            rows = pa.array([data[i : i + 4 * width] for i in range(0, len(data), 4 * width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(np.zeros(batch.num_rows, np.int32))], ["vec_id", "v", "ball"])

    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(v) == width) & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(convert, "vec_id long, v binary, ball int")


def first_centroids(members: DataFrame, k: int, width: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids: k rows to the driver."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = members.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<i4").reshape(-1, width).astype(np.int64)


def assigned(members: DataFrame, known: Balls, width: int) -> DataFrame:
    """(vec_id, v, ball, distance) with each vector in the ball of its nearest centroid."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _BATCH) for b in batches for at in range(0, b.num_rows, _BATCH)):
            cluster, distance, _ = nearest(_vectors(batch.column(1), width), batch.column(2).to_numpy(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance)], ["vec_id", "v", "ball", "distance"])

    return members.select("vec_id", "v", "ball").mapInArrow(assign, "vec_id long, v binary, ball int, distance long")


def sums(members: DataFrame, known: Balls, width: int) -> DataFrame:
    """(cluster, item, total): items 0, 1, ... are components, the negative ones those of ``HEAD``.

    A task gives one row per cluster and item, so what is shuffled doesn't grow with the vectors.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(known.centroids)
        total = np.zeros((k, width + len(HEAD)), np.int64)
        head = total[:, width:]
        for batch in (b.slice(at, _BATCH) for b in batches for at in range(0, b.num_rows, _BATCH)):
            x, ball = _vectors(batch.column(0), width), batch.column(1).to_numpy()
            cluster, distance, compared = nearest(x, ball, known)
            head[0, COMPARED] += compared
            for j in np.unique(cluster):
                mine = cluster == j
                total[j, :width] += x[mine].sum(axis=0)
                head[j, N] += mine.sum()
                head[j, MOVED] += (ball[mine] != j).sum()
        items = np.concatenate([np.arange(width), np.arange(-len(HEAD), 0)]).astype(np.int32)
        clusters = np.repeat(np.arange(k, dtype=np.int32), len(items))
        yield pa.RecordBatch.from_arrays([pa.array(clusters), pa.array(np.tile(items, k)), pa.array(total.ravel())], ["cluster", "item", "value"])

    parts = members.select("v", "ball").mapInArrow(add, "cluster int, item int, value long")
    return parts.groupBy("cluster", "item").agg(F.sum("value").alias("total"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, counts: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    ``counts`` receives how many exact distances each round took (k * vectors without balls).
    """
    members = materialize(members_of(vectors, id_col, vec_col, width, scale), "vectors")
    centers = first_centroids(members, k, width)
    if not len(centers):
        return members.select("vec_id", F.col("ball").alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    known, written, radii = balls(centers), None, [0] * len(centers)
    for n in range(rounds):
        if written is None or moved > REWRITE * total:  # noqa: F821  (set at the end of the round before)
            before, members, written = members, materialize(assigned(members, known, width), "members"), centers
            discard(before)
            farthest = dict(members.groupBy("ball").agg(F.max("distance")).collect())  # one row per cluster
            radii = [isqrt(farthest.get(j, 0)) + 1 for j in range(len(centers))]
            known = balls(centers, radii)
        got = np.zeros((len(centers), width + len(HEAD)), object)
        for r in sums(members, known, width).collect():  # one row per cluster and component
            got[r["cluster"], r["item"]] = r["total"]
        moved, total = got[:, MOVED].sum(), got[:, N].sum()
        if counts is not None:
            counts.append(int(got[:, COMPARED].sum()))
        centers = np.array([[s // g[N] for s in g[:width]] if g[N] else c for g, c in zip(got, centers)], np.int64)
        ways = [isqrt(int(g)) + 1 for g in ((centers - written) ** 2).sum(axis=1)]
        known = balls(centers, [r + w for r, w in zip(radii, ways)])
    last = materialize(assigned(members, known, width).select("vec_id", F.col("ball").alias("cluster"), "distance"), "clusters")
    discard(members)
    inertia = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    facts = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in inertia), digest[r["cluster"]]) for r in inertia]
    shared = members.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(shared), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """One step per round over rows (vector, dimension, value)."""
    near = "d{n} AS MATERIALIZED (SELECT r, j, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{n} c USING (i) GROUP BY r, j), a{n} AS MATERIALIZED (SELECT r, j, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"
    move = "s{n} AS MATERIALIZED (SELECT j, i, sum(v)::HUGEINT AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY j, i), c{m} AS MATERIALIZED (SELECT c.j, c.i, CASE WHEN s.n IS NULL THEN c.v ELSE ((s.s - ((s.s % s.n + s.n) % s.n)) // s.n)::BIGINT END AS v FROM c{n} c LEFT JOIN s{n} s USING (j, i))"
    steps = [part for n in range(ROUNDS) for part in (near.format(n=n), move.format(n=n, m=n + 1))] + [near.format(n=ROUNDS)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = {WIDTH}
), x AS MATERIALIZED (
  SELECT r, unnest(range({WIDTH})) AS i, unnest(list_transform(e, lambda z: floor({SCALE} * z::DOUBLE)::BIGINT)) AS v FROM k
), f AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS j FROM k QUALIFY j < {K}
), c0 AS MATERIALIZED (SELECT j, i, v FROM f JOIN x USING (r)), {", ".join(steps)},
h AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT k.vec_id, a.j::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN k USING (r) JOIN h USING (j)
"""


ORACLE_SQL = _oracle()
