"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. The linked ones are pooled into units: (group, cell), where a group's cell is a
hash of the document id, so even a group that holds a third of all rows is made of many small units. Every unit starts
on a shard of its own cell's number; in each round it proposes to move to the shard that holds most of its group, and
moves are accepted under capacity quotas: free room plus what swaps with the opposite direction make. Quotas apply to
ranges of a hash, so only (from, to, range) counts are gathered, whose number does not grow with the data. The last
step deals exact places: every shard takes its own units up to its quota, and unlinked documents and overflow fill what
room is left. The law is ``rows``: shard counts differ by one at most.

Null texts count as empty (and as equal to empty texts), with checksum 0; null ids are one id. Repeated rows are placed
one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import bucket_offsets, materialize, table

RANGES = 64  # of the hash by which moves are accepted
BUCKETS = 256  # windows per shard in which places are counted


def _cells(shards: int, per_shard: int = 12) -> int:
    return shards * per_shard


def _move(units: DataFrame, shards: int, quota: list[int]) -> tuple[DataFrame, int]:
    """One round: the units with their new labels, and how many documents moved."""
    spark = units.sparkSession
    held = units.groupBy("g", "label").agg(F.sum("n").alias("h"))
    # Ties go to a shard that the group's own hash picks, so no shard attracts more than others.
    best = held.groupBy("g").agg(F.max(F.struct("h", F.pmod(F.xxhash64("g", "label"), F.lit(1 << 30)).alias("tie"), "label")).alias("b")).select("g", F.col("b.label").alias("want"))
    wished = materialize(units.join(best, "g").withColumn("slice", F.pmod(F.xxhash64("g", "cell"), F.lit(RANGES)).cast("int")), "wishes")
    counts = wished.where("want <> label").groupBy("label", "want", "slice").agg(F.sum("n").alias("n")).collect()  # shards * shards * RANGES rows at most
    loads = {r["label"]: r["n"] for r in wished.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    flows: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts:
        flows.setdefault((r["label"], r["want"]), {})[r["slice"]] = r["n"]
    total = {k: sum(v.values()) for k, v in flows.items()}
    swap = {k: min(v, total.get((k[1], k[0]), 0)) for k, v in total.items()}
    rest = [0] * shards
    for (_, to), v in total.items():
        rest[to] += v
    for (_, to), v in swap.items():
        rest[to] -= v
    rows, moved = [], 0
    for (frm, to), slices in flows.items():
        free = max(0, quota[to] - loads.get(to, 0))
        room = swap[frm, to] + (free * (total[frm, to] - swap[frm, to]) // rest[to] if rest[to] else 0)
        upto, taken = 0, 0
        for k in range(RANGES):
            if taken + slices.get(k, 0) > room:
                break
            taken += slices.get(k, 0)
            upto = k + 1
        moved += taken
        if taken:
            rows.append((frm, to, upto))
    if not moved:
        return units, 0
    limits = spark.createDataFrame(rows, "label int, want int, upto int")  # shards * shards rows at most
    after = wished.join(F.broadcast(limits), ["label", "want"], "left").select("g", "cell", F.when(F.col("slice") < F.col("upto"), F.col("want")).otherwise(F.col("label")).alias("label"), "n")
    return materialize(after, "units"), moved


def propagate(units: DataFrame, shards: int, quota: list[int], rounds: int = 6) -> DataFrame:
    """Move units (g, cell, label, n) towards the shards of their groups until nothing or under 0.1 % moves."""
    size = units.agg(F.sum("n")).first()[0] or 0
    for _ in range(rounds):
        units, moved = _move(units, shards, quota)
        if moved <= size // 1000:
            break
    return units


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 6, link: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; ``link`` is the value that linked documents share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(link if link is not None else text).alias("g"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(_cells(shards))).cast("int"))
    rows = materialize(rows, "rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    counted = rows.groupBy("g", "cell").agg(F.count("*").alias("n"))
    linked = counted.groupBy("g").agg(F.sum("n").alias("of")).where("of > 1").select("g")
    units = materialize(counted.join(linked, "g").select("g", "cell", F.pmod("cell", F.lit(shards)).cast("int").alias("label"), "n"), "units")
    units = propagate(units, shards, quota, rounds)
    placed = rows.join(units.select("g", "cell", "label"), ["g", "cell"], "left")
    placed = placed.withColumn("label", F.coalesce("label", F.lit(shards)))  # the last label stands for all unlinked documents
    # Units stay together within a bucket; unlinked documents have a unit each.
    placed = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("g", "cell", F.lit(7)), F.lit(BUCKETS)).cast("int")), "labelled")
    base = bucket_offsets(placed, ["label"], "bucket", F.lit(1))
    within = Window.partitionBy("label", "bucket").orderBy("g", "cell", "doc_id", "size", "text_crc32")
    placed = placed.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(base), ["label", "bucket"]).withColumn("at", F.col("at") + F.col("base"))  # (shards + 1) * BUCKETS rows
    held = {r["label"]: r["n"] for r in units.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return _deal(placed, shards, quota, held).select("doc_id", "size", "text_crc32", "shard", "slot")


def _deal(placed: DataFrame, shards: int, quota: list[int], held: dict[int, int]) -> DataFrame:
    """Shard and slot from a row's place under its label: own rows up to the quota, all others into the room left."""
    whole = lambda values: F.array(*[F.lit(int(v)) for v in values])
    over, own, room = [0], [], [0]
    for s in range(shards):
        have = held.get(s, 0)
        own.append(min(have, quota[s]))
        over.append(over[-1] + max(0, have - quota[s]))
        room.append(room[-1] + quota[s] - own[-1])
    limit = F.coalesce(F.get(whole(quota), F.col("label")), F.lit(0)).cast("long")
    pool = F.get(whole(over), F.col("label")).cast("long") + F.col("at") - limit  # place among rows that need other room
    filled = placed.withColumn("pool", F.when(F.col("at") >= limit, pool))
    shard = F.when(F.col("pool").isNull(), F.col("label")).otherwise(sum((F.col("pool") >= F.lit(int(r))).cast("int") for r in room[1:]))
    filled = filled.withColumn("shard", shard.cast("int"))
    slot = F.when(F.col("pool").isNull(), F.col("at")).otherwise(F.get(whole(own), F.col("shard")) + F.col("pool") - F.get(whole(room), F.col("shard")))
    return filled.withColumn("slot", slot.cast("long"))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
