"""Streaming, stateful and queue queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import transcripts
from loomline.registry import Tables, query
from loomline.streaming import folds, live
from loomline.streaming.stateful import fold_batch, fold_stream


_ANY = "1000 days"  # the tables' files come in any order of time, and no row of them is too late


@query("l1_live_index")
def live_index(t: Tables) -> DataFrame:
    folder = live.shared_folder(t.spark)
    live.index_live(live.read_stream(t.spark, f"{t.folder}/conversations.parquet"), folder)
    return live.live_chunks(t.spark, folder)


@query("l2_session_ownership", "SELECT event_id, user_id FROM (SELECT *, max(event_id) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS owner FROM events) WHERE event_type <> 'signup' AND (owner IS NULL OR event_id > owner)")
def session_ownership(t: Tables) -> DataFrame:
    """Rows of an ended session (before the user's newest signup) are discarded."""
    owner = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("owner"))
    return t.events.where("event_type <> 'signup'").join(owner, "user_id", "left").where("owner IS NULL OR event_id > owner").select("event_id", "user_id")


@query("l4_lookback", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")
def lookback(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-7200, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 6).alias("total"))


@query("l8_stale_attempts", "SELECT event_id FROM (SELECT event_id, (event_id * 7) % 1000 AS attempt, max((event_id * 7) % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR attempt >= best")
def stale_attempts(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    attempt = (F.col("event_id") * 7) % 1000
    return t.events.select("event_id", attempt.alias("attempt"), F.max(attempt).over(w).alias("best")).where("best IS NULL OR attempt >= best").select("event_id")


@query("l10_rolling_match", "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '>') AS path FROM events")
def rolling_match(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.array_join(F.collect_list("event_type").over(w), ">").alias("path"))


@query("l11_decayed_memory", """SELECT user_id, event_type, arg_max(event_id, (s, event_id)) AS event_id, round(max(s), 6) AS salience FROM (SELECT *, round(CASE WHEN event_id % 50 = 0 THEN 1.0 ELSE pow(0.5, (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / CASE event_type WHEN 'view' THEN 86400.0 ELSE 604800.0 END) END, 9) AS s FROM events) GROUP BY 1, 2""")
def decayed_memory(t: Tables) -> DataFrame:
    """The most salient item per user and kind: pinned items stay at 1, others halve with their kind's half-life."""
    newest = t.events.agg(F.max("ts").cast("timestamp").cast("double").alias("now"))
    half = F.when(F.col("event_type") == "view", 86400.0).otherwise(604800.0)
    s = F.round(F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(F.pow(F.lit(0.5), (F.col("now") - F.col("ts").cast("timestamp").cast("double")) / half)), 9)
    rows = t.events.crossJoin(F.broadcast(newest)).withColumn("s", s)
    return rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("s", "event_id")).alias("event_id"), F.round(F.max("s"), 6).alias("salience"))


@query("l18_queue_next", "SELECT event_id, user_id, 2 * (1 << (event_id % 3)) AS wait_s FROM events WHERE event_type = 'error' AND event_id % 5 < 3 ORDER BY ts, event_id LIMIT 20")
def queue_next(t: Tables) -> DataFrame:
    due = t.events.where("event_type = 'error' AND event_id % 5 < 3")
    return due.orderBy("ts", "event_id").limit(20).select("event_id", "user_id", (2 * F.pow(F.lit(2), F.col("event_id") % 3)).cast("int").alias("wait_s"))


@query("l19_lease_claim", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01')) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY o_orderdate, o_orderkey LIMIT 1")
def lease_claim(t: Tables) -> DataFrame:
    due = t.orders.where("o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01')")
    live_rows = due.join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return live_rows.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("l20_outbox_claim", "SELECT event_id, least(3600, 30 * (1 << least(7, event_id % 9))) AS backoff_s FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 100")
def outbox_claim(t: Tables) -> DataFrame:
    wait = F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(F.lit(7), F.col("event_id") % 9))).cast("int")
    return t.events.where("event_type = 'purchase'").orderBy("ts", "event_id").limit(100).select("event_id", wait.alias("backoff_s"))


_MOVES = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("click", "view")]


@query("l22_transitions", f"""WITH m AS (SELECT event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, now, count(*) AS n, (before, now) IN ({', '.join(f"('{a}', '{b}')" for a, b in _MOVES)}) AS legal FROM m WHERE before IS NOT NULL GROUP BY 1, 2, 4""")
def transitions(t: Tables) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = t.events.select(before.alias("before"), F.col("event_type").alias("now")).where("before IS NOT NULL").groupBy("before", "now").agg(F.count("*").alias("n"))
    legal = F.broadcast(t.spark.createDataFrame(_MOVES, "before string, now string").withColumn("legal", F.lit(True)))  # a constant
    return moves.join(legal, ["before", "now"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


@query("l23_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(t: Tables) -> DataFrame:
    folder = live.shared_folder(t.spark)
    live.windowed_counts(live.read_stream(t.spark, f"{t.folder}/events.parquet"), folder, late=_ANY)
    return live.newest_counts(t.spark, folder).withColumn("total", F.round("total", 4))


@query("l23_sliding", """SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS start FROM events, range(4) AS r(i)) GROUP BY 1, 2""")
def sliding_windows(t: Tables) -> DataFrame:
    """Windows of a day, a new one every six hours."""
    folder = live.shared_folder(t.spark)
    live.windowed_counts(live.read_stream(t.spark, f"{t.folder}/events.parquet"), folder, late=_ANY, slide="6 hours")
    return live.newest_counts(t.spark, folder).withColumn("total", F.round("total", 4))


@query("l23_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def _frames(t: Tables) -> DataFrame:
    """Events as audio frames: level from the value, 20 ms apart in a user's order."""
    at = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 20
    return t.events.where("value IS NOT NULL").select("user_id", at.cast("long").alias("at_ms"), (F.col("value") * 4).alias("level"), F.col("event_type").alias("what"))


@query("l5_near_repeats")
def near_repeats(t: Tables) -> DataFrame:
    return fold_batch(_frames(t).select("user_id", "at_ms", "what"), "user_id", "at_ms", folds.drop_near_repeats(), "kept string")


@query("l13_voice_activity")
def voice_activity(t: Tables) -> DataFrame:
    return fold_batch(_frames(t).select("user_id", "at_ms", "level"), "user_id", "at_ms", folds.voice_activity(), "state string")


@query("l14_silence_suppression")
def silence_suppression(t: Tables) -> DataFrame:
    return fold_batch(_frames(t).select("user_id", "at_ms", "level"), "user_id", "at_ms", folds.suppress_silence(), "action string, edge string")


@query("l15_joint_state")
def joint_state(t: Tables) -> DataFrame:
    rows = _frames(t).select("user_id", "at_ms", F.when(F.col("what").isin("click", "view"), "a").otherwise("b").alias("channel"), (F.col("level") > 60).alias("speaking"))
    return fold_batch(rows, "user_id", "at_ms", folds.joint_state(), "joint string, since_other long")


@query("l15_joint_state_stream")
def joint_state_stream(t: Tables) -> DataFrame:
    """The same fold over a stream of events, its state kept by Spark."""
    folder = live.shared_folder(t.spark)
    events = live.read_stream(t.spark, f"{t.folder}/events.parquet").where("value IS NOT NULL")
    rows = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("channel"), (F.col("value") > 15).alias("speaking"))
    live.append_stream(fold_stream(rows, "user_id", "event_id", folds.joint_state(), "joint string, since_other long"), folder)
    return t.spark.read.parquet(f"{folder}/rows")


def _spoken(t: Tables) -> DataFrame:
    return transcripts.segments(t.conversations).select("conv_id", "seq", "text", (F.col("seq") % 3 == 2).alias("final"), F.col("text").rlike(r"(?i)^(the|a|is|it|to)").alias("ask"))


@query("l9_compacted_log")
def compacted_log(t: Tables) -> DataFrame:
    return fold_batch(_spoken(t).select("conv_id", "seq"), "conv_id", "seq", folds.compact_log(6, 3), "held int, markers int")


@query("l12_ask_ledger")
def ask_ledger(t: Tables) -> DataFrame:
    return fold_batch(_spoken(t), "conv_id", "seq", folds.ask_ledger(), "open int, answered int")


@query("l24_merged_transcript")
def merged_transcript(t: Tables) -> DataFrame:
    return fold_batch(_spoken(t).select("conv_id", "seq", "text"), "conv_id", "seq", folds.merged_transcript(), "words int")


@query("l25_rolling_text")
def rolling_text(t: Tables) -> DataFrame:
    return fold_batch(_spoken(t), "conv_id", "seq", folds.rolling_text(2000), "chars int, segments int")
