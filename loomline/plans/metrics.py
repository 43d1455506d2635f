"""Usage and quality metrics over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.operators.quantiles import quantiles
from loomline.registry import Tables, query


@query("d7_status_pivot", """SELECT count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'completed') AS completed FROM
(SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('click', 'view') AND event_id % 5 >= 3 THEN 'failed' WHEN event_type IN ('click', 'view') THEN 'pending' ELSE 'completed' END AS s FROM events)""")
def status_pivot(t: Tables) -> DataFrame:
    waiting = F.col("event_type").isin("click", "view")
    status = F.when(F.col("event_type") == "error", "failed").when(waiting & (F.col("event_id") % 5 >= 3), "failed").when(waiting, "pending").otherwise("completed")
    rows = t.events.select(status.alias("s"))
    return rows.agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("pending", "failed", "completed")])


@query("d8_outbox_stats", "SELECT event_type, count(*) AS n, min(ts) AS oldest, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(min(ts))) // 1000 AS oldest_age_ms FROM events GROUP BY event_type")
def outbox_stats(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))
    stats = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))
    return stats.crossJoin(F.broadcast(newest)).select("event_type", "n", "oldest", F.floor((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))) / 1000).alias("oldest_age_ms"))


@query("d9_best_per_source", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view, coalesce(max(value) FILTER (WHERE event_type = 'error'), 0) AS error FROM events GROUP BY user_id")
def best_per_source(t: Tables) -> DataFrame:
    best = lambda s: F.max(F.when(F.col("event_type") == s, F.col("value")))
    return t.events.groupBy("user_id").agg(best("click").alias("click"), best("view").alias("view"), F.coalesce(best("error"), F.lit(0.0)).alias("error"))


@query("d10_arg_max", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS top_event, max(value) AS top_value FROM events GROUP BY user_id")
def arg_max(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("top_event"), F.max("value").alias("top_value"))


@query("d11_collect_distinct", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def collect_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("d14_mentions", "SELECT lower(event_type) AS name, count(*) AS mentions, arg_min(event_type, event_id) AS shown FROM events GROUP BY 1")
def mentions(t: Tables) -> DataFrame:
    return t.events.groupBy(F.lower("event_type").alias("name")).agg(F.count("*").alias("mentions"), F.min_by("event_type", "event_id").alias("shown"))


@query("d15_top_by_frequency", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 8")
def top_by_frequency(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(8).select("user_id", "n")


@query("d16_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    found = quantiles(t.events, ["event_type"], "value", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("d17_floor_quantiles", "SELECT event_type, s[least(len(s), CAST(floor(len(s) * 0.5) AS BIGINT) + 1)] AS p50, s[least(len(s), CAST(floor(len(s) * 0.95) AS BIGINT) + 1)] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)")
def floor_quantiles(t: Tables) -> DataFrame:
    return quantiles(t.events, ["event_type"], "value", {"p50": ("floor", 0.5), "p95": ("floor", 0.95)})


@query("d18_distribution", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_pop(o_totalprice), 4) AS spread, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def distribution(t: Tables) -> DataFrame:
    plain = t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("spread"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    middle = quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": ("linear", 0.5)})
    return plain.join(middle, "o_orderpriority").withColumn("median", F.round("median", 4))


@query("d19_rates", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE), 0), 6) AS rate FROM events GROUP BY user_id")
def rates(t: Tables) -> DataFrame:
    count = lambda s: F.count_if(F.col("event_type") == s)
    return t.events.groupBy("user_id").agg(count("purchase").alias("a"), count("signup").alias("b")).select("user_id", F.round(scores.rate(F.col("a"), F.col("b")), 6).alias("rate"))


@query("d20_balanced_score", """WITH s AS (SELECT o_orderpriority AS model, quantile_cont(o_totalprice, 0.5) AS latency, avg(CASE o_orderstatus WHEN 'F' THEN 5.0 WHEN 'O' THEN 3.0 ELSE 1.0 END) AS quality, avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS success FROM orders GROUP BY 1)
SELECT model, round(0.45 * CASE WHEN max(latency) OVER () = min(latency) OVER () THEN 1 ELSE 1 - (latency - min(latency) OVER ()) / (max(latency) OVER () - min(latency) OVER ()) END + 0.45 * quality / 5 + 0.1 * success, 6) AS score FROM s""")
def balanced_score(t: Tables) -> DataFrame:
    quality = F.when(F.col("o_orderstatus") == "F", 5.0).when(F.col("o_orderstatus") == "O", 3.0).otherwise(1.0)
    models = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(quality).alias("quality"), F.avg((F.col("o_orderstatus") != "P").cast("double")).alias("success"))
    models = models.join(quantiles(t.orders.withColumnRenamed("o_orderpriority", "model"), ["model"], "o_totalprice", {"latency": ("linear", 0.5)}), "model")
    span = models.agg(F.min("latency").alias("lo"), F.max("latency").alias("hi"))
    latency = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(1 - (F.col("latency") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return models.crossJoin(F.broadcast(span)).select("model", F.round(0.45 * latency + 0.45 * F.col("quality") / 5 + 0.1 * F.col("success"), 6).alias("score"))


@query("d21_turn_counters", "SELECT user_id % 10 AS engine, count(*) AS turns, count(*) FILTER (WHERE event_type = 'error') AS stale, count(*) FILTER (WHERE value > 90) AS out_of_scope, count(*) FILTER (WHERE event_type = 'error' AND value > 90) AS contaminated FROM events GROUP BY 1")
def turn_counters(t: Tables) -> DataFrame:
    error, high = F.col("event_type") == "error", F.col("value") > 90
    return t.events.groupBy((F.col("user_id") % 10).alias("engine")).agg(F.count("*").alias("turns"), F.count_if(error).alias("stale"), F.count_if(high).alias("out_of_scope"), F.count_if(error & high).alias("contaminated"))


@query("d22_abort_conditions", """SELECT engine, turns < 50 AS insufficient, turns >= 50 AND bad > 0 AS contamination, turns >= 50 AND p95 > 1.2 * 40 AS slow, turns >= 50 AND refused > 0.25 AND fell_back < 0.05 AS over_refusal FROM
(SELECT user_id % 10 AS engine, count(*) AS turns, count(*) FILTER (WHERE event_type = 'error' AND value > 90) AS bad, quantile_disc(value, 0.95) AS p95, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS refused, avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END) AS fell_back FROM events GROUP BY 1)""")
def abort_conditions(t: Tables) -> DataFrame:
    share = lambda s: F.avg((F.col("event_type") == s).cast("double"))
    m = t.events.groupBy((F.col("user_id") % 10).alias("engine")).agg(F.count("*").alias("turns"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 90)).alias("bad"), share("error").alias("refused"), share("signup").alias("fell_back"))
    m = m.join(quantiles(t.events.withColumn("engine", F.col("user_id") % 10), ["engine"], "value", {"p95": ("least", 0.95)}), "engine", "left")
    enough = F.col("turns") >= 50
    return m.select("engine", (~enough).alias("insufficient"), (enough & (F.col("bad") > 0)).alias("contamination"), (enough & (F.col("p95") > 1.2 * 40)).alias("slow"), (enough & (F.col("refused") > 0.25) & (F.col("fell_back") < 0.05)).alias("over_refusal"))


@query("d23_parity", """WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 100), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS r FROM part QUALIFY row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) <= 100)
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both_sides, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.r <> b.r) AS rank_differences FROM a FULL JOIN b ON a.k = b.k""")
def parity(t: Tables) -> DataFrame:
    from loomline.operators.retrieval import rank_each

    a = rank_each(t.part, 100, F.desc("p_retailprice"), F.col("p_partkey")).select(F.col("p_partkey").alias("k"), F.col("rank").alias("ra"))
    b = rank_each(t.part, 100, F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")).select(F.col("p_partkey").alias("k"), F.col("rank").alias("rb"))
    both = a.join(b, "k", "full_outer")
    return both.agg(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("both_sides"), F.count_if(F.col("rb").isNull()).alias("only_left"), F.count_if(F.col("ra").isNull()).alias("only_right"), F.count_if(F.coalesce(F.col("ra") != F.col("rb"), F.lit(False))).alias("rank_differences"))


@query("d24_head_rates", "SELECT event_type, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM events GROUP BY 1")
def head_rates(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("hit_rate"), F.count("*").alias("n"))


@query("d26_pass_rates", "SELECT user_id % 7 AS surface, event_type AS mode, round(avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, array_to_string(list_slice(list_sort(list(event_id) FILTER (WHERE value >= 60)), 1, 6), ',') AS examples FROM events GROUP BY 1, 2")
def pass_rates(t: Tables) -> DataFrame:
    """Pass rate per surface and mode with the six first failures; only six candidates per group are gathered."""
    keys = [(F.col("user_id") % 7).alias("surface"), F.col("event_type").alias("mode")]
    rate = t.events.groupBy(*keys).agg(F.round(F.avg((F.col("value") < 60).cast("double")), 6).alias("pass_rate"))
    failed = t.events.where("value >= 60").select(*keys, "event_id").withColumn("n", F.row_number().over(Window.partitionBy("surface", "mode").orderBy("event_id"))).where("n <= 6")
    few = failed.groupBy("surface", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return rate.join(few, ["surface", "mode"], "left")
