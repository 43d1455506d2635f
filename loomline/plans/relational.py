"""Scans, filters, joins, aggregates, set operations and table maintenance over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import tables
from loomline.registry import Tables, query


@query("a1_keyed_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def keyed_scan(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_linenumber")


@query("a2_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


_NEW_CUSTOMERS = "SELECT c_custkey + 700 AS c_custkey, c_nationkey, round(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_custkey % 5 = 0"


def _customers(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    new = t.customer.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 700).alias("c_custkey"), "c_nationkey", F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return old, new


@query("a11_upsert", f"""WITH n AS ({_NEW_CUSTOMERS}) SELECT * FROM n UNION ALL
SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def upsert(t: Tables) -> DataFrame:
    return tables.upsert(*_customers(t), ["c_custkey"])


@query("a12_insert_ignore", f"""WITH n AS ({_NEW_CUSTOMERS}) SELECT c_custkey, c_nationkey, c_acctbal FROM customer UNION ALL
SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def insert_ignore(t: Tables) -> DataFrame:
    return tables.insert_ignore(*_customers(t), ["c_custkey"])


@query("a13_insert_replace", """SELECT user_id, event_id, event_type, value FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def insert_replace(t: Tables) -> DataFrame:
    return tables.keep_latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("a14_protected_upsert", f"""WITH n AS ({_NEW_CUSTOMERS}), o AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer)
SELECT o.* FROM o LEFT JOIN n USING (c_custkey) WHERE n.c_custkey IS NULL OR o.c_acctbal < 0
UNION ALL SELECT n.* FROM n LEFT JOIN o USING (c_custkey) WHERE o.c_custkey IS NULL OR NOT o.c_acctbal < 0""")
def protected_upsert(t: Tables) -> DataFrame:
    return tables.upsert(*_customers(t), ["c_custkey"], protect=F.col("c_acctbal") < 0)


@query("a15_replace_partition", """SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)
UNION ALL SELECT p_partkey, p_brand, -p_size FROM part WHERE p_size > 48""")
def replace_partition(t: Tables) -> DataFrame:
    old = t.part.select("p_partkey", "p_brand", "p_size")
    return tables.replace_partition(old, old.where("p_size > 48").withColumn("p_size", -F.col("p_size")), "p_brand")


@query("a16_cascade_delete", """SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey NOT IN
(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    _, orders = tables.cascade_delete(t.customer, t.orders, gone, "c_custkey", "o_custkey")
    return orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("a17_retention", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY OR event_type <> 'view'")
def retention(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))
    rows = t.events.select("event_id", "ts", "event_type").crossJoin(F.broadcast(newest))  # one row
    return rows.where((F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")) | (F.col("event_type") != "view")).select("event_id", "ts")


@query("a18_eviction", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, ts, event_id) AS n,
count(*) OVER () AS c FROM events) WHERE n > c - c // 4""")
def eviction(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "event_type")
    return tables.evict(rows, rows.count() // 4, F.col("event_type") == "view", F.to_date("ts"), F.col("ts"), F.col("event_id")).select("event_id")


@query("b2_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5 AND l_linestatus <> 'O' AND l_shipdate < TIMESTAMP '1996-01-01'")
def predicates(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R' AND l_quantity <= 5 AND l_linestatus <> 'O' AND l_shipdate < TIMESTAMP '1996-01-01'").select("l_orderkey", "l_linenumber")


@query("b3_null_tests", """SELECT o_orderkey IS NULL AS no_order, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def null_tests(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(F.col("o_orderkey").isNull().alias("no_order")).agg(F.count("*").alias("n"))


@query("b4_null_safe_equality", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id % 5 END AS b FROM events)
SELECT a IS NOT DISTINCT FROM b AS same, count(*) AS n FROM e GROUP BY 1""")
def null_safe_equality(t: Tables) -> DataFrame:
    a = F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 5)
    b = F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 5)
    return t.events.groupBy(a.eqNullSafe(b).alias("same")).agg(F.count("*").alias("n"))


@query("b5_in_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5, 8)")
def in_list(t: Tables) -> DataFrame:
    return t.supplier.where(F.col("s_nationkey").isin(1, 3, 5, 8)).select("s_suppkey", "s_name")


@query("b6_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%STEEL%' AND p_name NOT LIKE 'a\\_%' ESCAPE '\\'")
def like(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").like("%STEEL%") & ~F.col("p_name").like("a\\_%")).select("p_partkey", "p_type")


@query("b7_case_when", "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS band, count(*) AS n FROM orders GROUP BY 1")
def case_when(t: Tables) -> DataFrame:
    band = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "middle").otherwise("small")
    return t.orders.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("b8_coalesce_cast_concat", "SELECT s_suppkey, concat(s_name, ':', CAST(s_nationkey AS VARCHAR)) AS tag, coalesce(nullif(s_nationkey, 3), -1) AS nation FROM supplier")
def coalesce_cast_concat(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.concat("s_name", F.lit(":"), F.col("s_nationkey").cast("string")).alias("tag"), F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("nation"))


@query("b9_scalar_max", "SELECT event_id, greatest(value, 10.0) AS floor10, least(value, 10.0) AS cap10 FROM events")
def scalar_max(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.greatest("value", F.lit(10.0)).alias("floor10"), F.least("value", F.lit(10.0)).alias("cap10"))


@query("b10_reindex_predicate", """SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR (c_nationkey = 3 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'))""")
def reindex_predicate(t: Tables) -> DataFrame:
    open_orders = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("open", F.lit(True))
    flagged = t.customer.join(open_orders, "c_custkey", "left")
    return flagged.where((F.col("c_acctbal") < 0) | ((F.col("c_nationkey") == 3) & F.coalesce("open", F.lit(False)))).select("c_custkey")


@query("c1_inner_join", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def inner_join(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("c2_five_way_join", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def five_way_join(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    rows = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.supplier.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.join(places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("amount"), 2).alias("revenue"))


@query("c3_left_join_count", "SELECT c_custkey, count(o_orderkey) AS orders, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_count(t: Tables) -> DataFrame:
    # counted before the join, so a customer with very many orders is one row in it
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("top"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "top")


@query("c4_semi_join", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_returnflag = 'R')")
def semi_join(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem.where("l_quantity >= 50 AND l_returnflag = 'R'"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("c5_semi_join_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_join_in(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("c6_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("c7_not_exists", "SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def not_exists(t: Tables) -> DataFrame:
    return tables.orphans(t.lineitem, t.orders.where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphans"))


@query("c9_full_outer_merge", """WITH a AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(a.v, 0), 6) AS clicks, round(coalesce(b.v, 0), 6) AS purchases FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_merge(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.sum("value").alias("a"))
    b = t.events.where("event_type = 'purchase' AND value > 40").groupBy("user_id").agg(F.sum("value").alias("b"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("clicks"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("purchases"))


@query("d1_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem")
def counts(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("d2_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_count(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("d3_multi_key_latest", "SELECT user_id, event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1, 2 ORDER BY latest DESC")
def multi_key_latest(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest")).orderBy(F.desc("latest"))


@query("d4_min_max", "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def min_max(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("d5_next_numbers", """WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, i, CAST(coalesce(top, 0) + i AS BIGINT) AS l_linenumber FROM orders LEFT JOIN m ON l_orderkey = o_orderkey, unnest([1, 2]) AS u(i)""")
def next_numbers(t: Tables) -> DataFrame:
    new = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    return tables.next_numbers(t.lineitem, new, "l_orderkey", "l_linenumber", "i")


@query("d6_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("f1_order_limit", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def order_limit(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("f2_total_order", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40")
def total_order(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(40)


@query("f8_enumerated_order", """SELECT o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS place, count(*) AS n FROM orders GROUP BY 1, 2""")
def enumerated_order(t: Tables) -> DataFrame:
    place = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t.orders.groupBy("o_orderpriority", place.alias("place")).agg(F.count("*").alias("n")).orderBy("place", "o_orderpriority")


@query("f_top_per_group", """SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3""")
def top_per_group(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t.customer.withColumn("n", rank).where("n <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("g2_set_operations", """SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)""")
def set_operations(t: Tables) -> DataFrame:
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    both = t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey"))
    left = t.customer.select("c_custkey").subtract(t.orders.select("o_custkey"))
    either = t.customer.select("c_custkey").union(t.supplier.select("s_suppkey")).distinct()
    return count(both, "both").unionAll(count(left, "customer")).unionAll(count(either, "either"))


_EQUAL = "(SELECT count(*) FROM (({0}) EXCEPT ALL ({1}))) + (SELECT count(*) FROM (({1}) EXCEPT ALL ({0}))) = 0"
_PLACED = "SELECT o_orderstatus, row_number() OVER (ORDER BY {0}) AS place FROM orders WHERE o_custkey < 50"


@query("g3_multiset_equality", f"""SELECT 'same' AS pair, {_EQUAL.format("SELECT l_returnflag FROM lineitem", "SELECT l_returnflag FROM lineitem ORDER BY l_quantity")} AS equal
UNION ALL SELECT 'fewer', {_EQUAL.format("SELECT l_returnflag FROM lineitem", "SELECT l_returnflag FROM lineitem WHERE l_quantity > 1")} UNION ALL SELECT 'once', {_EQUAL.format("SELECT l_returnflag FROM lineitem", "SELECT DISTINCT l_returnflag FROM lineitem")}
UNION ALL SELECT 'ordered', {_EQUAL.format(_PLACED.format("o_orderkey"), _PLACED.format("o_orderkey DESC"))} UNION ALL SELECT 'reordered', {_EQUAL.format("SELECT o_orderstatus FROM orders WHERE o_custkey < 50 ORDER BY o_orderkey", "SELECT o_orderstatus FROM orders WHERE o_custkey < 50 ORDER BY o_totalprice")}""")
def multiset_equality(t: Tables) -> DataFrame:
    """Results compared as multisets, where repeats count and order doesn't, and in order, where places count too."""
    flags, few = t.lineitem.select("l_returnflag"), t.orders.where("o_custkey < 50")
    status = few.select("o_orderstatus")
    pairs = {"same": (flags, t.lineitem.orderBy("l_quantity").select("l_returnflag")), "fewer": (flags, t.lineitem.where("l_quantity > 1").select("l_returnflag")), "once": (flags, flags.distinct()), "reordered": (status, few.orderBy("o_totalprice").select("o_orderstatus"))}
    answers = [tables.same_rows(a, b).select(F.lit(k).alias("pair"), "equal") for k, (a, b) in pairs.items()]
    answers.append(tables.same_sequence(few, few, "o_orderstatus", F.col("o_orderkey"), F.desc("o_orderkey")).select(F.lit("ordered").alias("pair"), "equal"))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out
