"""Filters, joins, aggregates, windows and pages over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.operators.ranking import first_per, page, ranked, top_with_total
from terrace.plans.base import query
from terrace.sources.tables import table

OFFERED = "o_orderstatus <> 'P' AND o_totalprice > 1000 AND o_orderkey % 13 <> 0"


@query(
    f"""WITH o AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE {OFFERED} AND NOT (c_nationkey % 5 = 1 AND o_orderkey % 17 = 0) GROUP BY ALL)
    SELECT n_nationkey::BIGINT AS region_id, n_name AS region_name, c_mktsegment AS category, coalesce(n, 0) AS objects,
        EXISTS (FROM supplier WHERE s_nationkey = n_nationkey) AS has_subregions FROM nation LEFT JOIN o ON c_nationkey = n_nationkey"""
)
def a1_region_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered objects by region and category; all regions stay.

    An order has one customer, so no order is met twice: orders are counted by customer, whole and without those that some
    regions reject, and the counts are summed.
    """
    rejected = F.col("o_orderkey") % 17 == 0
    orders = table(spark, sf_dir, "orders").filter(OFFERED).groupBy("o_custkey").agg(F.count("*").alias("every"), F.count_if(~rejected).alias("some"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = F.when(F.col("c_nationkey") % 5 == 1, F.col("some")).otherwise(F.col("every"))
    counts = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_nationkey", "c_mktsegment").agg(F.sum(n).alias("n")).filter("n > 0")
    nation = table(spark, sf_dir, "nation")
    below = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("sub", F.lit(True))
    rows = nation.join(below, "n_nationkey", "left").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(
        F.col("n_nationkey").cast("long").alias("region_id"), F.col("n_name").alias("region_name"), F.col("c_mktsegment").alias("category"),
        F.coalesce("n", F.lit(0).cast("long")).alias("objects"), F.coalesce("sub", F.lit(False)).alias("has_subregions"),
    ).orderBy("region_name", "category")


@query("SELECT l_suppkey AS supplier, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 3")
def a2_counts_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("lines")).filter("lines > 3").orderBy(F.desc("lines"), "supplier")


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (value > 50) AS large_users
    FROM events GROUP BY event_type"""
)
def a3_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(large).alias("large"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(large, F.col("user_id"))).alias("large_users"))


@query(
    """WITH m AS (SELECT *, max(ts) OVER () AS now FROM events)
    SELECT event_type AS feature, count(*) AS calls, coalesce(sum((value * 100)::BIGINT) FILTER (ts >= date_trunc('day', now)), 0)::BIGINT AS today,
        coalesce(sum((value * 100)::BIGINT) FILTER (ts >= date_trunc('month', now)), 0)::BIGINT AS this_month, sum((value * 100)::BIGINT)::BIGINT AS all_time, max(ts) AS latest
    FROM m GROUP BY event_type"""
)
def a4_a5_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in hundredths by feature; now is the latest event."""
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    since = lambda unit: F.coalesce(F.sum(F.when(F.col("ts") >= F.date_trunc(unit, F.col("now")), cents)), F.lit(0).cast("long"))
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return rows.groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("calls"), since("day").alias("today"), since("month").alias("this_month"), F.sum(cents).alias("all_time"), F.max("ts").alias("latest"))


@query("SELECT c_nationkey::BIGINT AS nation, array_to_string(list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 0)), ',') AS segments FROM customer GROUP BY ALL")
def a6_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))), ",").alias("segments"))


@query(
    """WITH r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
    SELECT p_brand AS brand, string_agg(p_name, '; ' ORDER BY rn) AS labels FROM r WHERE rn <= 3 GROUP BY p_brand"""
)
def a7_first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each brand; a window limits before rows are collected."""
    top = ranked(first_per(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    return top.groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "p_name"))), lambda s: s["p_name"]), "; ").alias("labels"))


@query("SELECT l_orderkey AS order_id, bool_or(l_returnflag = 'R') AS any_returned, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def a10_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.max("l_quantity").alias("most"))


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def a11_correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(counts, "id", "left").fillna(0, ["orders"])


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY ALL")
def a15_outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority").startswith("1")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(urgent).alias("urgent"), F.count_if(~urgent).alias("other"))


@query(
    """SELECT o_custkey AS customer, o_orderkey AS order_id, rn, total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE rn <= 3"""
)
def w1_top_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), "o_totalprice")
    return top_with_total(orders, ["customer"], [F.desc("o_totalprice"), F.asc("order_id")], 3).drop("o_totalprice")


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O')
    SELECT a.o_orderkey AS withdrawn, b.o_orderkey AS arrived FROM a JOIN b ON a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.rn = b.rn"""
)
def w4_nth_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th of one kind with the n-th of the other, by a key that may be null."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    left, right = (ranked(orders.filter(F.col("o_orderstatus") == s), ["o_custkey"], [F.asc("o_orderkey")]).alias(n) for s, n in (("F", "a"), ("O", "b")))
    return left.join(right, F.col("a.o_custkey").eqNullSafe(F.col("b.o_custkey")) & (F.col("a.rn") == F.col("b.rn"))).select(F.col("a.o_orderkey").alias("withdrawn"), F.col("b.o_orderkey").alias("arrived"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id")
def w8_first_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", (-F.col("event_id")).alias("e"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), order).alias("r")).select("user_id", "r.event_id", "r.event_type")


@query("SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM part) > 45 AS has_more FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 20")
def k1_k7_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return page(parts, [F.asc("name"), F.asc("id")], 25, 20)


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC NULLS LAST, c_custkey LIMIT 40")
def k2_k3_ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(40)
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j4_j5_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return customers.join(orders.filter("o_orderstatus = 'F'"), "id", "left_semi").join(orders.filter("o_orderstatus = 'P'"), "id", "left_anti")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'k')::BIGINT > 50, false) AS above FROM events")
def n1_j14_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("above"))


@query(
    """WITH v AS (SELECT o_custkey AS user_id, l_suppkey AS object_id, count(*) AS places, count(*) FILTER (l_returnflag = 'R') AS seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT user_id, object_id, CASE WHEN seen = 0 THEN 'not_visited' WHEN seen < places THEN 'partial' ELSE 'visited' END AS status FROM v"""
)
def c15_x15_visit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("object_id"))
    counts = rows.agg(F.count("*").alias("places"), F.count_if(F.col("l_returnflag") == "R").alias("seen"))
    status = F.when(F.col("seen") == 0, "not_visited").when(F.col("seen") < F.col("places"), "partial").otherwise("visited")
    return counts.select("user_id", "object_id", status.alias("status"))


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER () AS now FROM events) WHERE ts > now - INTERVAL 7 DAY")
def d1_new_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return rows.filter(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).select("event_id", "user_id")


@query("SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_partkey) AS rn FROM part")
def w2_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(F.desc_nulls_last("p_size"), "p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.row_number().over(order).cast("long").alias("rn"))
