"""Snapshots against stored rows; here orders and a copy that is perturbed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import changes as c
from terrace.plans.base import query
from terrace.sources.tables import table

NEW = """new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 19 <> 0)"""
OLD = """old AS (SELECT o_orderkey AS id, o_orderpriority AS name, CASE WHEN o_orderkey % 33 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderkey % 14 = 0 AS claimed FROM orders WHERE o_orderkey % 23 <> 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.filter(key % 23 != 0).select(key.alias("id"), F.col("o_orderpriority").alias("name"), F.when(key % 33 != 0, F.col("o_orderstatus")).alias("status"), F.when(key % 14 == 0, F.array(F.lit("name"))).otherwise(F.array()).alias("claimed"))
    name = F.when(key % 7 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    new = orders.filter(key % 19 != 0).select(key.alias("id"), name.alias("name"), F.when(key % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"))
    return old, new


@query(
    f"""WITH {NEW}, {OLD}, d AS (SELECT new.id, old.id IS NULL AS fresh, coalesce(old.name, '') <> coalesce(new.name, '') AS n, coalesce(old.status, '') <> coalesce(new.status, '') AS s FROM new LEFT JOIN old ON old.id = new.id)
    SELECT id, CASE WHEN fresh THEN 'created' WHEN n OR s THEN 'updated' ELSE 'unchanged' END AS change, CASE WHEN fresh OR n THEN 2 WHEN s THEN 1 ELSE 0 END AS significance,
        CASE WHEN fresh THEN '' WHEN n AND s THEN 'name,status' WHEN n THEN 'name' WHEN s THEN 'status' ELSE '' END AS fields FROM d"""
)
def c1_c2_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    field = lambda f, s: c.text_change(F.col(f"old.{f}"), F.col(f"new.{f}"), s)
    return c.change_set(old, new, "id", {"name": field("name", c.MAJOR), "status": field("status", c.MINOR)})


@query(
    f"""WITH {NEW}, {OLD} SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL OR coalesce(claimed, false) THEN old.name ELSE new.name END AS name,
    CASE WHEN new.id IS NULL THEN old.status ELSE new.status END AS status FROM old FULL JOIN new ON old.id = new.id"""
)
def c3_claimed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.merged(*_sides(spark, sf_dir), "id", ["name", "status"])


@query(
    f"""WITH {NEW}, {OLD}, k AS (SELECT old.id, new.id IS NOT NULL AS seen FROM old LEFT JOIN new ON new.id = old.id)
    SELECT id FROM k WHERE NOT seen AND (SELECT count(*) FILTER (seen) / count(*) FROM k) >= 0.9"""
)
def c8_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows that a whole, faultless run over an authoritative source didn't see."""
    return c.missing(*_sides(spark, sf_dir), "id")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN value >= 18 ELSE value >= 22 END AS flag FROM events")
def c12_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), c.hysteresis(F.col("event_id") % 2 == 0, F.col("value"), 22, 18).alias("flag"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def io14_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each key."""
    return c.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")
