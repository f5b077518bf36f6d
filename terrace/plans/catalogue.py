"""Entities: components, tiers, and lists in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.geo import entity_id, parsed_point
from terrace.operators import graph
from terrace.plans.base import query
from terrace.sources.tables import table

@query()
def g13_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all order lines; without SQL, a test compares with brute force."""
    return _tied(table(spark, sf_dir, "lineitem"))


def _tied(lines: DataFrame) -> DataFrame:
    return graph.components(None, lines.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b")))


@query(
    """WITH w AS (SELECT l_partkey AS work, count(*) AS links, count(DISTINCT l_suppkey) AS holders FROM lineitem GROUP BY ALL)
    SELECT work, CASE WHEN holders > 2 AND work % 10 <> 0 THEN 'shared' ELSE 'placed' END AS tier FROM w WHERE links >= 22"""
)
def g8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("links"), F.countDistinct("l_suppkey").alias("holders"))
    return works.filter("links >= 22").select("work", F.when((F.col("holders") > 2) & (F.col("work") % 10 != 0), "shared").otherwise("placed").alias("tier"))


@query("SELECT n_nationkey::BIGINT AS id, 'Q' || n_nationkey AS entity, CASE WHEN n_nationkey % 4 <> 3 THEN (n_nationkey * 14 - 180)::DOUBLE END AS lon, CASE WHEN n_nationkey % 4 <> 3 THEN (n_nationkey * 7 % 120)::DOUBLE END AS lat FROM nation")
def io6_parsed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities out of addresses, and points out of texts; null where a text is none."""
    key = F.col("n_nationkey")
    wkt = F.when(key % 4 != 3, F.format_string("Point(%d %d)", key * 14 - 180, key * 7 % 120)).otherwise("Polygon((0 0))")
    rows = table(spark, sf_dir, "nation").select(key.cast("long").alias("id"), F.concat(F.lit("http://example.org/entity/Q"), key.cast("string")).alias("uri"), wkt.alias("wkt"))
    return rows.select("id", entity_id(F.col("uri")).alias("entity"), parsed_point(F.col("wkt")).alias("p")).select("id", "entity", "p.lon", "p.lat")
