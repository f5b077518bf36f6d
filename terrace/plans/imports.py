"""Imports of files that sources land."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.steps import shared_folder
from terrace.plans.base import query
from terrace.sources.files import json_records, tree_of_names
from terrace.sources.tables import table


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::BIGINT END AS region FROM nation")
def io4_io8_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations landed as an array of JSON objects, and some of their fields read back."""
    key = F.col("n_nationkey")
    record = F.struct(key.alias("id"), F.col("n_name").alias("name"), F.when(key % 3 != 0, F.col("n_regionkey")).alias("region"), F.lit("x").alias("unread"))
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(record)).alias("value")).coalesce(1).write.text(folder)
    return json_records(spark, folder, "id long, name string, region long, unread string", ["id", "name", "region"])


@query(
    """WITH n AS (SELECT r_name, CASE WHEN n_nationkey % 4 = 3 THEN 'twin' ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT r_name AS path, '' AS parent_path, 1 AS depth, true AS has_children FROM n GROUP BY r_name UNION ALL SELECT r_name || '/' || name, r_name, 2, false FROM n GROUP BY r_name, name"""
)
def io9_tree_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as nested JSON, a text for each region; siblings of one name are one node."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    name = F.when(F.col("n_nationkey") % 4 == 3, "twin").otherwise(F.col("n_name"))
    nested = table(spark, sf_dir, "nation").join(region, "n_regionkey").groupBy("r_name").agg(F.collect_list(F.struct(name.alias("name"))).alias("children"))
    rows = tree_of_names(nested.select(F.to_json(F.struct(F.col("r_name").alias("name"), "children")).alias("value")))
    return rows.select(F.array_join("path", "/").alias("path"), F.array_join("parent_path", "/").alias("parent_path"), "depth", "has_children")
