"""Tables of a folder of Parquet files, and the trees, points and boxes derived from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Offsets that keep the ids of a tree's levels apart.
REGIONS, NATIONS = 1_000_000_000, 100_000_000
#: A number of its own for each order line, a thousand millions of its order's.
LINE_ID = "(l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under nations under regions: id, parent_id, name."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + F.lit(REGIONS)).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + F.lit(NATIONS)).cast("long").alias("id"), (F.col("n_regionkey") + F.lit(REGIONS)).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + F.lit(NATIONS)).cast("long").alias("parent_id"), F.col("c_name").alias("name"))
    return region.unionByName(nation).unionByName(customer)


def deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a ternary tree of their keys: id, parent_id, name; about log3 of them deep."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key > 3, F.floor(key / 3).cast("long")).alias("parent_id"), F.col("c_name").alias("name"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each part: id, brand, lon, lat in degrees."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_brand").alias("brand"), (key * 37 % 3600 / 10 - 180).alias("lon"), (key * 91 % 1700 / 10 - 85).alias("lat"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each nation: id, name, west, south, east, north."""
    key = F.col("n_nationkey").cast("long")
    west, south = key * 14 - 180, key * 7 % 120 - 60
    return table(spark, sf_dir, "nation").select(key.alias("id"), F.col("n_name").alias("name"), west.alias("west"), south.alias("south"), (west + 20).alias("east"), (south + 25).alias("north"))


#: Offsets of the rings of a nation's parts, from its south-west corner: (part, ring, whose nations: modulus, points).
SHAPES = (
    (0, 0, 1, ((0, 0), (20, 0), (20, 10), (8, 12), (10, 25), (0, 20), (0, 0))),
    (0, 1, 2, ((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))),
    (1, 0, 5, ((14, 14), (18, 14), (18, 18), (14, 18), (14, 14))),
)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue objects: id, name, category, kind, size, price, lon, lat."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_brand AS category", "p_type AS kind", "p_size AS size", "p_retailprice AS price",
        "p_partkey * 37 % 3600 / 10 - 180 AS lon", "p_partkey * 91 % 1700 / 10 - 85 AS lat",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as places of objects: id, object_id, lon, lat, offered, flag."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{LINE_ID} AS id", "l_partkey AS object_id", "(l_orderkey * 53 + l_linenumber * 7) % 3600 / 10 - 180 AS lon",
        "(l_orderkey * 29 + l_suppkey * 11) % 1700 / 10 - 85 AS lat", "l_returnflag <> 'R' AS offered", "l_returnflag AS flag",
    )


def parts_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons: region_id (of the tree of divisions), part, rings (the shell first)."""
    key = F.col("n_nationkey").cast("long")
    west, south = (key * 14 - 180).cast("double"), (key * 7 % 120 - 60).cast("double")
    ring = lambda points: F.array(*[F.struct((west + float(x)).alias("lon"), (south + float(y)).alias("lat")) for x, y in points])
    shell = F.struct(F.lit(0).alias("part"), F.when(key % 2 == 0, F.array(ring(SHAPES[0][3]), ring(SHAPES[1][3]))).otherwise(F.array(ring(SHAPES[0][3]))).alias("rings"))
    island = F.struct(F.lit(1).alias("part"), F.array(ring(SHAPES[2][3])).alias("rings"))
    both = F.when(key % 5 == 0, F.array(shell, island)).otherwise(F.array(shell))
    return table(spark, sf_dir, "nation").select((key + NATIONS).alias("region_id"), F.inline(both))
