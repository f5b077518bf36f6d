"""First rows, top rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark limits each partition's groups before the shuffle."""
    return ranked(df, keys, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def top_with_total(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with rn, and total, the rows that the key has."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return ranked(df, keys, order).filter(F.col("rn") <= n).join(totals, keys)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered table, with has_more: one row more than shown tells."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    seen = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return seen.withColumn("has_more", (F.count("*").over(Window.partitionBy()) > limit)).filter(F.col("_n") <= limit).drop("_n")
