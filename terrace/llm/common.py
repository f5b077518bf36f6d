"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bytes that separate words are space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A table that is broadcast has been counted and has at most so many rows.
BROADCAST_ROWS = 100_000
#: Rows that a Python worker takes out of an Arrow batch at a time.
PIECE_ROWS = 256


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark is local one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='terrace-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; each call gives another."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at files in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialised table for broadcast if a count proves it small; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() does just that where every character is one byte, and is faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_parts(df: DataFrame, order: list[Column], part: str = "_part") -> DataFrame:
    """Range-partitions and sorts, with the partition's number as a column, and cuts lineage so that it stays."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))


def part_offsets(parts: DataFrame, value: Column, part: str = "_part", offset: str = "_offset") -> DataFrame:
    """The total of value over all parts before each part; as many rows as there are partitions."""
    total = parts.groupBy(part).agg(F.sum(value).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return total.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(offset))


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(k, PIECE_ROWS)
