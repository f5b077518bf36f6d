"""Cutting the lineage of iterative jobs, and proving tables small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
#: Rows of a task that sorts or groups them in memory.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and Spark is local, one of our own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='terrace-')}"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder."""
    shared_folder(df.sparkSession)
    # New names for the columns: what Spark knows of the old ones can't be carried into a union.
    kept = df.checkpoint(eager=True)
    return kept.select(*[F.col(f"`{c}`").alias(c) for c in kept.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows over several tasks for each core: a small file is read by one task, whatever is computed of its rows.

    By keys that few rows share, if there are any; else in turn, for which Spark sorts the rows.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def by_key(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, dealt by keys: TASK_ROWS to a task whatever its size, as Spark's own partitions are joined to fewer."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1), *keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if a count proves it small; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
