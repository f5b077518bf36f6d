"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Three steps combine equal texts, each with the whole text in the
grouping key: within a partition (Spark's partial aggregate), within a salted digest group, and over the salts of a
digest. Only digests that hold more than one thousandth of all rows are salted; there are fewer than a thousand of
them, which bounds what is broadcast, and other digests are whole after the second step. A text crosses the network
once; what follows has digests and ids only.

Defined cases: a null text counts as empty; of equal texts the row with the largest id stays, null ids come last and
nothing is kept where all are null; repeated rows with the id that stays are the same document and are all marked kept;
an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import ascii_lower, cut, small, text_of

HOT_SHARE = 1000
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _normalised(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text"))
    return rows.withColumn("_digest", digest(F.col("_text")))


def _salted(rows: DataFrame, hot: DataFrame, salts: int, salt: Column) -> DataFrame:
    rows = rows.join(F.broadcast(hot), "_digest", "left")
    return rows.withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt, F.lit(salts))).otherwise(0).cast("int"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, hot_share: int = HOT_SHARE, digest=sha256) -> DataFrame:
    """One row per document: _id, _digest (of the normalised text), _keep (the id that stays), _size (of its group)."""
    full = _normalised(docs, id_col, text_col, digest)
    digests = cut(full.select("_id", "_digest"))
    least = max(1, digests.count() // hot_share)
    hot = cut(digests.groupBy("_digest").count().filter(F.col("count") > least).select("_digest", F.lit(True).alias("_hot")))

    # A partition's copies of a text are one row of one salt; ids play no part, as they may be null or all the same.
    salted = _salted(full, hot, salts, F.spark_partition_id()).groupBy("_digest", "_hot", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    # A salted text goes on to be compared over all salts; any other group is whole and is told apart by its id.
    rest = salted.select(
        "_digest", "_hot", "_keep", "_size",
        F.when(F.col("_hot"), F.col("_text")).alias("_salted_text"),
        F.when(F.col("_hot"), None).otherwise(F.struct("_keep", "_size")).alias("_whole"),
    )
    winners = cut(rest.groupBy("_digest", "_hot", "_salted_text", "_whole").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")).select("_digest", "_hot", "_keep", "_size"))

    # A digest with several texts is a collision: its documents are matched by text.
    clashing = cut(winners.groupBy("_digest").count().filter("count > 1").select("_digest"))
    clash = not clashing.isEmpty()
    if clash:
        winners = winners.join(clashing, "_digest", "left_anti")
    salts_of = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    by_salt = winners.select("_digest", F.explode(salts_of).alias("_salt"), "_keep", "_size")
    out = _salted(digests, hot, salts, F.monotonically_increasing_id()).join(by_salt, ["_digest", "_salt"]).select("_id", "_digest", "_keep", "_size")
    if clash:
        again = full.join(small(clashing), "_digest", "left_semi")
        texts = again.groupBy("_digest", "_text").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
        out = out.unionByName(again.join(texts, ["_digest", "_text"]).select("_id", "_digest", "_keep", "_size"))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: the id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text)."""
    return exact_groups(docs, id_col, text_col, **options).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
