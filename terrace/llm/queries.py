"""The queries opN_<name> over the documents and pages tables, with the parameters of their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import crc32_mod
from terrace.llm.decontamination import contaminated
from terrace.llm.exact_dedup import exact_dedup
from terrace.llm.jaccard_join import jaccard_components
from terrace.llm.language import language_id
from terrace.llm.license_scan import license_scan
from terrace.llm.mixing import mix_plan
from terrace.llm.periodic_runs import run_report, with_planted_runs
from terrace.llm.pii import pseudonymised
from terrace.llm.quality import quality_scores
from terrace.llm.spelling import spelling_variants, word_counts
from terrace.llm.token_binary import token_binary
from terrace.llm.token_counts import token_counts
from terrace.llm.warc import archived_pages

#: Ends each document of op8.
END_ID = 2
#: op11 leaves out a code point of a run whose hash this divides.
DELETING = 199
#: Where Spark's configuration holds op9's key, and the key where it holds none.
PSEUDONYM_CONF, PSEUDONYM_KEY = "spark.terrace.pseudonym.key", "terrace"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, repeating; 100% of all words, at most 3 times a source."""
    return mix_plan(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group of equal texts."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a third of the documents is held out of learning."""
    return language_id(_table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 3) == 1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, verbatim or with other numbers, names or units, with the items."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its component of near copies."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; a quarter of the documents is held out of learning."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 4) == 2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from Zstandard archives of all pages."""
    return archived_pages(_table(spark, sf_dir, "pages"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token shards of all documents."""
    return token_binary(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for personal values, and their numbers by kind. A deployment sets its own key in Spark's configuration."""
    return pseudonymised(_table(spark, sf_dir, "documents"), spark.conf.get(PSEUDONYM_CONF, PSEUDONYM_KEY))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens by a BPE file's pieces read as a unigram vocabulary: not the BPE file's counts."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent near word, the root its forms lead to, and its number of near words."""
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, deleting=DELETING), ratio=5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, of which one in ten documents has planted ones."""
    docs = _table(spark, sf_dir, "documents")
    return run_report(docs.select("doc_id", with_planted_runs(docs).alias("text")))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices: base phrases word by word, and those with a few edits."""
    return license_scan(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_exact_dedup, op3_language, op4_decontamination, op5_jaccard_join, op6_quality, op7_warc, op8_token_binary, op9_pii, op10_token_counts, op11_spelling, op12_periodic_runs, op13_licenses)}

ORACLES = {
    "op2_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
}
