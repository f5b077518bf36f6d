"""Searching and comparing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators.steps import small
from terrace.plans.base import query
from terrace.sources.tables import table

NAMES = "names AS (SELECT n_nationkey::BIGINT AS id, n_name || CASE n_nationkey % 4 WHEN 0 THEN ' Province' WHEN 1 THEN ' (north)' WHEN 2 THEN ' Îlé' ELSE '' END AS name FROM nation)"
TRIGRAMS = """list_distinct(flatten([[substr('  ' || w || ' ', k, 3) FOR k IN range(1, length(w) + 2)] FOR w IN string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']))"""
QUERY = "nation 1"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    end = F.when(k == 0, " Province").when(k == 1, " (north)").when(k == 2, " Îlé").otherwise("")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", end).alias("name"))


@query(f"WITH {NAMES} SELECT id, trim(lower(strip_accents(name))) AS normalised, trim(regexp_replace(name, '\\s*\\([^()]*\\)\\s*$', '')) AS bare, regexp_replace(name, ' Province$', '') AS short FROM names")
def t1_t7_t9_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select("id", text.normalised(name).alias("normalised"), text.without_parentheses(name).alias("bare"), text.without_suffix(name).alias("short"))


@query(
    f"""WITH {NAMES}, g AS (SELECT id, {TRIGRAMS.format(x="name")} AS g, {TRIGRAMS.format(x=f"'{QUERY}'")} AS q FROM names),
    s AS (SELECT id, len(list_intersect(g, q)) AS common, len(g) + len(q) AS total FROM g)
    SELECT id, round(common / (total - common), 6) AS score FROM s WHERE common / (total - common) > 0.3"""
)
def t4_trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = text.similarity(text.trigrams(F.col("name")), text.trigrams(F.lit(QUERY)))
    return _names(spark, sf_dir).withColumn("score", score).filter("score > 0.3").select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id FROM part WHERE p_name ILIKE '%an%' AND p_type ILIKE 's%'")
def t3_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%an%") & F.col("p_type").ilike("s%")).select(F.col("p_partkey").alias("id"))


PLAIN = "trim(lower(strip_accents({x})))"
FOUND = """p AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name || ' > ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey),
    n AS (SELECT id, name, trim(lower(strip_accents(name))) AS n, trim(lower(strip_accents(path))) AS p FROM p)"""


@query(
    f"""WITH {FOUND}, g AS (SELECT *, {TRIGRAMS.format(x="n")} AS g, {TRIGRAMS.format(x=f"'{QUERY}'")} AS q FROM n), s AS (SELECT *, len(list_intersect(g, q)) AS common FROM g)
    SELECT id, name, round(CASE WHEN n = '{QUERY}' THEN 1000 ELSE 0 END + CASE WHEN starts_with(n, '{QUERY}') THEN 500 ELSE 0 END + common / (len(g) + len(q) - common) * 400 + CASE WHEN contains(p, '{QUERY}') THEN 300 ELSE 0 END
        + CASE WHEN contains(n, '{QUERY}') THEN 200 ELSE 0 END + CASE WHEN contains(p, 'nation') AND contains(p, '1') THEN 100 ELSE 0 END + 90 + CASE WHEN length(name) < 20 THEN (20 - length(name)) * 2 ELSE 0 END, 6) AS score FROM s"""
)
def t6_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all names and their paths for one query."""
    region = small(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    nation = table(spark, sf_dir, "nation").join(region, "n_regionkey")
    path = F.concat_ws(" > ", "r_name", "n_name")
    scored = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.round(text.relevance(F.col("n_name"), path, F.lit(1), QUERY), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id")


@query(f"WITH {NAMES} SELECT a.id AS a, b.id AS b FROM names a JOIN names b ON a.id < b.id AND lower(left(a.name, 7)) = lower(left(b.name, 7))")
def t10_same_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations that begin alike; t10_best_child is what matching does."""
    rows = _names(spark, sf_dir).select("id", F.lower(F.substring("name", 1, 7)).alias("k"))
    return rows.select(F.col("id").alias("a"), "k").join(rows.select(F.col("id").alias("b"), "k"), "k").filter("a < b").select("a", "b")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, text ILIKE '%license%' AS licensed FROM documents")
def t11_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and a word in texts; t11_region_lists and t11_markers read templates."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"), F.col("text").ilike("%license%").alias("licensed"))
