"""Matching of imported names to divisions, searches, and what is suggested for gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import hierarchy as h
from terrace.operators import matching as m
from terrace.operators.steps import cut, small
from terrace.plans.base import CLOSURE, DIVISIONS, deep_closure, query
from terrace.plans.names import TRIGRAMS
from terrace.sources.tables import NATIONS, deep_tree, divisions, table

#: Names as an import spells them; read by Spark and by the oracle alike.
SPELLED = """CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) || ' Province' WHEN 2 THEN c_name || ' (north)' WHEN 3 THEN substr(c_name, 1, length(c_name) - 2)
    WHEN 4 THEN 'Île-' || c_custkey WHEN 5 THEN replace(c_name, '#', '-') || '-x' ELSE ' ' || c_name || ' Autonomous' END"""
NODES = f"nodes AS (SELECT c_custkey AS node, (c_nationkey + 100000000)::BIGINT AS anchor, {SPELLED} AS name FROM customer)"
KIDS = "kids AS (SELECT c_custkey AS child, (c_nationkey + 100000000)::BIGINT AS anchor, CASE WHEN c_custkey % 4 = 1 THEN replace(c_name, '#', '-') || '-xy' ELSE c_name END || CASE WHEN c_custkey % 5 = 2 THEN ' district' ELSE '' END AS name FROM customer)"
_PLAIN = "trim(lower(strip_accents({x})))"
_SUFFIX = f"regexp_replace({{x}}, '\\s+({'|'.join(text.SUFFIXES)})$', '')"
_VARIANTS = f"list_distinct([{_PLAIN}, trim({_SUFFIX.format(x=_PLAIN)})])"
_PREFIX = """(length({s}) >= 4 AND length({s}) / length({l}) >= 0.6 AND CASE WHEN contains({s}, '-') AND len(string_split({s}, '-')) = len(string_split({l}, '-'))
    THEN len([i FOR i IN range(1, len(string_split({s}, '-')) + 1) IF NOT (starts_with(string_split({l}, '-')[i], string_split({s}, '-')[i]) OR starts_with(string_split({s}, '-')[i], string_split({l}, '-')[i]))]) = 0
    ELSE starts_with({l}, {s}) END)"""
_EITHER = f"CASE WHEN length(w) <= length(c) THEN {_PREFIX.format(s='w', l='c')} ELSE {_PREFIX.format(s='c', l='w')} END"
PAIRS = f"""{NODES}, {KIDS}, a AS (SELECT node, anchor, {_VARIANTS.format(x="split_part(name, '(', 1)")} AS wanted FROM nodes), b AS (SELECT child, anchor, {_PLAIN.format(x="name")} AS c, {_VARIANTS.format(x="name")} AS names FROM kids),
    j AS (SELECT node, child, wanted, names, c, unnest(wanted) AS w FROM a JOIN b USING (anchor)),
    pairs AS (SELECT node, child, max(CASE WHEN w = c THEN 700 WHEN len(list_intersect(wanted, names)) > 0 OR {_EITHER} THEN 650 END) AS score FROM j GROUP BY ALL HAVING score IS NOT NULL)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS node", f"CAST(c_nationkey + {NATIONS} AS LONG) AS anchor", f"{SPELLED} AS name")


def _kids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "CASE WHEN c_custkey % 4 = 1 THEN replace(c_name, '#', '-') || '-xy' ELSE c_name END || CASE WHEN c_custkey % 5 = 2 THEN ' district' ELSE '' END AS name"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS child", f"CAST(c_nationkey + {NATIONS} AS LONG) AS anchor", name, "c_custkey AS place")


@query(f"WITH {PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, child) AS rn FROM pairs) SELECT node, child, score::INT AS score FROM f WHERE rn = 1")
def t10_best_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each imported name the best child of its anchor: exact, else the first variant or prefix."""
    return m.best_children(_nodes(spark, sf_dir), _kids(spark, sf_dir))


@query("WITH p AS (SELECT a.n_name || CASE WHEN a.n_nationkey % 3 = 0 THEN '-east' ELSE '' END AS a, substr(b.n_name, 1, 7 + b.n_nationkey % 4) || CASE WHEN b.n_nationkey % 6 = 0 THEN '-ea' ELSE '' END AS b FROM nation a, nation b), q AS (SELECT a, b, lower(a) AS w, lower(b) AS c FROM p)"
       f" SELECT a, b FROM q WHERE {_EITHER}")  # fmt: skip
def t8_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations' names of which one begins the other; the 25 names are a set of fixed size."""
    nation = table(spark, sf_dir, "nation")
    a = nation.selectExpr("n_name || CASE WHEN n_nationkey % 3 = 0 THEN '-east' ELSE '' END AS a", "lower(substr(n_name, 1, 1)) AS k")
    b = nation.selectExpr("substr(n_name, 1, 7 + n_nationkey % 4) || CASE WHEN n_nationkey % 6 = 0 THEN '-ea' ELSE '' END AS b", "lower(substr(n_name, 1, 1)) AS k")
    return a.join(b, "k").filter(text.is_prefix_match(F.lower("a"), F.lower("b"))).select("a", "b")


@query()
def g14_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An imported tree bound to divisions level by level, each division once; greedy, so tests compare with brute force."""
    tree = divisions(spark, sf_dir)
    imported = tree.withColumn("name", F.when(F.col("id") % 5 == 2, F.concat("name", F.lit(" Province"))).when(F.col("id") % 5 == 3, F.concat(F.lit("zz"), F.col("name"))).otherwise(F.col("name")))
    return m.descended(imported, tree, h.closure(tree))


@query(
    f"""WITH {NODES}, {DIVISIONS}, w AS (SELECT node, {_VARIANTS.format(x="split_part(name, '(', 1)")} AS wanted FROM nodes), hits AS (SELECT DISTINCT node, d.id AS division, list_position(wanted, {_PLAIN.format(x="d.name")}) AS k FROM w JOIN divisions d ON list_contains(wanted, {_PLAIN.format(x="d.name")})),
    f AS (SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY k, division) AS rn FROM hits)
    SELECT node, division, CASE WHEN n = 1 THEN 700 ELSE 500 END AS score FROM f WHERE rn <= 5"""
)
def x8_country_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions anywhere that bear a variant of the name."""
    return m.fallback(_nodes(spark, sf_dir), divisions(spark, sf_dir))


@query(f"WITH {PAIRS}, s AS (SELECT node, count(*) AS n, max(score) AS best FROM pairs GROUP BY node) SELECT node, CASE WHEN n = 1 AND best >= 700 THEN 'auto_matched' WHEN n > 0 THEN 'needs_review' ELSE 'no_candidates' END AS status FROM nodes LEFT JOIN s USING (node)")
def x9_leaf_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf with one good candidate is matched, with others it waits for a look."""
    return m.candidates(_nodes(spark, sf_dir), _kids(spark, sf_dir)).select("node", m.leaf_status(F.col("n"), F.col("best")).alias("status"))


@query(
    """WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'manual_matched' WHEN 1 THEN 'children_matched' ELSE 'needs_review' END AS was, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0) AS members,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 1) AS suggestions FROM customer)
    SELECT id, CASE WHEN members > 0 THEN CASE WHEN was IN ('manual_matched', 'children_matched') THEN was ELSE 'auto_matched' END WHEN suggestions > 0 THEN 'needs_review' ELSE 'no_candidates' END AS status FROM s"""
)
def x14_derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderkey") % 9 == 0).alias("members"), F.count_if(F.col("o_orderkey") % 9 == 1).alias("suggestions"))
    was = F.when(F.col("id") % 5 == 0, "manual_matched").when(F.col("id") % 5 == 1, "children_matched").otherwise("needs_review")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(counts, "id", "left").fillna(0, ["members", "suggestions"])
    return rows.select("id", m.match_status(F.col("members"), F.col("suggestions"), was).alias("status"))


@query(
    f"""WITH {NODES}, {KIDS}, a AS (SELECT node, anchor, {TRIGRAMS.format(x=_PLAIN.format(x="split_part(name, '(', 1)"))} AS g FROM nodes), b AS (SELECT child, anchor, {TRIGRAMS.format(x=_PLAIN.format(x="name"))} AS h FROM kids),
    s AS (SELECT node, child, len(list_intersect(g, h)) AS common, len(g) + len(h) AS total FROM a JOIN b USING (anchor)),
    f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY common / (total - common) DESC, child) AS rn FROM s WHERE common / (total - common) > 0.3)
    SELECT node, child, round(common / (total - common) * 1000)::INT AS score FROM f WHERE rn <= 5"""
)
def x7_scoped_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every name the five most similar within its scope."""
    nodes = _nodes(spark, sf_dir).select("node", text.without_note(F.col("name")).alias("name"), F.col("anchor").alias("scope"))
    best = m.most_similar(nodes, _kids(spark, sf_dir).select(F.col("child").alias("id"), "name", F.col("anchor").alias("scope")), 5)
    return best.select("node", F.col("id").alias("child"), F.round(F.col("score") * 1000).cast("int").alias("score"))


SEARCHES = ("NATION_1", "nátion_2", "natoin_07", "zz")
_HIT = "CASE WHEN n = {t} THEN 1000 ELSE 0 END + CASE WHEN starts_with(n, {t}) THEN 500 ELSE 0 END + CASE WHEN contains(p, {t}) THEN 300 ELSE 0 END + CASE WHEN contains(n, {t}) THEN 200 ELSE 0 END + CASE WHEN contains(p, {t}) THEN 100 ELSE 0 END + 90 + CASE WHEN length(name) < 20 THEN (20 - length(name)) * 2 ELSE 0 END"


@query(
    f"""WITH q AS (SELECT search, {_PLAIN.format(x="search")} AS t, {TRIGRAMS.format(x=_PLAIN.format(x="search"))} AS h FROM (VALUES {", ".join(f"('{s}')" for s in SEARCHES)}) v(search)),
    d AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, {_PLAIN.format(x="n_name")} AS n, {_PLAIN.format(x="r_name || ' > ' || n_name")} AS p, {TRIGRAMS.format(x=_PLAIN.format(x="n_name"))} AS g FROM nation JOIN region ON r_regionkey = n_regionkey),
    h AS (SELECT search, id, name, contains(n, t) AS plain, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS sim, {_HIT.format(t="t")} AS points FROM q, d),
    m AS (SELECT search, bool_or(plain) AS any_plain FROM h GROUP BY search)
    SELECT search, id, round(CASE WHEN any_plain THEN points ELSE points + sim * 400 END, 6) AS score FROM h JOIN m USING (search) WHERE CASE WHEN any_plain THEN plain ELSE sim > 0.3 END"""
)
def t5_search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold the text without regard to accents; where there are none, similar ones. search_divisions as a function of a list of searches."""
    region = small(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    names = cut(table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat_ws(" > ", "r_name", "n_name").alias("path")))
    out = None
    for search in SEARCHES:
        term = text.normalised(F.lit(search))
        plain = names.filter(F.contains(text.normalised(F.col("name")), term))
        fuzzy = plain.isEmpty()
        hits = names.filter(text.similarity(text.trigrams(text.normalised(F.col("name"))), text.trigrams(term)) > 0.3) if fuzzy else plain
        rows = hits.select(F.lit(search).alias("search"), "id", F.round(text.relevance(F.col("name"), F.col("path"), F.lit(1), search, fuzzy).cast("double"), 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("search", F.desc("score"), "id")


@query(deep_closure() + ", m AS (SELECT o_custkey AS division, min(o_orderkey) % 40 AS region FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL), g AS (SELECT id, parent_id FROM tree WHERE id % 6 = 1 AND parent_id IS NOT NULL AND id NOT IN (SELECT division FROM m)),"
       """ s AS (SELECT g.id, min(region) AS region FROM g JOIN tree t ON t.parent_id = g.parent_id AND t.id <> g.id JOIN m ON m.division = t.id GROUP BY g.id),
    u AS (SELECT g.id, arg_min(m.region, (c.distance, m.region)) AS region FROM g JOIN closure c ON c.node = g.parent_id JOIN tree a ON a.id = c.ancestor JOIN tree t ON t.parent_id = a.parent_id AND t.id <> a.id JOIN m ON m.division = t.id WHERE g.id NOT IN (SELECT id FROM s) GROUP BY g.id)
    SELECT id, 'add_member' AS action, region FROM s UNION ALL SELECT id, 'create_region', region FROM u""")  # fmt: skip
def r5_gap_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap joins the region of a sibling, the least id; else a region is made beside the nearest ancestor's sibling that has one."""
    tree = deep_tree(spark, sf_dir)
    members = cut(table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").groupBy(F.col("o_custkey").alias("division")).agg((F.min("o_orderkey") % 40).alias("region")))
    gaps = tree.filter("id % 6 = 1 AND parent_id IS NOT NULL").join(members.select(F.col("division").alias("id")), "id", "left_anti").select("id", "parent_id")
    return h.gap_suggestions(gaps, tree, h.closure(tree), members)


@query(
    f"WITH RECURSIVE {DIVISIONS}, {CLOSURE.format(tree='divisions')}, top AS (SELECT id FROM divisions WHERE parent_id IS NULL), under AS (SELECT id FROM divisions WHERE parent_id IN (FROM top)),"
    " country AS (SELECT id FROM under UNION SELECT id FROM top WHERE id NOT IN (SELECT parent_id FROM divisions WHERE id IN (FROM under)))"
    " SELECT ancestor AS country, count(*) AS divisions FROM closure WHERE ancestor IN (FROM country) GROUP BY ancestor"
)
def r11_country_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries are children of roots, and roots without such; with how many divisions each has, its own included."""
    tree = divisions(spark, sf_dir)
    return h.countries(tree).join(h.closure(tree), F.col("country") == F.col("ancestor")).groupBy("country").agg(F.count("*").alias("divisions"))


#: What a work is, by the table's type of metal.
KIND = "replace(replace(replace(replace(p_type, 'STEEL', 'Bronze sculpture'), 'BRASS', 'Funerary STELE'), 'TIN', 'Plaster cast'), 'COPPER', 'Reliefs')"


@query(f"SELECT p_partkey AS id, regexp_matches({KIND}, '(?i)sculpt|statue|bust|relief|cast|figurine|torso|stele|monument') AS sculptural,"
       " trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(strip_accents(p_name || ' #')), '[^a-z0-9]+', ' ', 'g')) AS same_label FROM part")
def t12_t13_types_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a type is of some words, and whether two labels are one but for case, accents and signs."""
    folded = lambda c: F.trim(F.regexp_replace(F.lower(text.plain(c)), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.is_sculptural(F.expr(KIND)).alias("sculptural"), (folded(F.col("p_name")) == folded(F.concat("p_name", F.lit(" #")))).alias("same_label"))
