"""Ancestors, descendants, coverage and edits of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import hierarchy as h
from terrace.operators import page_trees
from terrace.plans.base import CLOSURE, DIVISIONS, deep_closure, query
from terrace.sources.tables import deep_tree, divisions, table

WITH = deep_closure()
COVERED, OWNED = "id % 7 = 2 AND id > 20", "id % 5 = 1"


def _members(tree: DataFrame) -> DataFrame:
    return tree.filter("id % 4 < 2").select((F.col("id") % 3).alias("group_id"), F.col("id").alias("division"))


@query(WITH + "SELECT node, ancestor, distance FROM closure WHERE distance > 0")
def r1_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.closure(deep_tree(spark, sf_dir)).filter("distance > 0")


@query(WITH + "SELECT ancestor, count(*) AS descendants, max(distance) AS height FROM closure WHERE distance > 0 GROUP BY ancestor")
def r2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = h.lineage(deep_tree(spark, sf_dir))
    below = lines.select(F.posexplode(F.slice(F.reverse("chain"), F.lit(2), F.size("chain"))).alias("k", "s"))
    return below.groupBy(F.col("s.id").alias("ancestor")).agg(F.count("*").alias("descendants"), (F.max("k") + 1).cast("long").alias("height"))


@query(WITH + "SELECT node, string_agg(name, ' > ' ORDER BY distance DESC) AS path, max(distance) AS depth FROM closure JOIN tree ON tree.id = ancestor GROUP BY node")
def r3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.paths(h.lineage(deep_tree(spark, sf_dir)))


@query(
    WITH
    + f""", covered AS (SELECT id FROM tree WHERE {COVERED}), inside AS (SELECT node FROM closure WHERE ancestor IN (FROM covered)),
    holding AS (SELECT ancestor AS node FROM closure WHERE node IN (FROM covered))
    SELECT id, parent_id, name FROM tree WHERE id NOT IN (FROM inside) AND id NOT IN (FROM holding) AND (parent_id IS NULL OR parent_id IN (FROM holding))"""
)
def r4_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.coverage_gaps(tree, h.closure(tree), tree.filter(COVERED).select("id"))


@query(
    f"WITH RECURSIVE {DIVISIONS}, {CLOSURE.format(tree='divisions')}"
    "SELECT ancestor AS id, count(*) AS orders, sum(o_totalprice::DECIMAL(15, 2))::DOUBLE AS total FROM closure JOIN orders ON o_custkey = node GROUP BY ancestor"
)
def r6_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders first by customer, so that only sums meet the tree."""
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("t"))
    return h.rolled_up(h.lineage(divisions(spark, sf_dir)), facts, [F.sum("n").alias("orders"), F.sum("t").cast("double").alias("total")])


@query(f"WITH RECURSIVE {DIVISIONS}, {CLOSURE.format(tree='divisions')} SELECT DISTINCT o_orderkey AS object_id, ancestor AS region_id FROM orders JOIN closure ON node = o_custkey")
def r7_propagated_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object has one place in the tree and one way up, so nothing repeats."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("node"))
    lines = h.lineage(divisions(spark, sf_dir)).select(F.col("id").alias("node"), F.transform("chain", lambda s: s["id"]).alias("up"))
    return orders.join(lines, "node").select("object_id", F.explode("up").alias("region_id"))


@query(WITH + f"SELECT DISTINCT node FROM closure WHERE ancestor IN (SELECT id FROM tree WHERE {COVERED})")
def r8_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.beneath(h.closure(tree), tree.filter(COVERED))


@query(
    WITH
    + """, members AS (SELECT id % 3 AS group_id, id AS division FROM tree WHERE id % 4 < 2),
    held AS (SELECT node, count(DISTINCT group_id) AS groups FROM closure JOIN members ON division = ancestor GROUP BY node HAVING count(DISTINCT group_id) > 1)
    SELECT node AS division, groups FROM held JOIN tree ON id = node WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node FROM held)"""
)
def r9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.overlaps(tree, h.closure(tree), _members(tree))


@query(
    WITH
    + f"""SELECT node, arg_min(ancestor, distance) AS ancestor, arg_min(ancestor % 11, distance) AS owner FROM closure
    WHERE distance > 0 AND ancestor IN (SELECT id FROM tree WHERE {OWNED}) GROUP BY node"""
)
def r10_nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.nearest_ancestor(h.closure(tree), tree.filter(OWNED).select("id", (F.col("id") % 11).alias("owner")))


@query(WITH + "SELECT node AS id, max(distance) AS depth FROM closure WHERE node IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL) GROUP BY node")
def r12_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with children, deepest first."""
    tree = deep_tree(spark, sf_dir)
    inner = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"))
    return h.lineage(tree).join(inner, "id", "left_semi").select("id", (F.size("chain") - 1).cast("long").alias("depth")).orderBy(F.desc("depth"), "id")


@query(
    WITH
    + """SELECT t.id, arg_min(c.ancestor, c.distance) AS parent_id, any_value(t.name) AS name FROM tree t
    LEFT JOIN closure c ON c.node = t.id AND c.distance > 0 AND c.ancestor % 3 <> 0 WHERE t.id % 3 <> 0 GROUP BY t.id"""
)
def r14_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.flattened(tree, h.closure(tree), tree.filter("id % 3 = 0"))


@query(
    WITH
    + """, members AS (SELECT id % 3 AS group_id, id AS division, parent_id FROM tree WHERE id % 4 < 2 AND parent_id IS NOT NULL),
    k AS (SELECT parent_id, group_id, count(*) AS c FROM members GROUP BY ALL),
    n AS (SELECT parent_id, group_id, row_number() OVER (PARTITION BY parent_id ORDER BY c DESC, group_id) AS rn FROM k)
    SELECT division, m.group_id AS from_group, n.group_id AS to_group FROM members m JOIN n ON n.parent_id = m.parent_id AND rn = 1 WHERE m.group_id <> n.group_id"""
)
def r15_owner_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    return h.owner_moves(tree, _members(tree))


@query()
def x3_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterates to a fixpoint over (group, parent), which one recursive query can't; tests compare with brute force."""
    tree = deep_tree(spark, sf_dir)
    return h.simplified(tree.filter("id % 13 <> 5").select((F.col("id") % 2).alias("group_id"), F.col("id").alias("division")).unionByName(tree.select(F.lit(9).cast("long").alias("group_id"), F.col("id").alias("division")).filter("division > 12")), tree)


@query(WITH + "SELECT DISTINCT ancestor AS node FROM closure WHERE node IN (SELECT id FROM tree WHERE id % 50 = 7) AND ancestor % 10 <> 1")
def x13_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry to compute anew: changed nodes and what is above them, but for custom boundaries."""
    tree = deep_tree(spark, sf_dir)
    return h.above(h.closure(tree), tree.filter("id % 50 = 7")).filter("node % 10 <> 1")


@query(
    WITH
    + """, leaf AS (SELECT id FROM tree WHERE id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)),
    f AS (SELECT t.id, t.id IN (FROM leaf) AS is_leaf, t.id % 6 = 0 AS matched,
        EXISTS (FROM closure c WHERE c.node = t.id AND c.ancestor % 6 = 0) AS covered,
        EXISTS (FROM closure c JOIN leaf l ON l.id = c.node WHERE c.ancestor = t.id AND c.node % 6 <> 0) AS open_below FROM tree t)
    SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, count(*) FILTER (matched) AS matched, count(*) FILTER (covered AND NOT matched) AS inherited,
        count(*) FILTER (is_leaf AND NOT covered) AS blocking_leaves, count(*) FILTER (NOT covered AND open_below) AS blocking FROM f"""
)
def x1_match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = deep_tree(spark, sf_dir)
    links, marked = h.closure(tree), F.col("id") % 6 == 0
    leaves = tree.join(tree.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL"), "id", "left_anti").select("id")
    rows = tree.select("id", marked.alias("matched"))
    for name, nodes in (("is_leaf", leaves), ("covered", h.beneath(links, tree.filter(marked))), ("open_below", h.above(links, leaves.filter(~marked)))):
        key = nodes.columns[0]
        rows = rows.join(nodes.select(F.col(key).alias("id"), F.lit(True).alias(name)), "id", "left").fillna(False, [name])
    count = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return rows.agg(
        F.count("*").alias("nodes"), count("is_leaf", "leaves"), count("matched", "matched"), count("covered AND NOT matched", "inherited"),
        count("is_leaf AND NOT covered", "blocking_leaves"), count("NOT covered AND open_below", "blocking"),
    )


@query(
    """WITH u AS (SELECT r_name AS path, NULL AS parent_path, r_name AS name, 1::BIGINT AS depth, r_regionkey IN (SELECT n_regionkey FROM nation) AS has_children FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT r_name || ' > ' || n_name, r_name, n_name, 2, n_nationkey IN (SELECT c_nationkey FROM customer) FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT DISTINCT r_name || ' > ' || n_name || ' > ' || c_mktsegment, r_name || ' > ' || n_name, c_mktsegment, 3, false FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT * FROM u"""
)
def io2_tree_from_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).join(customer, nation.n_nationkey == customer.c_nationkey, "left")
    return h.from_levels(rows, ["r_name", "n_name", "c_mktsegment"])


CHAINS = """chains AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 1 THEN NULL WHEN c_custkey % 5 = 0 THEN c_custkey // 5 ELSE c_custkey - 1 END AS parent_id, 'n' || (c_custkey // 4) AS name FROM customer)"""


@query(
    f"""WITH RECURSIVE {CHAINS}, alone AS (SELECT parent_id FROM chains WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) = 1),
    gone AS (SELECT c.id, c.parent_id FROM chains c JOIN chains p ON p.id = c.parent_id AND p.name = c.name WHERE c.parent_id IN (FROM alone)),
    heir AS (SELECT id, parent_id AS heir FROM gone UNION ALL SELECT h.id, g.parent_id FROM heir h JOIN gone g ON g.id = h.heir),
    last AS (SELECT id, heir FROM heir WHERE heir NOT IN (SELECT id FROM gone))
    SELECT c.id, coalesce(heir, parent_id) AS parent_id, name FROM chains c LEFT JOIN last l ON l.id = c.parent_id WHERE c.id NOT IN (SELECT id FROM gone)"""
)
def io3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only children with their parent's name are folded into it, along whole chains."""
    k = F.col("c_custkey")
    parent = F.when(k <= 1, None).when(k % 5 == 0, F.floor(k / 5).cast("long")).otherwise(k - 1)
    return h.collapsed(table(spark, sf_dir, "customer").select(k.alias("id"), parent.alias("parent_id"), F.concat(F.lit("n"), F.floor(k / 4).cast("string")).alias("name")))


@query(
    WITH
    + """, gone AS (SELECT DISTINCT node FROM closure WHERE distance > 0 AND ancestor IN (SELECT id FROM tree WHERE id % 50 = 3)), t AS (SELECT * FROM tree WHERE id NOT IN (FROM gone)),
    marked AS (SELECT id FROM t WHERE id IN (5, 2)), inner_ AS (SELECT DISTINCT parent_id FROM t WHERE parent_id IS NOT NULL),
    top AS (SELECT node, arg_min(ancestor, distance) AS top FROM closure WHERE distance > 0 AND ancestor IN (FROM marked) AND node NOT IN (FROM gone) GROUP BY node)
    SELECT id, coalesce(top, parent_id) AS parent_id, name FROM t LEFT JOIN top ON node = id WHERE top IS NULL OR id NOT IN (FROM inner_) OR id IN (FROM marked)"""
)
def x12_tree_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some nodes lose all beneath them, others keep only leaves."""
    tree = deep_tree(spark, sf_dir)
    left = h.dismissed(tree, h.closure(tree), tree.filter("id % 50 = 3").select("id"))
    return h.pruned(left, h.closure(left), left.filter("id IN (5, 2)").select("id"))


@query(
    WITH
    + """, area AS (SELECT id, id % 17 + 1 AS area FROM tree), held AS (SELECT DISTINCT ancestor AS id, node FROM closure WHERE node % 4 < 2 AND distance > 0), whole AS (SELECT ancestor AS id, sum(area) AS area FROM closure JOIN area a ON a.id = node WHERE distance > 0 GROUP BY ancestor),
    part AS (SELECT h.id, sum(area) AS area FROM held h JOIN area a ON a.id = h.node GROUP BY h.id) SELECT w.id, round(coalesce(p.area, 0) / w.area, 5) AS coverage FROM whole w LEFT JOIN part p USING (id)"""
)
def x4_container_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each container's area that assigned divisions beneath it have; 0 where it has children but none of these."""
    tree = deep_tree(spark, sf_dir)
    area, assigned = F.col("id") % 17 + 1, F.col("id") % 4 < 2
    facts = tree.select("id", area.alias("area"), F.when(assigned, area).otherwise(0).alias("own"))
    sums = h.rolled_up(h.lineage(tree), facts, [F.sum("area").alias("area"), F.sum("own").alias("own")])
    below = sums.alias("s").join(facts.alias("f"), "id").select("id", (F.col("s.area") - F.col("f.area")).alias("area"), (F.col("s.own") - F.col("f.own")).alias("own"))
    return below.filter("area > 0").select("id", F.round(F.col("own") / F.col("area"), 5).alias("coverage"))


STATUS = "CASE id % 9 WHEN 0 THEN 'auto_matched' WHEN 1 THEN 'children_matched' WHEN 2 THEN 'manual_matched' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'no_candidates' WHEN 5 THEN 'suggested' WHEN 6 THEN 'needs_review' WHEN 7 THEN 'no_candidates' END"
DONE = ("auto_matched", "manual_matched", "children_matched")


@query(
    WITH
    + f""", leaf AS (SELECT id FROM tree WHERE id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)), s AS (SELECT id, {STATUS} AS status, id IN (FROM leaf) AS is_leaf, id % 13 = 1 AND id % 2 = 0 AS warned FROM tree),
    covered AS (SELECT DISTINCT node AS id FROM closure WHERE distance > 0 AND ancestor % 23 = 0), open_leaf AS (SELECT id FROM s WHERE is_leaf AND status NOT IN {DONE} AND id NOT IN (FROM covered)),
    above AS (SELECT DISTINCT ancestor AS id FROM closure WHERE node IN (FROM open_leaf))
    SELECT count(*) FILTER (status = 'auto_matched') AS auto_matched, count(*) FILTER (status = 'children_matched') AS children_matched, count(*) FILTER (status = 'needs_review') AS needs_review,
        count(*) FILTER (status = 'needs_review' AND id NOT IN (FROM covered)) AS needs_review_blocking, count(*) FILTER (status = 'no_candidates') AS no_candidates,
        count(*) FILTER (status = 'no_candidates' AND id NOT IN (FROM covered) AND id IN (FROM above)) AS no_candidates_blocking, count(*) FILTER (status = 'manual_matched') AS manual_matched,
        count(*) FILTER (status = 'suggested') AS suggested, count(*) FILTER (status IS NOT NULL) AS total_matched, count(*) FILTER (is_leaf) AS total_leaves, count(*) AS total_regions, count(*) FILTER (warned) AS hierarchy_warnings_count FROM s"""
)
def x1_all_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve counts. A state blocks where no ancestor has members, and for want of candidates only with an open leaf beneath."""
    tree = deep_tree(spark, sf_dir)
    links = h.closure(tree)
    covered = h.beneath(links, tree.filter("id % 23 = 0"), own=False)
    inner = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    mark = lambda rows, name: rows.select(F.col(rows.columns[0]).alias("id"), F.lit(True).alias(name))
    rows = tree.select("id", F.expr(STATUS).alias("status"), F.expr("id % 13 = 1 AND id % 2 = 0").alias("warned"))
    rows = rows.join(mark(inner, "inner"), "id", "left").join(mark(covered, "covered"), "id", "left").fillna(False, ["inner", "covered"])
    open_leaves = rows.filter(~F.col("inner") & ~F.col("covered") & ~F.col("status").isin(*DONE)).select("id")
    rows = rows.join(mark(h.above(links, open_leaves), "open_below"), "id", "left").fillna(False, ["open_below"])
    counts = {
        "auto_matched": "status = 'auto_matched'", "children_matched": "status = 'children_matched'", "needs_review": "status = 'needs_review'", "needs_review_blocking": "status = 'needs_review' AND NOT covered",
        "no_candidates": "status = 'no_candidates'", "no_candidates_blocking": "status = 'no_candidates' AND NOT covered AND open_below", "manual_matched": "status = 'manual_matched'", "suggested": "status = 'suggested'",
        "total_matched": "status IS NOT NULL", "total_leaves": "NOT inner", "total_regions": "true", "hierarchy_warnings_count": "warned",
    }
    return rows.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()])


@query(
    """WITH e AS (SELECT c_nationkey::BIGINT AS page, c_custkey AS id, c_custkey % 3 <> 0 AND c_nationkey % 4 <> 1 AS linked, c_custkey % 2 = 0 AND c_nationkey % 4 <> 1 AS has_items, c_custkey % 5 <> 2 OR c_nationkey % 8 = 1 AS has_page FROM customer),
    p AS (SELECT page, bool_and(NOT linked AND NOT has_items) AND bool_or(has_page) AS promoted FROM e GROUP BY page)
    SELECT page, count(*) FILTER (linked OR has_items OR has_page) + 1 AS nodes, count(*) FILTER (NOT (linked OR has_items OR has_page)) AS dead_ends,
        bool_or(NOT promoted AND NOT linked AND NOT has_items AND has_page) AS ambiguous FROM e JOIN p USING (page) GROUP BY page"""
)
def t14_page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' lists of regions: plain names without items and page are dropped; where only plain names with pages are left they count as linked; the nodes that stay are counted."""
    c = table(spark, sf_dir, "customer")
    entries = c.selectExpr("CAST(c_nationkey AS LONG) AS page", "c_custkey % 3 <> 0 AND c_nationkey % 4 <> 1 AS linked", "c_custkey % 2 = 0 AND c_nationkey % 4 <> 1 AS has_items", "c_custkey % 5 <> 2 OR c_nationkey % 8 = 1 AS has_page")
    plain = ~F.col("linked") & ~F.col("has_items")
    sums = entries.groupBy("page").agg(
        (F.bool_and(plain) & F.bool_or("has_page")).alias("promoted"), F.count("*").alias("n"), F.count_if(plain & ~F.col("has_page")).alias("dead_ends"), F.bool_or(plain & F.col("has_page")).alias("open"),
    )
    return sums.select("page", (F.col("n") - F.col("dead_ends") + 1).alias("nodes"), "dead_ends", (F.col("open") & ~F.col("promoted")).alias("ambiguous"))


#: Pages deep that a tree is built.
PAGE_DEPTH = 6


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: title, regions. Its regions are the keys below it, some as a group or by another title, and for some the page above."""
    key = F.col("c_custkey")
    named = lambda k: F.when(k % 7 == 3, F.concat(F.lit("R"), k.cast("string"))).otherwise(F.concat(F.lit("P"), k.cast("string")))
    below = F.transform(F.sequence(key * 3, key * 3 + 2), named)
    none = F.array().cast("array<string>")
    one = lambda name, linked, items: F.struct(name.alias("name"), linked.alias("linked"), items.alias("items"))
    single = F.transform(below, lambda n: one(n, F.lit(True), none))
    group = F.array(one(F.concat(F.lit("Group "), key.cast("string")), F.lit(False), below))
    back = F.when(key % 5 == 0, F.array(one(named(F.floor(key / 3).cast("long")), F.lit(True), none))).otherwise(F.slice(single, 1, 0))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), key.cast("string")).alias("title"), F.concat(F.when(key % 4 == 3, group).otherwise(single), back).alias("regions"))


def page_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("R"), key).alias("title"), F.concat(F.lit("P"), key).alias("target"))


@query()
def t14_built_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees built over all pages from three of them, with redirects, groups and ways back; tests compare with a recursive build."""
    roots = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "title string")
    made = page_trees.page_trees(roots, linked_pages(spark, sf_dir), page_redirects(spark, sf_dir), PAGE_DEPTH)
    line = lambda c: F.array_join(F.transform(c, lambda k: k.cast("string")), ".")
    return made.select("root", line(F.col("path")).alias("path"), line(F.col("parent")).alias("parent"), "name", "kind")
