"""Works, statements and venues: parts are works, suppliers and customers their venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import entities as e
from terrace.operators import graph
from terrace.operators.steps import cut
from terrace.plans.base import query
from terrace.sources.tables import LINE_ID, table

#: Venues are customers; read by Spark and by the oracle alike.
VENUE = {
    "id": "c_custkey", "c1": "CASE c_custkey % 9 WHEN 0 THEN 'ruin' WHEN 1 THEN 'park' ELSE 'museum' END", "c2": "CASE c_custkey % 7 WHEN 0 THEN 'church' WHEN 1 THEN 'gallery' ELSE 'house' END",
    "dissolved": "CASE WHEN c_custkey % 13 = 4 THEN '1990' END", "lon": "CASE WHEN c_custkey % 17 <> 5 THEN (c_custkey div 3) % 300 * 0.01 + c_custkey % 3 * 0.0001 END", "lat": "40 + c_custkey % 3 * 0.0002",
    "works": "c_custkey * 7 % 5", "links": "c_custkey * 11 % 40",
}
_list = lambda duck: ", ".join(f"{v.replace('div', '//') if duck else v} AS {k}" for k, v in VENUE.items())
VENUES = f"venues AS (SELECT {_list(True)} FROM customer)"
JUDGED = f"""{VENUES}, judged AS (SELECT *, CASE WHEN c1 = 'ruin' THEN 'kill-list' WHEN dissolved IS NOT NULL THEN 'dissolved' WHEN c1 <> 'museum' AND c2 <> 'gallery' THEN 'not a museum class'
    WHEN c2 = 'church' THEN 'site, not a venue' WHEN lon IS NULL THEN 'no coordinates' END AS reason FROM venues)"""
PARENTS = "parents AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey > 1 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey % 4 = 1 AND c_custkey > 2)"
STATEMENTS = """statements AS (SELECT l_partkey AS work, l_orderkey % 60 + 1 AS venue, CASE WHEN l_linenumber % 2 = 0 THEN 'owner' ELSE 'place' END AS property,
    CASE l_suppkey % 4 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'preferred' ELSE 'normal' END AS rank, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS ended FROM lineitem)"""
CURRENT = f"""{STATEMENTS}, live AS (SELECT DISTINCT work, property, venue, rank FROM statements WHERE rank <> 'deprecated' AND ended IS NULL),
    current_ AS (SELECT DISTINCT work, property, venue FROM (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY work, property) AS p FROM live) WHERE NOT p OR rank = 'preferred')"""
ABOVE = "above AS (SELECT c_custkey AS id, c_custkey // 2 AS above FROM customer WHERE c_custkey BETWEEN 2 AND 60 UNION SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey BETWEEN 4 AND 60 UNION SELECT 7, 15 UNION SELECT 3, 7)"
PLACED = f"""{CURRENT}, {ABOVE}, same AS (SELECT id AS x, above AS y FROM above UNION SELECT above, id FROM above UNION SELECT id, id FROM (SELECT DISTINCT venue AS id FROM current_)),
    agreed AS (SELECT o.work, o.venue AS v1, p.venue AS v2 FROM current_ o JOIN current_ p ON o.work = p.work AND o.property = 'owner' AND p.property = 'place' JOIN same ON x = o.venue AND y = p.venue),
    ranked AS (SELECT work, v1 AS venue, 0 AS r FROM agreed UNION SELECT work, v2, 0 FROM agreed UNION SELECT work, venue, 1 FROM current_ WHERE property = 'owner' UNION SELECT work, venue, 2 FROM current_ WHERE property = 'place'),
    chosen AS (SELECT DISTINCT work, venue FROM (SELECT *, min(r) OVER (PARTITION BY work) AS best FROM ranked) WHERE r = best),
    strict AS (SELECT * FROM above a WHERE NOT EXISTS (FROM above b WHERE b.id = a.above AND b.above = a.id)),
    placed AS (SELECT work, venue FROM chosen c WHERE NOT EXISTS (FROM chosen d JOIN strict ON id = d.venue AND above = c.venue WHERE d.work = c.work))"""


def _venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{v} AS {k}" for k, v in VENUE.items()])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    return _venues(spark, sf_dir).withColumn("reason", e.verdict(F.array("c1", "c2"), F.col("dissolved"), lon, lat, ["ruin"], ["museum", "gallery"], ["church"], ["gallery"]))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.filter("id % 5 <> 3 AND id > 1").selectExpr("id", "id div 2 AS parent").unionByName(c.filter("id % 4 = 1 AND id > 2").selectExpr("id", "id div 3 AS parent")).distinct()


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS work", "l_orderkey % 60 + 1 AS venue", "CASE WHEN l_linenumber % 2 = 0 THEN 'owner' ELSE 'place' END AS property",
        "CASE l_suppkey % 4 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'preferred' ELSE 'normal' END AS rank", "CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS ended",
    )


def _above(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).filter("id <= 60")
    more = c.sparkSession.createDataFrame([(7, 15), (3, 7)], "id long, above long")
    return c.filter("id > 1").selectExpr("id", "id div 2 AS above").unionByName(c.filter("id > 3").selectExpr("id", "id div 4 AS above")).unionByName(more).distinct()


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.placed(cut(e.current(_statements(spark, sf_dir))), cut(_above(spark, sf_dir)))


@query(f"WITH {JUDGED} SELECT id, coalesce(reason, 'pass') AS verdict FROM judged")
def g3_venue_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("id", F.coalesce("reason", F.lit("pass")).alias("verdict"))


@query(
    f"""WITH {PARENTS}, r0 AS (SELECT c_custkey AS start, c_custkey AS id, 0 AS hop FROM customer WHERE c_custkey % 2 = 1), r1 AS (SELECT start, parent AS id, 1 AS hop FROM r0 JOIN parents USING (id)), r2 AS (SELECT start, parent AS id, 2 AS hop FROM r1 JOIN parents USING (id)),
    r3 AS (SELECT start, parent AS id, 3 AS hop FROM r2 JOIN parents USING (id)) SELECT start, id, min(hop) AS hop FROM (FROM r0 UNION FROM r1 UNION FROM r2 UNION FROM r3) GROUP BY ALL"""
)
def g2_venue_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers within three hops."""
    return e.walk(_venues(spark, sf_dir).filter("id % 2 = 1").select("id"), cut(_parents(spark, sf_dir)))


@query(
    f"""WITH {JUDGED}, {PARENTS}, r0 AS (SELECT id AS start, id, 0 AS hop FROM venues), r1 AS (SELECT start, parent AS id, 1 AS hop FROM r0 JOIN parents USING (id)), r2 AS (SELECT start, parent AS id, 2 AS hop FROM r1 JOIN parents USING (id)),
    r3 AS (SELECT start, parent AS id, 3 AS hop FROM r2 JOIN parents USING (id)), reach AS (SELECT start, id, min(hop) AS hop FROM (FROM r0 UNION FROM r1 UNION FROM r2 UNION FROM r3) GROUP BY ALL),
    found AS (SELECT start, hop, count(*) AS n, min(r.id) AS venue FROM reach r JOIN judged j ON j.id = r.id AND reason IS NULL GROUP BY ALL), first AS (SELECT DISTINCT ON (start) * FROM found ORDER BY start, hop)
    SELECT v.id AS start, CASE WHEN n = 1 THEN venue END AS venue, CASE WHEN n = 1 THEN hop END AS hop, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM venues v LEFT JOIN first ON start = v.id"""
)
def g4_resolved_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue or the first passing one above it; two at a hop leave it open."""
    judged = _judged(spark, sf_dir)
    return e.resolved(judged.select("id"), judged.filter("reason IS NULL").select("id"), cut(_parents(spark, sf_dir)))


@query(f"WITH {CURRENT} SELECT * FROM current_")
def g11_current_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without deprecated and ended statements; preferred ones hide the rest of their property."""
    return e.current(_statements(spark, sf_dir)).select("work", "property", "venue")


@query(f"WITH {PLACED} SELECT work, venue FROM placed")
def g5_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where works are: what owners and places agree on, the most specific."""
    return _placed(spark, sf_dir)


@query(f"WITH {PLACED}, h AS (SELECT venue, count(*) FILTER (work % 3 = 0) AS sculptures, count(*) FILTER (work % 3 <> 0) AS paintings FROM placed GROUP BY venue) SELECT venue, venue % 11 = 2 OR paintings >= sculptures AS art FROM h")
def g7_art_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of an art class, and those with at least as many paintings as sculptures."""
    held = _placed(spark, sf_dir).groupBy("venue").agg(F.count_if(F.col("work") % 3 == 0).alias("sculptures"), F.count_if(F.col("work") % 3 != 0).alias("paintings"))
    return held.select("venue", e.art(F.col("venue") % 11 == 2, F.col("paintings"), F.col("sculptures")).alias("art"))


@query()
def g6_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues folded into their containers or stronger twins, with what they end in; tests compare with brute force."""
    found = _venues(spark, sf_dir).filter("lon IS NOT NULL").select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), "works", "links")
    near = found.select("id").filter("id % 3 > 0").selectExpr("id", "id - 1 AS parent").filter("parent % 2 = 0")
    folds = cut(e.folds(cut(found), near))
    return folds.join(e.survivors(folds), "id").select("id", "into", "why", "survivor")


@query(
    f"""WITH {PLACED}, old AS (SELECT work, CASE WHEN work % 6 = 1 THEN NULL WHEN work % 6 = 2 THEN venue + 1 ELSE venue END AS venue FROM placed WHERE work % 8 <> 7 UNION SELECT p_partkey + 100000, 1 FROM part WHERE p_partkey % 50 = 0),
    now AS (SELECT work, CASE WHEN work % 6 = 3 THEN NULL ELSE venue END AS venue FROM placed), a AS (SELECT work, array_to_string(list_sort(coalesce(list(DISTINCT venue::VARCHAR) FILTER (venue IS NOT NULL), [])), '|') AS was FROM old GROUP BY work),
    b AS (SELECT work, array_to_string(list_sort(coalesce(list(DISTINCT venue::VARCHAR) FILTER (venue IS NOT NULL), [])), '|') AS now_ FROM now GROUP BY work)
    SELECT work, CASE WHEN now_ IS NULL THEN 'dropped' WHEN was = '' THEN 'gained' WHEN now_ = '' THEN 'lost' ELSE 'moved' END AS change FROM a LEFT JOIN b USING (work) WHERE was IS DISTINCT FROM now_"""
)
def g9_placement_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How works' venues changed between two runs."""
    placed = cut(_placed(spark, sf_dir))
    old = placed.filter("work % 8 <> 7").selectExpr("work", "CASE WHEN work % 6 = 1 THEN NULL WHEN work % 6 = 2 THEN venue + 1 ELSE venue END AS venue")
    old = old.unionByName(table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").selectExpr("p_partkey + 100000 AS work", "CAST(1 AS LONG) AS venue"))
    now = placed.selectExpr("work", "CASE WHEN work % 6 = 3 THEN NULL ELSE venue END AS venue")
    text = F.col("venue").cast("string")
    return e.placement_diff(old.withColumn("venue", text), now.withColumn("venue", text))


@query(
    f"""WITH w AS (SELECT l_partkey AS id, {LINE_ID} AS n, CASE l_suppkey % 3 WHEN 0 THEN 'work of art' ELSE 'kind ' || (l_orderkey % 4) END AS type, CASE WHEN l_returnflag <> 'N' THEN 'img' || l_orderkey END AS image, l_orderkey % 50 AS links FROM lineitem)
    SELECT id, coalesce(arg_min(type, n) FILTER (type <> 'work of art'), arg_min(type, n)) AS type, arg_min(image, n) FILTER (image IS NOT NULL) AS image, max(links) AS links FROM w GROUP BY id"""
)
def g10_merged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each work out of several fetches."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", f"{LINE_ID} AS n", "CASE l_suppkey % 3 WHEN 0 THEN 'work of art' ELSE 'kind ' || (l_orderkey % 4) END AS type", "CASE WHEN l_returnflag <> 'N' THEN 'img' || l_orderkey END AS image", "l_orderkey % 50 AS links")
    return e.pooled(rows, ["work of art"])


@query(
    f"""WITH {PLACED}, w AS (SELECT l_partkey AS work, count(*) AS links, l_partkey % 10 = 0 AS edition FROM lineitem GROUP BY l_partkey HAVING count(*) >= 22),
    h AS (SELECT p.work, venue, links, edition, count(*) OVER (PARTITION BY p.work) AS holders FROM placed p JOIN w ON w.work = p.work), t AS (SELECT * FROM h WHERE edition OR holders <= 2)
    SELECT venue, count(*) AS works, max(links) AS most_links FROM t GROUP BY venue"""
)
def g12_museums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From statements to museums: current statements, placements, well linked works without those that many share, and their venues."""
    works = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("links")).filter("links >= 22")
    held = cut(_placed(spark, sf_dir)).join(works, "work")
    few = held.groupBy("work").agg(F.count("*").alias("holders")).filter("holders <= 2 OR work % 10 = 0").select("work")
    return held.join(few, "work", "left_semi").groupBy("venue").agg(F.count("*").alias("works"), F.max("links").alias("most_links"))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 90 + 1000 AS b FROM lineitem UNION SELECT DISTINCT l_partkey % 90 + 1000, l_orderkey % 400 + 5000 FROM lineitem WHERE l_linenumber = 1),
    h1 AS (SELECT DISTINCT a AS root, b AS id FROM e WHERE a <= 5), s1 AS (SELECT root, count(*) AS n FROM h1 GROUP BY root), ok1 AS (SELECT root FROM s1 WHERE n <= greatest(1, 20) * 3 AND 1 + n <= 2000),
    k1 AS (SELECT * FROM h1 WHERE root IN (FROM ok1)), h2 AS (SELECT DISTINCT root, b AS id FROM k1 JOIN e ON a = id WHERE (root, b) NOT IN (FROM k1) AND root <> b), s2 AS (SELECT h2.root, count(*) AS n, any_value(s1.n) + 1 AS size FROM h2 JOIN s1 ON s1.root = h2.root GROUP BY h2.root),
    bad AS (SELECT root, 1 AS hop, n AS offered FROM s1 WHERE root NOT IN (FROM ok1) UNION ALL SELECT root, 2, n FROM s2 WHERE n > greatest(size, 20) * 3 OR size + n > 2000),
    reach AS (SELECT a AS root, a AS id, 0 AS hop FROM (SELECT DISTINCT a FROM e WHERE a <= 5) UNION ALL SELECT root, id, 1 FROM k1 UNION ALL SELECT root, id, 2 FROM h2 WHERE root NOT IN (SELECT root FROM bad WHERE hop = 2))
    SELECT root, id, hop, NULL::BIGINT AS offered FROM reach UNION ALL SELECT root, NULL, hop, offered FROM bad"""
)
def g1_bounded_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes below each root within two hops, and the hops that offered too much."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.selectExpr("l_suppkey AS a", "l_partkey % 90 + 1000 AS b")
    edges = cut(first.unionByName(lines.filter("l_linenumber = 1").selectExpr("l_partkey % 90 + 1000 AS a", "l_orderkey % 400 + 5000 AS b")).distinct())
    seen, refused = graph.bounded_closure(edges, edges.filter("a <= 5").select(F.col("a").alias("id")), hops=2, floor=20)
    return seen.select("root", "id", "hop", F.lit(None).cast("long").alias("offered")).unionByName(refused.select("root", F.lit(None).cast("long").alias("id"), "hop", "offered"))


@query(
    """WITH m AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey // 2 % 3)::BIGINT AS group_id FROM nation), adj AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id <> b.id AND (abs(a.id % 5 - b.id % 5) + abs(a.id // 5 - b.id // 5)) = 1),
    k AS (SELECT a.a, a.b FROM adj a JOIN m x ON x.id = a.a JOIN m y ON y.id = a.b AND x.group_id = y.group_id),
    r AS (WITH RECURSIVE reach AS (SELECT id, id AS other FROM m UNION SELECT reach.id, k.b FROM reach JOIN k ON k.a = reach.other) SELECT id, min(other) AS component FROM reach GROUP BY id),
    s AS (SELECT group_id, component, count(*) AS size FROM r JOIN m USING (id) GROUP BY ALL), o AS (SELECT *, size / sum(size) OVER (PARTITION BY group_id) AS share, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, component) AS rn FROM s),
    v AS (SELECT r.component, y.group_id AS g, count(*) AS votes FROM adj JOIN r ON r.id = adj.a JOIN m x ON x.id = adj.a JOIN m y ON y.id = adj.b AND x.group_id <> y.group_id GROUP BY ALL), w AS (SELECT component, arg_min(g, (-votes, g)) AS neighbour FROM v GROUP BY component)
    SELECT group_id, component, size, round(share, 6) AS share, neighbour FROM o JOIN w USING (component) WHERE rn > 1"""
)
def g13_x31_exclaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of regions that lie apart from the largest, with the region that borders them most; nations stand on a grid."""
    nation = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS LONG) AS id", "CAST(n_nationkey div 2 % 3 AS LONG) AS group_id")
    at = nation.selectExpr("id AS a", "id % 5 AS x", "id div 5 AS y")
    step = at.selectExpr("a", "inline(array(struct(x + 1 AS x, y AS y), struct(x AS x, y + 1 AS y)))")
    border = step.join(at.selectExpr("a AS b", "x", "y"), ["x", "y"]).select("a", "b")
    found = graph.fragments(nation, border)
    return found.select("group_id", "component", "size", F.round("share", 6).alias("share"), "neighbour")
