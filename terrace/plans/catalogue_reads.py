"""What readers of the catalogue ask for: a region with its objects and where to show them, lists, histories and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import geo
from terrace.functions.geo import haversine
from terrace.operators import changes as c
from terrace.operators import hierarchy as h
from terrace.operators.ranking import first_per, ranked
from terrace.operators.steps import cut, small
from terrace.plans.base import DIVISIONS, HAVERSINE, OBJECTS, PLACES, deep_closure, query
from terrace.sources.tables import NATIONS, deep_tree, divisions, objects, places, table

#: A reader's objects: admitted, not lost; and places: offered, published.
ADMITTED, VISIBLE = "id % 11 <> 4", "offered AND id % 6 <> 1"
IN_REGION = "member AS (SELECT DISTINCT l_partkey AS object_id, (s_nationkey + 100000000)::BIGINT AS region_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


def reader_positions(shown: DataFrame, seen: DataFrame) -> DataFrame:
    """id, lon, lat: of each object (id, lon, lat) its visible place (object_id, id, lon, lat) nearest to its own point, the least id of equals; its own point without one."""
    at = seen.select(F.col("object_id").alias("_o"), F.col("id").alias("_p"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    rows = shown.select("id", "lon", "lat").join(at, F.col("id") == F.col("_o"), "left")
    far = haversine(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    best = rows.groupBy("id").agg(F.min_by(F.struct("_x", "_y"), F.struct(F.round(far, 3), "_p")).alias("r"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    return best.select("id", F.coalesce("r._x", "lon").alias("lon"), F.coalesce("r._y", "lat").alias("lat"))


def filtered_objects(shown: DataFrame, seen: DataFrame, members: DataFrame, *, category: str | None = None, kinds: list[str] | None = None, region: int | None = None, search: str | None = None, box: tuple[float, float, float, float] | None = None, unread: bool = False) -> DataFrame:
    """Objects by any of these conditions; all that are given must hold. unread: hidden objects too.

    A box asks for a visible place in it, or for the object's own point if it has no visible place; west > east is over the antimeridian.
    """
    keep: Column = F.lit(unread) | F.expr(ADMITTED)
    if category is not None:
        keep &= F.col("category") == category
    if kinds is not None:
        keep &= F.col("kind").isin(kinds)
    if search is not None:
        keep &= F.col("name").ilike(f"%{search}%")
    rows = shown.filter(keep)
    if region is not None:
        rows = rows.join(members.filter(F.col("region_id") == region).select(F.col("object_id").alias("id")), "id", "left_semi")
    if box is None:
        return rows
    edges = [F.lit(float(x)) for x in box]
    found = seen.groupBy(F.col("object_id").alias("id")).agg(F.bool_or(geo.in_box(F.col("lon"), F.col("lat"), *edges)).alias("_inside"))
    return rows.join(found, "id", "left").filter(F.coalesce("_inside", geo.in_box(F.col("lon"), F.col("lat"), *edges))).drop("_inside")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"CAST(s_nationkey + {NATIONS} AS LONG) AS region_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object_id"), "l_suppkey")
    return lines.join(small(supplier), F.col("l_suppkey") == F.col("s_suppkey")).select("object_id", "region_id").distinct()


@query(
    f"""WITH {OBJECTS}, {PLACES}, {IN_REGION}, seen AS (SELECT * FROM places WHERE {VISIBLE}), o AS (SELECT * FROM objects WHERE {ADMITTED} AND id IN (SELECT object_id FROM member WHERE region_id = 100000003)),
    d AS (SELECT o.id, p.lon, p.lat, row_number() OVER (PARTITION BY o.id ORDER BY round({HAVERSINE.format(a="o", b="p")}, 3), p.id) AS rn FROM o JOIN seen p ON p.object_id = o.id)
    SELECT o.id, o.name, o.category, coalesce(d.lon, o.lon) AS lon, coalesce(d.lat, o.lat) AS lat, (SELECT count(*) FROM seen WHERE object_id = o.id) AS places FROM o LEFT JOIN d ON d.id = o.id AND rn = 1"""
)
def f4_region_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's objects where a reader meets them: the region picks objects first, and only their places are read on."""
    own = objects(spark, sf_dir).filter(ADMITTED)
    supplier = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    member = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(small(supplier), "l_suppkey", "left_semi").select(F.col("l_partkey").alias("id")).distinct()
    shown = own.join(member, "id", "left_semi")
    seen = places(spark, sf_dir).filter(VISIBLE)
    at = seen.select(F.col("object_id").alias("_o"), F.col("id").alias("_p"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    rows = shown.select("id", "name", "category", "lon", "lat").join(at, F.col("id") == F.col("_o"), "left")
    far = haversine(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    best = rows.groupBy("id", "name", "category", "lon", "lat").agg(F.min_by(F.struct("_x", "_y"), F.struct(F.round(far, 3), "_p")).alias("r"), F.count("_p").alias("places"))
    return best.select("id", "name", "category", F.coalesce("r._x", "lon").alias("lon"), F.coalesce("r._y", "lat").alias("lat"), "places")


@query(
    f"""WITH {OBJECTS}, {PLACES}, {IN_REGION}, seen AS (SELECT object_id, bool_or((lon >= 140 OR lon <= -100) AND lat BETWEEN -50 AND 60) AS inside FROM places WHERE {VISIBLE} GROUP BY object_id)
    SELECT id, name FROM objects LEFT JOIN seen ON object_id = id WHERE {ADMITTED} AND kind IN (SELECT kind FROM objects WHERE size > 10) AND name ILIKE '%a%' AND id IN (SELECT object_id FROM member WHERE region_id = 100000003)
        AND coalesce(inside, (lon >= 140 OR lon <= -100) AND lat BETWEEN -50 AND 60)"""
)
def f1_f7_filtered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, name, region and a box over the antimeridian, all at once (F2's visible places or own point, F3, J4)."""
    shown = objects(spark, sf_dir)
    kinds = shown.filter("size > 10").select("kind").distinct()
    found = filtered_objects(shown, places(spark, sf_dir).filter(VISIBLE), _members(spark, sf_dir), region=100_000_003, search="a", box=(140, -50, -100, 60))
    return found.join(kinds, "kind", "left_semi").select("id", "name")


@query(
    f"""WITH {PLACES}, {IN_REGION}, p AS (SELECT *, id % 4 = 1 AS inside FROM places WHERE {VISIBLE}), a AS (SELECT object_id, count(*) FILTER (inside) AS n_in, count(*) AS n FROM p GROUP BY object_id)
    SELECT object_id, CASE WHEN n_in > 0 THEN n_in ELSE n END AS shown, CASE WHEN n_in > 0 THEN n_in ELSE n END > 1 AS folded FROM a"""
)
def x30_place_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within the region if there are any, else all; more than one are folded into a marker."""
    inside = F.col("id") % 4 == 1
    counts = places(spark, sf_dir).filter(VISIBLE).groupBy("object_id").agg(F.count_if(inside).alias("n_in"), F.count("*").alias("n"))
    shown = F.when(F.col("n_in") > 0, F.col("n_in")).otherwise(F.col("n"))
    return counts.select("object_id", shown.alias("shown"), (shown > 1).alias("folded"))


@query(
    """SELECT user_id, event_id, ts AS visited_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type = 'view' QUALIFY position <= 5"""
)
def x16_visit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest visits of each user, with how many there are."""
    visits = table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", F.col("ts").alias("visited_at"))
    totals = visits.groupBy("user_id").agg(F.count("*").alias("total"))
    return ranked(visits, ["user_id"], [F.desc("visited_at"), F.desc("event_id")], "position").filter("position <= 5").join(totals, "user_id")


@query(
    f"""WITH {PLACES}, seen AS (SELECT DISTINCT event_id % 97 AS user_id, event_id * 31 % 1500 AS o FROM events), v AS (SELECT user_id, object_id, count(*) AS n FROM places JOIN seen ON o = id // 1000000000 % 1500 WHERE offered GROUP BY ALL),
    t AS (SELECT object_id, count(*) AS total FROM places WHERE offered GROUP BY object_id), gone AS (SELECT user_id, object_id FROM v WHERE (user_id + object_id) % 13 = 0)
    SELECT v.user_id, v.object_id, n, CASE WHEN n < total THEN 'partial' ELSE 'visited' END AS status FROM v JOIN t USING (object_id) ANTI JOIN gone g ON g.user_id = v.user_id AND g.object_id = v.object_id"""
)
def c15_visit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visit to a place is one to its object; where the last of an object's visits is taken back, the object's goes too."""
    offered = places(spark, sf_dir).filter("offered").withColumn("o", F.expr("id div 1000000000 % 1500"))
    seen = table(spark, sf_dir, "events").selectExpr("event_id % 97 AS user_id", "event_id * 31 % 1500 AS o").distinct()
    return visited_objects(offered.select("object_id", "o"), seen, (F.col("user_id") + F.col("object_id")) % 13 == 0)


def visited_objects(offered: DataFrame, seen: DataFrame, taken_back: Column) -> DataFrame:
    """user_id, object_id, n, status: how many of an object's offered places (object_id, o) a user's visits (user_id, o) reach.

    Places that the same users saw are counted together first. An object's counts lie in one partition, in which they meet
    their users and are added up: the pairs of users and places are never shuffled.
    """
    users = cut(seen.groupBy("o").agg(F.array_sort(F.collect_set("user_id")).alias("users")))
    crowds = cut(users.select("users").distinct().withColumn("crowd", F.monotonically_increasing_id()))
    counts = offered.join(small(users.join(crowds, "users").select("o", "crowd")), "o", "left").groupBy("object_id", "crowd").agg(F.count("*").alias("n"))
    counts = counts.repartition("object_id").withColumn("total", F.sum("n").over(Window.partitionBy("object_id")))
    visits = counts.join(small(crowds), "crowd").select("object_id", "n", "total", F.explode("users").alias("user_id")).filter(~taken_back)
    kept = visits.groupBy("object_id", "user_id").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    return kept.select("user_id", "object_id", "n", F.when(F.col("n") < F.col("total"), "partial").otherwise("visited").alias("status"))


@query(
    f"""WITH {DIVISIONS}, s AS (SELECT o_custkey AS region_id, list({{'id': o_orderkey, 'score': o_orderkey * 7 % 1000}} ORDER BY o_orderkey * 7 % 1000 DESC, o_orderkey)[1:5] AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT id, name, parent_id, coalesce(to_json(l)::VARCHAR, '[]') AS suggestions FROM divisions LEFT JOIN s ON region_id = id"""
)
def a9_x2_match_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with each node's suggestions as JSON, the best five first; an empty list where there is none."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr("o_custkey AS region_id", "o_orderkey AS id", "o_orderkey * 7 % 1000 AS score")
    top = ranked(orders, ["region_id"], [F.desc("score"), F.asc("id")]).filter("rn <= 5")
    lists = top.groupBy("region_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))), lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score")))).alias("suggestions"))
    return divisions(spark, sf_dir).join(lists.withColumnRenamed("region_id", "id"), "id", "left").select("id", "name", "parent_id", F.coalesce("suggestions", F.lit("[]")).alias("suggestions"))


@query("SELECT l_suppkey AS division, count(DISTINCT l_partkey) AS regions, count(DISTINCT l_partkey % 7) AS world_views FROM lineitem WHERE l_suppkey % 3 <> 1 GROUP BY l_suppkey")
def a12_division_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions, and world views of theirs, use each division."""
    lines = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 1").select(F.col("l_suppkey").alias("division"), "l_partkey").distinct()
    return lines.groupBy("division").agg(F.count("*").alias("regions"), F.count_distinct(F.col("l_partkey") % 7).alias("world_views"))


@query("SELECT DISTINCT c_nationkey::BIGINT AS parent_id FROM customer WHERE c_acctbal > 0 AND c_custkey % 5 = 0 GROUP BY c_nationkey HAVING count(*) >= 2")
def a13_parents_with_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of two or more forms that could share a border."""
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0 AND c_custkey % 5 = 0")
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("parent_id")).agg(F.count("*").alias("n")).filter("n >= 2").select("parent_id")


_SPELLED = "CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) || 'é' WHEN 1 THEN 'É' || n_name WHEN 2 THEN 'f' || n_name ELSE n_name END"


@query(f"WITH n AS (SELECT n_nationkey::BIGINT AS id, {_SPELLED} AS name FROM nation) SELECT id, name, row_number() OVER (ORDER BY lower(strip_accents(name)), name) AS position FROM n")
def k5_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a person sorts them, without regard to case and accents at first; the 25 names are numbered in one partition."""
    names = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS LONG) AS id", f"{_SPELLED} AS name")
    return ranked(names.withColumn("_all", F.lit(1)), ["_all"], [F.collate("name", "UNICODE_CI_AI").asc(), F.asc("name")], "position").drop("_all")


@query("SELECT p_brand AS brand, p_partkey AS id, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) WHERE rn <= 12")
def w3_first_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best of each brand; the id breaks ties."""
    return ranked(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_retailprice"), ["brand"], [F.desc_nulls_last("p_retailprice"), F.asc("id")]).filter("rn <= 12").drop("p_retailprice")


@query("SELECT id, parent_id, name FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, name ORDER BY id) AS rn FROM (SELECT o_orderkey AS id, o_custkey AS parent_id, o_orderpriority AS name FROM orders)) WHERE rn = 1")
def w6_deduplicated_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of siblings of one name the one with the least id."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("name"))
    return rows.groupBy("parent_id", "name").agg(F.min("id").alias("id")).select("id", "parent_id", "name")


@query(
    deep_closure()
    + """, gone AS (SELECT DISTINCT node FROM closure WHERE ancestor IN (5, 11)) SELECT (SELECT count(*) FROM gone) AS regions, (SELECT count(*) FROM orders WHERE o_custkey IN (FROM gone)) AS members,
    (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey IN (FROM gone)) AS kinds"""
)
def x33_delete_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would go with some nodes and all beneath them."""
    tree = deep_tree(spark, sf_dir)
    gone = h.beneath(h.closure(tree), tree.filter("id IN (5, 11)"))
    held = gone.join(table(spark, sf_dir, "orders"), F.col("node") == F.col("o_custkey"), "left")
    return held.agg(F.count_distinct("node").alias("regions"), F.count("o_orderkey").alias("members"), F.count_distinct("o_orderpriority").alias("kinds"))


@query(f"WITH {OBJECTS} SELECT id, id % 7 <> 2 AS public, CASE WHEN id % 3 = 0 THEN 'true' WHEN id % 3 = 1 THEN 'false' END IS NOT DISTINCT FROM 'true' AS in_danger FROM objects WHERE id % 7 <> 2 OR id % 5 = 0")
def f6_x32_visible_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public world views' objects, or all to an administrator; a flag that stands as text in JSON."""
    stored = F.when(F.col("id") % 3 == 0, '{"inDanger":"true"}').when(F.col("id") % 3 == 1, '{"inDanger":"false"}').otherwise("{}")
    flag = F.coalesce(F.get_json_object(stored, "$.inDanger") == "true", F.lit(False))
    public, administrator = F.col("id") % 7 != 2, F.col("id") % 5 == 0
    return objects(spark, sf_dir).filter(public | administrator).select("id", public.alias("public"), flag.alias("in_danger"))


@query(
    """WITH c AS (SELECT event_id AS key, event_type AS kind, ts, ts + INTERVAL 1 DAY * (event_id % 9) AS expires FROM events), n AS (SELECT max(ts) AS now FROM events)
    SELECT kind, count(*) AS entries, count(*) FILTER (expires > now) AS live, array_to_string((list(key ORDER BY key) FILTER (expires > now))[1:3], ',') AS first_keys FROM c, n GROUP BY kind"""
)
def io12_io13_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of answers by kind: how many entries, how many still hold, and three of these (2.13 clean-ups drop the others)."""
    cache = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("kind"), "ts", (F.col("ts") + F.make_dt_interval((F.col("event_id") % 9).cast("int"))).alias("expires"))
    rows = cache.crossJoin(F.broadcast(cache.agg(F.max("ts").alias("now"))))
    live = F.col("expires") > F.col("now")
    some = first_per(rows.filter(live).select("kind", "key"), ["kind"], [F.asc("key")], 3).groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: k.cast("string")), ",").alias("first_keys"))
    return rows.groupBy("kind").agg(F.count("*").alias("entries"), F.count_if(live).alias("live")).join(some, "kind", "left")


@query(
    """WITH q AS (SELECT DISTINCT event_type || '/' || user_id AS q FROM events WHERE user_id % 3 = 0), s AS (SELECT sha256(event_type || '/' || user_id) AS key, max(event_id) AS answer, max(ts) AS stored FROM events WHERE user_id % 2 = 0 GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
    SELECT q, CASE WHEN stored + INTERVAL 14 DAY > now THEN answer END AS answer, CASE WHEN stored IS NULL THEN 'miss' WHEN stored + INTERVAL 14 DAY > now THEN 'hit' ELSE 'stale' END AS state FROM q LEFT JOIN s ON key = sha256(q), n"""
)
def io12_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered out of a cache keyed by their hash, as long as an answer holds; the rest is to be asked anew."""
    events = table(spark, sf_dir, "events")
    q = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    asked = events.filter("user_id % 3 = 0").select(q.alias("q")).distinct()
    stored = events.filter("user_id % 2 = 0").groupBy(F.sha2(q, 256).alias("key")).agg(F.max("event_id").alias("answer"), F.max("ts").alias("stored"))
    rows = asked.join(stored, F.sha2("q", 256) == F.col("key"), "left").crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    holds = F.col("stored") + F.expr("INTERVAL 14 DAYS") > F.col("now")
    return rows.select("q", F.when(holds, F.col("answer")).alias("answer"), F.when(F.col("stored").isNull(), "miss").when(holds, "hit").otherwise("stale").alias("state"))


@query(
    f"""WITH {DIVISIONS}, k AS (SELECT parent_id AS id, count(*) AS n FROM divisions WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT t.name AS region, p.name AS parent, coalesce(n, 0) AS children, t.id AS member FROM divisions t LEFT JOIN divisions p ON p.id = t.parent_id LEFT JOIN k ON k.id = t.id"""
)
def io10_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world view that mirrors the divisions: a region for each, whose one member it is."""
    tree = divisions(spark, sf_dir)
    kids = tree.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    above = tree.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")).join(kids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return tree.join(kids, "id", "left").join(above, "parent_id", "left").select(F.col("name").alias("region"), "parent", F.coalesce("children", F.lit(0)).alias("children"), F.col("id").alias("member"))


@query(
    deep_closure()
    + """, s AS (SELECT id, id * 7 % 100 / 100 AS "similar", id % 3 = 1 AS has_members FROM tree), k AS (SELECT t.id, t.parent_id, s."similar" FROM tree t JOIN s ON s.id = t.id WHERE NOT has_members AND parent_id IS NOT NULL)
    SELECT id AS removed, parent_id AS region_id, "similar" >= 0.5 AS resolved FROM k WHERE "similar" >= 0.4"""
)
def x11_auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without members of their own whose form is like a division's; above one half they are resolved. Rows are also the log to undo it by."""
    rows = deep_tree(spark, sf_dir).withColumn("similar", F.col("id") * 7 % 100 / 100).filter("id % 3 <> 1 AND parent_id IS NOT NULL AND similar >= 0.4")
    return rows.select(F.col("id").alias("removed"), F.col("parent_id").alias("region_id"), (F.col("similar") >= 0.5).alias("resolved"))


@query(
    """WITH p AS (SELECT p_partkey AS id, list_distinct([p_brand, p_type, CASE WHEN p_size > 10 THEN p_brand ELSE 'x' END]) AS a, [p_brand, p_type] AS b FROM part)
    SELECT id, array_to_string(list_sort(a), '|') AS joined, len(a) = len(b) AND len([x FOR x IN b IF NOT list_contains(a, x)]) = 0 AS same FROM p"""
)
def y1_y3_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays put together without repeats, and compared as sets: as long as each other, and all of the second in the first."""
    first = F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.array(F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("x"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), first.alias("a"), F.array("p_brand", "p_type").alias("b"))
    return rows.select("id", F.array_join(F.sort_array("a"), "|").alias("joined"), (c.set_change(F.col("a"), F.col("b"), c.MINOR) == c.SAME).alias("same"))


@query(f"WITH {OBJECTS}, n AS (SELECT n_nationkey, n_nationkey * 14 - 170.0::DOUBLE AS lon, n_nationkey * 7 % 120 - 48.0::DOUBLE AS lat FROM nation) SELECT id, round(sqrt(pow((n.lon - o.lon) * 111320.0 * cos(radians((o.lat + n.lat) / 2)), 2) + pow((n.lat - o.lat) * 110540.0, 2)), 3) AS metres FROM objects o JOIN n ON n_nationkey = id % 25")
def m2_flat_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each object to its nation's middle, on a plane."""
    n = small(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_nationkey * 14 - 170.0D AS x", "n_nationkey * 7 % 120 - 48.0D AS y"))
    rows = objects(spark, sf_dir).join(n, F.col("id") % 25 == F.col("k"))
    return rows.select("id", F.round(geo.flat_metres(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 3).alias("metres"))


@query("SELECT event_id AS id FROM events, (SELECT max(ts) AS now FROM events) WHERE NOT (ts < now - INTERVAL 20 DAY OR (event_type = 'error' AND ts < now - INTERVAL 5 DAY))")
def cleanup_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up leaves of tokens: those not expired for long, and revoked ones for a shorter time."""
    events = table(spark, sf_dir, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    old = (F.col("ts") < F.col("now") - F.expr("INTERVAL 20 DAYS")) | ((F.col("event_type") == "error") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 5 DAYS")))
    return rows.filter(~old).select(F.col("event_id").alias("id"))
