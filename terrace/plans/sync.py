"""A run of a source against what is stored: changes, claims, places, admission and what waits for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import changes as c
from terrace.operators.ranking import first_per, page
from terrace.operators.steps import cut
from terrace.plans.base import HAVERSINE, query
from terrace.sources.tables import LINE_ID, table

#: Stored rows and a snapshot of them, perturbed by key; the expressions are read by Spark and by the oracle alike.
STORED = {
    "id": "o_orderkey", "name": "o_orderpriority", "tag1": "o_orderstatus", "tag2": "substr(o_orderpriority, 1, 1)",
    "lon": "o_orderkey * 37 % 3600 / 10 - 180", "lat": "o_orderkey * 91 % 1600 / 10 - 80", "danger": "o_orderkey % 31 = 0", "site": "'s' || (o_orderkey % 5)",
    "held": "o_orderkey % 10 = 0", "claims_name": "o_orderkey % 14 = 0", "claims_site": "o_orderkey % 12 = 0", "state": "CASE WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'auto' END",
    "missing": "o_orderkey % 29 = 0",
}
SNAPSHOT = {
    "id": "o_orderkey", "name": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END",
    "tag1": "substr(o_orderpriority, 1, 1)", "tag2": "CASE WHEN o_orderkey % 13 = 0 THEN 'new' ELSE o_orderstatus END",
    "lon": "o_orderkey * 37 % 3600 / 10 - 180", "lat": "o_orderkey * 91 % 1600 / 10 - 80 + CASE o_orderkey % 4 WHEN 1 THEN 0.00005 WHEN 2 THEN 0.001 WHEN 3 THEN 0.1 ELSE 0 END * (o_orderkey % 2 + o_orderkey % 3)",
    "danger": "(o_orderkey % 31 = 0) <> (o_orderkey % 17 = 0)", "site": "CASE WHEN o_orderkey % 6 = 0 THEN 'moved' ELSE 's' || (o_orderkey % 5) END",
}
_rows = lambda columns: [f"{e} AS {n}" for n, e in columns.items()]
WITH = f"""WITH stored AS (SELECT {", ".join(_rows(STORED))} FROM orders WHERE o_orderkey % 23 <> 0), snapshot AS (SELECT {", ".join(_rows(SNAPSHOT))} FROM orders WHERE o_orderkey % 19 <> 0),
    d AS (SELECT n.id, o.id IS NULL AS created, o.held, o.state, n.name AS new_name, n.site AS new_site, o.name AS old_name, o.site AS old_site, [x FOR x IN [
        CASE WHEN o.name <> n.name THEN {{'f': 'name', 's': 2}} END,
        CASE WHEN o.tag1 NOT IN (n.tag1, n.tag2) OR n.tag1 NOT IN (o.tag1, o.tag2) OR n.tag2 NOT IN (o.tag1, o.tag2) THEN {{'f': 'tags', 's': 1}} END,
        CASE WHEN {HAVERSINE.format(a="o", b="n")} >= 10 THEN {{'f': 'location', 's': CASE WHEN {HAVERSINE.format(a="o", b="n")} > 1000 THEN 2 ELSE 1 END}} END,
        CASE WHEN o.danger <> n.danger THEN {{'f': 'metadata.inDanger', 's': 2}} END,
        CASE WHEN o.claims_site AND o.site <> n.site THEN {{'f': 'metadata.site', 's': 1}} END,
        CASE WHEN NOT o.claims_site AND o.site <> n.site THEN {{'f': 'metadata', 's': 1}} END] IF x IS NOT NULL AND o.id IS NOT NULL] AS diffs,
        [x FOR x IN [CASE WHEN claims_name THEN 'name' END, CASE WHEN claims_site THEN 'metadata.site' END] IF x IS NOT NULL] AS claims FROM snapshot n LEFT JOIN stored o ON o.id = n.id),
    split AS (SELECT *, [x.f FOR x IN diffs IF x.f IN claims] AS conflicts, [x.f FOR x IN diffs IF x.f NOT IN claims] AS rest FROM d),
    changes AS (SELECT id, CASE WHEN created THEN 'created' WHEN NOT held AND len(rest) > 0 THEN 'updated' ELSE 'unchanged' END AS change,
        CASE WHEN NOT created AND len(diffs) > 0 THEN CASE WHEN len([x FOR x IN diffs IF x.s = 2]) > 0 THEN 'major' ELSE 'minor' END END AS significance,
        CASE WHEN NOT created AND NOT held THEN array_to_string(rest, ',') ELSE '' END AS applied, CASE WHEN NOT created THEN array_to_string(conflicts, ',') ELSE '' END AS conflicts,
        CASE WHEN NOT created AND held THEN array_to_string(rest, ',') ELSE '' END AS waiting, state, new_name, new_site, old_name, old_site, claims FROM split)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tags and claims as arrays and metadata as a map."""
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 23 <> 0").selectExpr(*_rows(STORED))
    claims = F.array_compact(F.array(F.when(F.col("claims_name"), "name"), F.when(F.col("claims_site"), "metadata.site")))
    return _shaped(rows).select("id", "name", "tags", "lon", "lat", "metadata", "held", "state", "missing", claims.alias("claimed"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "orders").filter("o_orderkey % 19 <> 0").selectExpr(*_rows(SNAPSHOT))).select("id", "name", "tags", "lon", "lat", "metadata")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array("tag1", "tag2")).withColumn("metadata", F.create_map(F.lit("inDanger"), F.col("danger").cast("string"), F.lit("site"), F.col("site")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot's rows with what becomes of their differences, and columns old and new of both sides."""
    rows = _snapshot(spark, sf_dir).alias("n").join(_stored(spark, sf_dir).alias("o"), F.col("o.id") == F.col("n.id"), "left")
    o, n = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"n.{f}"))
    claimed_site = F.array_contains(o("claimed"), "metadata.site")
    site = c.text_change(o("metadata")["site"], n("metadata")["site"], c.MINOR)
    fields = {
        "name": c.text_change(o("name"), n("name"), c.MAJOR), "tags": c.set_change(o("tags"), n("tags"), c.MINOR), "location": c.point_change(o("lon"), o("lat"), n("lon"), n("lat")),
        "metadata.inDanger": c.text_change(o("metadata")["inDanger"], n("metadata")["inDanger"], c.MAJOR),
        "metadata.site": F.when(claimed_site, site).otherwise(c.SAME), "metadata": F.when(claimed_site, c.SAME).otherwise(site),
    }
    created = o("id").isNull()
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("f"), v.alias("s")) for k, v in fields.items()]), lambda x: x["s"] > c.SAME)
    diffs = F.when(created, F.slice(found, 1, 0)).otherwise(found)
    out = c.split_changes(diffs, o("claimed"), F.coalesce(o("held"), F.lit(False)), created)
    return rows.select(n("id").alias("id"), *[v.alias(k) for k, v in out.items()], o("state").alias("state"), F.struct(*[n(f).alias(f) for f in ("name", "metadata")]).alias("new"), F.struct(*[o(f).alias(f) for f in ("name", "metadata", "claimed")]).alias("old"))


@query(f"{WITH} SELECT id, change, significance, applied, conflicts, waiting FROM changes")
def c1_c2_full_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, sets, places and metadata keys compared; claimed fields are conflicts, those of held rows wait."""
    return _changes(spark, sf_dir).select("id", "change", "significance", "applied", "conflicts", "waiting")


@query(f"{WITH} SELECT id, CASE WHEN state = 'verified' AND change = 'updated' AND id % 6 <> 0 THEN 'auto' ELSE state END AS state FROM changes WHERE change <> 'created'")
def c4_curation_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass given to a row ends with new content, but for sources that wait to be read anyway."""
    gone = (F.col("state") == "verified") & (F.col("change") == "updated") & (F.col("id") % 6 != 0)
    return _changes(spark, sf_dir).filter("change <> 'created'").select("id", F.when(gone, "auto").otherwise(F.col("state")).alias("state"))


@query(
    f"""{WITH} SELECT coalesce(s.id, c.id) AS id, CASE WHEN c.id IS NULL OR s.claims_name OR s.held THEN s.name ELSE new_name END AS name, CASE WHEN c.id IS NULL OR s.claims_site OR s.held THEN s.site ELSE new_site END AS site,
    coalesce(s.missing, false) AND c.id IS NULL AS missing, CASE WHEN c.id IS NULL THEN 'unknown' ELSE 'present' END AS membership FROM stored s FULL JOIN changes c ON c.id = s.id"""
)
def c3_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed fields and held rows keep what they have; whatever was seen is not missing any more, and present."""
    stored, seen = _stored(spark, sf_dir).alias("o"), _snapshot(spark, sf_dir).alias("n")
    rows = stored.join(seen, F.col("o.id") == F.col("n.id"), "full")
    absent, held = F.col("n.id").isNull(), F.coalesce(F.col("o.held"), F.lit(False))
    claims = F.coalesce("o.claimed", F.array().cast("array<string>"))
    keys = F.transform(claims, lambda x: F.regexp_replace(x, r"^metadata\.", ""))
    both = F.when(absent | held, F.col("o.metadata")).when(F.col("o.id").isNull(), F.col("n.metadata")).otherwise(c.merged_maps(F.col("o.metadata"), F.col("n.metadata"), keys))
    name = F.when(absent | held | F.array_contains(claims, "name"), F.col("o.name")).otherwise(F.col("n.name"))
    return rows.select(F.coalesce("o.id", "n.id").alias("id"), name.alias("name"), both["site"].alias("site"), (F.coalesce("o.missing", F.lit(False)) & absent).alias("missing"), F.when(absent, "unknown").otherwise("present").alias("membership"))


RUNS = "SELECT event_id AS id, event_id % 7 <> 3 AS authoritative, event_id % 11 = 5 AS cancelled, event_id % 5 // 4 AS errors, event_id * 13 % 100 AS seen, event_id % 90 AS previous FROM events"


@query(
    f"""SELECT id, CASE WHEN NOT authoritative THEN 'ranked source' WHEN cancelled THEN 'cancelled' WHEN errors > 0 THEN 'errors' WHEN previous = 0 THEN NULL WHEN seen / previous < 0.9 THEN 'low coverage' END AS missing_skip,
    CASE WHEN cancelled THEN 'cancelled' WHEN errors > 0 THEN 'errors' WHEN seen = 0 THEN 'nothing admitted' WHEN previous = 0 THEN NULL WHEN seen / previous < 0.5 THEN 'low share' END AS sweep_skip FROM ({RUNS})"""
)
def c8_c9_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run why absences, and why rows outside the admitted set, must be left alone."""
    runs = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id % 7 <> 3 AS authoritative", "event_id % 11 = 5 AS cancelled", "event_id % 5 div 4 AS errors", "event_id * 13 % 100 AS seen", "event_id % 90 AS previous")
    col = [F.col(x) for x in ("authoritative", "cancelled", "errors", "seen", "previous")]
    return runs.select("id", c.missing_skip_reason(*col).alias("missing_skip"), c.sweep_skip_reason(*col[1:]).alias("sweep_skip"))


@query(
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 1 THEN 'refused' ELSE 'admitted' END AS admission, p_partkey % 8 = 0 AS is_manual, p_partkey % 9 = 0 AS claims FROM part)
    SELECT * FROM (SELECT id, CASE WHEN id % 10 = 3 THEN 'refuse' WHEN id % 4 <> 2 AND admission = 'refused' THEN 'restore' WHEN id % 4 = 2 AND admission = 'admitted' THEN 'sweep' END AS action,
        CASE WHEN id % 10 = 3 THEN 'rule ' || (id % 3) WHEN id % 4 = 2 AND admission = 'admitted' THEN 'not in the set' END AS reason FROM s WHERE NOT is_manual AND NOT claims) WHERE action IS NOT NULL"""
)
def c9_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named refusals by arrays zipped into rows (J13), restored and swept rows; what a person made or claimed stays."""
    parts = table(spark, sf_dir, "part")
    stored = parts.selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 6 = 1 THEN 'refused' ELSE 'admitted' END AS admission", "p_partkey % 8 = 0 AS is_manual", "IF(p_partkey % 9 = 0, array('admission'), array()) AS claimed")
    zipped = parts.filter("p_partkey % 10 = 3").groupBy((F.col("p_partkey") % 50).alias("_batch")).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids")).withColumn("reasons", F.transform("ids", lambda k: F.concat(F.lit("rule "), (k % 3).cast("string"))))
    refusals = zipped.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("reasons").alias("reason"))))
    return c.admissions(stored, refusals, parts.filter("p_partkey % 4 <> 2").selectExpr("p_partkey AS id"), True, "not in the set")


LINES = f"""lines AS (SELECT l_partkey AS object_id, {LINE_ID} AS place, CASE WHEN l_linenumber % 3 <> 0 THEN 'r' || (l_suppkey % 4) END AS ref, (l_orderkey * 53 + l_linenumber * 7) % 3600 / 10 - 180 AS lon,
    (l_orderkey * 29 + l_suppkey * 11) % 1600 / 10 - 80 AS lat, l_returnflag = 'R' AS missing, l_suppkey % 5 = 0 AS claimed, l_partkey AS p, l_orderkey AS o FROM lineitem)"""
PAIRED = f"""WITH {LINES}, incoming AS (SELECT object_id, place * 2 + 1 AS ordinal, place, CASE WHEN o % 11 = 0 THEN 'x' ELSE ref END AS ref, lon, lat + CASE o % 3 WHEN 1 THEN 0.00004 WHEN 2 THEN CASE WHEN o % 7 = 0 THEN 0.001 ELSE 0 END ELSE 0 END AS lat
        FROM lines WHERE o % 6 <> 5),
    candidate AS (SELECT i.object_id, i.ordinal, s.place, s.missing, {HAVERSINE.format(a="s", b="i")} AS metres FROM incoming i JOIN lines s ON s.object_id = i.object_id AND s.ref IS NOT DISTINCT FROM i.ref
        AND (s.claimed OR CASE WHEN i.ref IS NULL THEN s.lon = i.lon AND s.lat = i.lat ELSE {HAVERSINE.format(a="s", b="i")} <= 10 END)),
    best AS (SELECT DISTINCT ON (object_id, ordinal) * FROM candidate ORDER BY object_id, ordinal, missing, metres, place),
    pairs AS (SELECT DISTINCT ON (object_id, place) * FROM best ORDER BY object_id, place, ordinal)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS object_id", f"{LINE_ID} AS place", "CASE WHEN l_linenumber % 3 <> 0 THEN 'r' || (l_suppkey % 4) END AS ref", "(l_orderkey * 53 + l_linenumber * 7) % 3600 / 10 - 180 AS lon",
        "(l_orderkey * 29 + l_suppkey * 11) % 1600 / 10 - 80 AS lat", "l_returnflag = 'R' AS missing", "l_suppkey % 5 = 0 AS claimed", "l_orderkey AS o",
    )


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = "lat + CASE o % 3 WHEN 1 THEN 0.00004 WHEN 2 THEN CASE WHEN o % 7 = 0 THEN 0.001 ELSE 0 END ELSE 0 END AS lat"
    return _lines(spark, sf_dir).filter("o % 6 <> 5").selectExpr("object_id", "place * 2 + 1 AS ordinal", "CASE WHEN o % 11 = 0 THEN 'x' ELSE ref END AS ref", "lon", moved)


@query(PAIRED + " SELECT object_id, ordinal, place FROM pairs")
def c5_s11_paired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored place each incoming one is, by reference and nearness or by a claim."""
    return c.paired_places(_incoming(spark, sf_dir), _lines(spark, sf_dir)).select("object_id", "ordinal", "place")


ARMS = PAIRED + """, arms AS (SELECT i.object_id, i.ordinal, p.place, CASE WHEN p.place IS NULL THEN 'insert' WHEN p.missing THEN 'return' ELSE 'keep' END AS arm FROM incoming i LEFT JOIN pairs p ON p.object_id = i.object_id AND p.ordinal = i.ordinal
    UNION ALL SELECT object_id, NULL, place, 'withdraw' FROM lines WHERE NOT missing AND (object_id, place) NOT IN (SELECT (object_id, place) FROM pairs))"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, stored = _incoming(spark, sf_dir), _lines(spark, sf_dir)
    return c.arms(incoming, stored)


@query(ARMS + " SELECT * FROM arms")
def c6_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run does with each incoming and each stored place."""
    return _arms(spark, sf_dir).select("object_id", "ordinal", "place", "arm")


@query(ARMS + " SELECT object_id, count(*) FILTER (arm = 'insert') AS added, count(*) FILTER (arm = 'withdraw') AS withdrawn, count(*) FILTER (arm = 'return') AS returned, count(*) FILTER (arm = 'keep') AS kept FROM arms GROUP BY ALL HAVING added + withdrawn + returned > 0")
def c11_contents_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the contents of each object change; objects without a change are left out."""
    count = lambda arm, name: F.count_if(F.col("arm") == arm).alias(name)
    rows = _arms(spark, sf_dir).groupBy("object_id").agg(count("insert", "added"), count("withdraw", "withdrawn"), count("return", "returned"), count("keep", "kept"))
    return rows.filter("added + withdrawn + returned > 0")


@query(
    ARMS
    + """, w AS (SELECT a.object_id, a.place AS id, l.ref FROM arms a JOIN lines l ON l.place = a.place WHERE arm = 'withdraw'), n AS (SELECT a.object_id, a.ordinal AS id, i.ref FROM arms a JOIN incoming i ON i.object_id = a.object_id AND i.ordinal = a.ordinal WHERE arm = 'insert'),
    r AS (SELECT a.object_id, a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY object_id, ref ORDER BY id) AS rn FROM w) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY object_id, ref ORDER BY id) AS rn FROM n) b ON a.object_id = b.object_id AND a.ref IS NOT DISTINCT FROM b.ref AND a.rn = b.rn),
    l AS (SELECT a.object_id, a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY id) AS rn FROM w WHERE id NOT IN (SELECT old_id FROM r)) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY id) AS rn FROM n WHERE id NOT IN (SELECT new_id FROM r)) b ON a.object_id = b.object_id AND a.rn = b.rn)
    SELECT object_id, old_id, new_id FROM r UNION ALL SELECT object_id, old_id, new_id FROM l"""
)
def c7_w5_deferred_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrival a withdrawn place waits for: by reference, then what is left by position."""
    rows = _arms(spark, sf_dir).filter("arm IN ('withdraw', 'insert')")
    return c.deferred(rows.select("object_id", F.coalesce("ordinal", "place").alias("id"), "ref", (F.col("arm") == "insert").alias("arrived")))


@query(
    f"""WITH {LINES}, pairs AS (SELECT g.place AS ghost, min(s.place) AS survivor FROM lines g JOIN lines s ON g.object_id = s.object_id AND g.ref = s.ref AND g.missing AND NOT s.missing
        AND {HAVERSINE.format(a="g", b="s")} <= 2000000 GROUP BY ALL)
    SELECT ghost, survivor, NOT EXISTS (FROM orders WHERE o_orderkey = ghost // 1000000000 AND o_orderstatus = 'F') AS safe FROM pairs"""
)
def x19_false_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing places that an offered one of the same reference and about the same spot repeats, and whether no visit hangs on them."""
    lines = _lines(spark, sf_dir)
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    visited = lines.join(done, "o", "left_semi").select(F.col("place").alias("visited"))
    return c.false_withdrawals(lines, visited, 2_000_000)


LOG = f"""{WITH}, log AS (SELECT id % 500 AS object_id, id AS change_id, change, conflicts, waiting, significance FROM changes)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select((F.col("id") % 500).alias("object_id"), F.col("id").alias("change_id"), "change", "conflicts", "waiting", "significance")


@query(
    LOG
    + """, last AS (SELECT DISTINCT ON (object_id) * FROM log WHERE conflicts <> '' ORDER BY object_id, change_id DESC), f AS (SELECT object_id, change_id, unnest(string_split(conflicts, ',')) AS field FROM last),
    o AS (SELECT f.object_id, f.change_id, f.field, (SELECT max(event_id) FROM events WHERE event_id % 500 = f.object_id AND event_type = 'click') AS claimed_by,
        (SELECT count(*) FROM events WHERE event_id % 500 = f.object_id AND event_type = 'error') AS decided FROM f WHERE NOT (f.object_id % 7 = 2 AND f.field = 'name'))
    SELECT object_id, change_id, string_agg(field || ':' || coalesce(claimed_by::VARCHAR, '-') || ':' || decided, ';' ORDER BY field) AS proposed FROM o GROUP BY ALL ORDER BY object_id LIMIT 100"""
)
def x17_conflict_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest change of each object with conflicts: for each field who claimed it last and how often it was decided, without the fields that were declined."""
    last = first_per(_log(spark, sf_dir).filter("conflicts <> ''"), ["object_id"], [F.desc("change_id")])
    fields = last.select("object_id", "change_id", F.explode(F.split("conflicts", ",")).alias("field")).filter("NOT (object_id % 7 = 2 AND field = 'name')")
    log = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 500).alias("object_id")).agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("claimed_by"), F.count_if(F.col("event_type") == "error").alias("decided"))
    rows = fields.join(log, "object_id", "left").withColumn("_t", F.concat_ws(":", "field", F.coalesce(F.col("claimed_by").cast("string"), F.lit("-")), F.coalesce("decided", F.lit(0)).cast("string")))
    out = rows.groupBy("object_id", "change_id").agg(F.array_join(F.sort_array(F.collect_list("_t")), ";").alias("proposed"))
    return out.orderBy("object_id").limit(100)


PAGES = {
    "missing": "change = 'unchanged' AND change_id % 29 = 0", "refused": "change_id % 6 = 1 AND significance = 'major'", "kept_out": "change_id % 31 = 2", "conflicts": "conflicts <> ''",
    "arrivals": "change = 'created'", "held": "waiting <> ''", "contents": "significance = 'minor'", "withdrawn": "change_id % 37 = 5",
}


@query(
    LOG
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS page, change_id, object_id, count(*) OVER () AS total FROM log WHERE {v} ORDER BY CASE WHEN object_id % 3 = 0 THEN NULL ELSE object_id END DESC NULLS LAST, change_id LIMIT 20)" for k, v in PAGES.items())
)
def c13_x18_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight queues, each its first page with the total: the latest decision first, undecided rows last."""
    log = cut(_log(spark, sf_dir))
    order = [F.when(F.col("object_id") % 3 != 0, F.col("object_id")).desc_nulls_last(), F.asc("change_id")]
    out = None
    for name, which in PAGES.items():
        rows = log.filter(which)
        one = rows.orderBy(*order).limit(20).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select(F.lit(name).alias("page"), "change_id", "object_id", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(LOG + " SELECT field, count(*) AS waiting FROM (SELECT unnest(string_split(waiting, ',')) AS field FROM log WHERE waiting <> '') GROUP BY field")
def j14_waiting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of held changes, out of a JSON array of objects."""
    entries = F.transform(F.split("waiting", ","), lambda f: F.struct(f.alias("field"), F.lit(True).alias("held")))
    stored = _log(spark, sf_dir).filter("waiting <> ''").select(F.to_json(entries).alias("changed_fields"))
    items = stored.select(F.explode(F.from_json("changed_fields", "array<struct<field:string,held:boolean>>")).alias("f")).filter("f.held")
    return items.groupBy(F.col("f.field").alias("field")).agg(F.count("*").alias("waiting"))


@query("SELECT event_id AS id, event_id % 6 IN (0, 1, 3, 5) AS same FROM events")
def n5_deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON: turned keys, nulls and empty texts are the same; another order of an array or another value is not."""
    k = F.col("event_id").cast("string")
    left = F.concat(F.lit('{"a": '), k, F.lit(', "m": {"x": 1, "y": [1, 2]}, "e": ""}'))
    other = {
        0: ('{"m": {"y": [1, 2], "x": 1}, "a": ', "}"), 1: ('{"a": ', ', "e": null, "m": {"x": 1, "y": [1, 2]}}'), 2: ('{"a": ', ', "m": {"x": 1, "y": [2, 1]}}'),
        3: ('{"z": "", "a": ', ', "m": {"y": [1, 2], "x": 1, "w": null}}'), 4: ('{"a": 0.5, "b": ', ', "m": {"x": 1, "y": [1, 2]}}'), 5: ('{"a": ', ', "m": {"x": 1.0, "y": [1, 2]}, "e": ""}'),
    }
    right = F.lit(None).cast("string")
    for rest, (a, b) in other.items():
        right = F.when(F.col("event_id") % 6 == rest, F.concat(F.lit(a), k, F.lit(b))).otherwise(right)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), c.same_json(left, right).alias("same"))


@query(
    """SELECT c_custkey AS id, CASE WHEN total IS NULL THEN c_acctbal ELSE c_acctbal + cents / 100 END AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum((o_totalprice * 100)::BIGINT) AS cents, count(*) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) ON o_custkey = c_custkey
    WHERE NOT EXISTS (FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey = c_nationkey AND n_regionkey = 1)"""
)
def j15_update_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a join deletes are an anti-join's loss; values that a join updates are coalesced with the old."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    gone = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").filter("n_regionkey = 1")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("c_nationkey"))
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    rows = customer.join(gone, "c_nationkey", "left_anti").join(sums, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("id"), F.coalesce(F.col("c_acctbal") + F.col("cents") / 100, "c_acctbal").alias("balance"))


@query(LOG + " SELECT change_id, object_id, total > 45 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM log WHERE significance = 'major') ORDER BY change_id LIMIT 25 OFFSET 20")
def k7_change_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).filter("significance = 'major'").select("change_id", "object_id")
    return page(rows, [F.asc("change_id")], 25, 20)
