"""Polygons of regions: assignment of places, borders, areas, forms and map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import geo, polygon, svg, vector_tiles
from terrace.operators import areas, faces
from terrace.operators import hierarchy as h
from terrace.operators.steps import small
from terrace.plans.base import AROUND, BOXES, DIRECT, EDGES, POINTS, query
from terrace.sources.tables import LINE_ID, NATIONS, REGIONS, boxes, deep_tree, divisions, objects, parts_of_nations, places, points, table

UPWARD = """up AS (SELECT region_id AS node, region_id AS region FROM direct GROUP BY ALL
    UNION ALL SELECT (n_nationkey + 100000000)::BIGINT, (n_regionkey + 1000000000)::BIGINT FROM nation WHERE (n_nationkey + 100000000)::BIGINT IN (SELECT region_id FROM direct))"""


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_of_nations(spark, sf_dir).withColumnRenamed("region_id", "area")


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = places(spark, sf_dir).filter("offered").select(F.col("id").alias("place"), "lon", "lat")
    return areas.points_in_areas(offered, _polygons(spark, sf_dir)).withColumnRenamed("area", "region_id")


def _assigned(spark: SparkSession, sf_dir: str, direct: DataFrame) -> DataFrame:
    """place, region_id: also of the regions above; a tree has one way up, so no pair repeats."""
    up = h.closure(divisions(spark, sf_dir)).select(F.col("node").alias("region_id"), "ancestor")
    return direct.join(small(up.join(_polygons(spark, sf_dir).select(F.col("area").alias("region_id")), "region_id", "left_semi")), "region_id").select("place", F.col("ancestor").alias("region_id"))


@query(f"WITH {DIRECT} SELECT place, region_id FROM direct")
def s1_direct_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered places strictly inside a region's polygons."""
    return _direct(spark, sf_dir)


@query(f"WITH {DIRECT}, {UPWARD} SELECT object_id, region AS region_id, count(*) AS places FROM direct JOIN up ON node = region_id JOIN places ON id = place GROUP BY ALL")
def s3_objects_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned places with their regions' ancestors, as objects of regions with how many places tell so."""
    assigned = _assigned(spark, sf_dir, _direct(spark, sf_dir))
    of = places(spark, sf_dir).select(F.col("id").alias("place"), "object_id")
    return assigned.join(of, "place").groupBy("object_id", "region_id").agg(F.count("*").alias("places"))


@query(
    f"""WITH {DIRECT}, stored AS (SELECT id AS place, (id % 25 + 100000000)::BIGINT AS region_id, CASE WHEN id % 4 = 0 THEN 'manual' ELSE 'auto' END AS kind FROM places WHERE id % 3 = 0),
    target AS (SELECT id AS place FROM places WHERE object_id % 5 = 2),
    kept AS (SELECT place, region_id, kind FROM stored WHERE kind = 'manual' OR place NOT IN (FROM target))
    SELECT place, region_id, kind FROM kept UNION ALL SELECT place, region_id, 'auto' FROM direct d WHERE place IN (FROM target)
        AND NOT EXISTS (FROM kept k WHERE k.place = d.place AND k.region_id = d.region_id)"""
)
def s2_s4_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some objects' places anew: their automatic rows go, manual ones and other objects' stay, and what is there already is not doubled."""
    every = places(spark, sf_dir)
    stored = every.filter("id % 3 = 0").selectExpr("id AS place", f"CAST(id % 25 + {NATIONS} AS LONG) AS region_id", "CASE WHEN id % 4 = 0 THEN 'manual' ELSE 'auto' END AS kind")
    target = every.filter("object_id % 5 = 2").select(F.col("id").alias("place"))
    marked = stored.join(target.withColumn("_anew", F.lit(True)), "place", "left").filter("kind = 'manual' OR _anew IS NULL").drop("_anew")
    fresh = _direct(spark, sf_dir).join(target, "place", "left_semi").join(marked, ["place", "region_id"], "left_anti")
    return marked.unionByName(fresh.withColumn("kind", F.lit("auto")))


NEAR = 300_000


@query(
    f"""WITH {DIRECT}, objects AS (SELECT p_partkey AS id, p_partkey * 37 % 3600 / 10 - 180 AS lon, p_partkey * 91 % 1700 / 10 - 85 AS lat FROM part),
    held AS (SELECT id, min(region_id) AS area FROM (SELECT id, region_id, part FROM objects JOIN edges ON true GROUP BY id, lon, lat, region_id, part HAVING
        sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
        AND NOT bool_or((x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))) GROUP BY id),
    flat AS (SELECT id, region_id, (x1 - lon + turn) * cos(radians(lat)) * 111320.0 AS ax, (y1 - lat) * 110540.0 AS ay, (x2 - lon + turn) * cos(radians(lat)) * 111320.0 AS bx, (y2 - lat) * 110540.0 AS b_y
        FROM objects, edges, (VALUES (-360.0::DOUBLE), (0.0), (360.0)) turns(turn) WHERE id NOT IN (SELECT id FROM held)),
    near AS (SELECT id, region_id, greatest(0.0, least(1.0, coalesce(-(ax * (bx - ax) + ay * (b_y - ay)) / nullif(pow(bx - ax, 2) + pow(b_y - ay, 2), 0), 0.0))) AS t, * FROM flat),
    far AS (SELECT id, region_id, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2))) AS metres FROM near GROUP BY ALL HAVING metres <= {NEAR})
    SELECT id AS place, area FROM held UNION ALL SELECT id, arg_min(region_id, (metres, region_id)) FROM far GROUP BY id"""
)
def s10_marker_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each marker the polygon that holds it, else the nearest within some way, over the antimeridian too."""
    marks = objects(spark, sf_dir).select(F.col("id").alias("place"), "lon", "lat")
    return areas.containing_or_nearest(marks, _polygons(spark, sf_dir), NEAR)


SQUARES = """squares AS (SELECT n_nationkey::BIGINT AS id, n_nationkey % 5 * 2.0::DOUBLE + CASE WHEN n_nationkey % 7 = 3 THEN 0.5 ELSE 0 END AS w, n_nationkey // 5 * 2.0::DOUBLE AS s FROM nation)"""


def _squares(spark: SparkSession, sf_dir: str, side: float = 2.0) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    w, s = (key % 5) * 2.0 + F.when(key % 7 == 3, 0.5).otherwise(0.0), F.floor(key / 5) * 2.0
    ring = F.array(*[F.struct((w + x).alias("lon"), (s + y).alias("lat")) for x, y in ((0.0, 0.0), (side, 0.0), (side, side), (0.0, side), (0.0, 0.0))])
    return table(spark, sf_dir, "nation").select(key.alias("area"), F.array(ring).alias("rings"))


@query(f"WITH {SQUARES} SELECT a.id AS a, b.id AS b FROM squares a JOIN squares b ON a.id < b.id AND abs(a.w - b.w) <= 2.0001 AND abs(a.s - b.s) <= 2.0001")
def s5_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that touch, overlap at their borders or are a ten-thousandth of a degree apart."""
    return areas.adjacent(_squares(spark, sf_dir), 0.0001)


@query(
    f"""WITH {SQUARES}, p AS (SELECT a.id AS a, b.id AS b, greatest(0.0, least(a.w + 2, b.w + 3) - greatest(a.w, b.w + 1)) * greatest(0.0, least(a.s + 2, b.s + 3) - greatest(a.s, b.s + 1)) / 4 AS ratio FROM squares a, squares b)
    SELECT a, b, round(ratio, 5) AS ratio FROM p WHERE ratio > 0"""
)
def s6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each area that another set's areas cover."""
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["lon"] + 1).alias("lon"), (p["lat"] + 1).alias("lat"))))
    own = _squares(spark, sf_dir)
    return areas.overlapping(own, own.withColumn("rings", moved)).select("a", "b", F.round("ratio", 5).alias("ratio"))


@query(
    f"""WITH {SQUARES}, boxes AS (SELECT n_nationkey::BIGINT AS id, n_nationkey % 5 * 2.0::DOUBLE + 1 AS w, n_nationkey // 5 * 2.0::DOUBLE AS s, n_nationkey % 3 AS g FROM nation),
    p AS (SELECT a.id, g, sum(greatest(0.0, least(a.w + 2, b.w + 2) - greatest(a.w, b.w)) * greatest(0.0, least(a.s + 2, b.s + 2) - greatest(a.s, b.s))) / 4 AS ratio FROM squares a, boxes b GROUP BY ALL)
    SELECT id, arg_max(g, (ratio, -g))::BIGINT AS group_id, round(max(ratio), 4) AS ratio FROM p WHERE ratio > 0.005 GROUP BY id"""
)
def x6_best_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each division the shape group that covers most of it, above half a percent (X5); the least of equals."""
    key = F.col("n_nationkey").cast("long")
    w, s = (key % 5) * 2.0 + 1, F.floor(key / 5) * 2.0
    ring = F.array(*[F.struct((w + x).alias("lon"), (s + y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))])
    shapes = table(spark, sf_dir, "nation").select((key % 3).alias("area"), F.array(ring).alias("rings")).groupBy("area").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    share = areas.overlapping(_squares(spark, sf_dir), shapes).filter("ratio > 0.005")
    best = share.groupBy("a").agg(F.max(F.struct("ratio", (-F.col("b")).alias("b"))).alias("r"))
    return best.select(F.col("a").alias("id"), (-F.col("r.b")).alias("group_id"), F.round("r.ratio", 4).alias("ratio"))


COASTS = """coasts AS (SELECT n_nationkey::BIGINT AS id, n_nationkey * 7 % 120 - 60.0::DOUBLE AS s, n_nationkey * 14 - 180.0::DOUBLE AS w, 0.02 + 0.03 * (n_nationkey % 4) AS d FROM nation),
    sides AS (SELECT id, ring, w + dx1 * u AS x1, s + dy1 * v AS y1, w + dx2 * u AS x2, s + dy2 * v AS y2 FROM
        (SELECT *, CASE ring WHEN 0 THEN 20.0 WHEN 1 THEN d ELSE 2.0 END AS u, CASE ring WHEN 0 THEN 20.0 WHEN 1 THEN d ELSE 0.001 END AS v FROM coasts, range(3) r(ring)),
        (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) q(dx1, dy1, dx2, dy2)),
    rings AS (SELECT id, ring, abs(sum(radians(x2 - x1) * (2.0 + sin(radians(y1)) + sin(radians(y2))))) * 6371000.0 * 6371000.0 / 2 / 1e6 AS km2,
        sum(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))) / 1000 AS km FROM sides GROUP BY ALL)"""


def _coasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 20 degrees with a hole that is small for some, and a sliver."""
    key = F.col("n_nationkey").cast("long")
    w, s, d = (key * 14 - 180).cast("double"), (key * 7 % 120 - 60).cast("double"), F.lit(0.02) + F.lit(0.03) * (key % 4)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    ring = lambda u, v: F.array(*[F.struct((w + x * u).alias("lon"), (s + y * v).alias("lat")) for x, y in corners])
    return table(spark, sf_dir, "nation").select(key.alias("id"), F.array(ring(F.lit(20.0), F.lit(20.0)), ring(d, d), ring(F.lit(2.0), F.lit(0.001))).alias("rings"))


@query(f"WITH {COASTS} SELECT id, count(*) FILTER (ring = 0 OR (km2 > 10 AND km / sqrt(km2) < 25)) AS n_rings, round(sum(km2) FILTER (ring > 0 AND NOT (km2 > 10 AND km / sqrt(km2) < 25)), 4) AS filled FROM rings GROUP BY id")
def s12_filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes up to ten square kilometres and slivers are filled: rings that stay, and the area of the others."""
    rings = F.col("rings")
    filled = F.aggregate(F.filter(rings, lambda r: ~F.array_contains(polygon.kept_rings(rings), r)), F.lit(0.0), lambda t, r: t + polygon.sphere_area(r) / 1e6)
    gone = F.when(F.size(polygon.kept_rings(rings)) < F.size(rings), filled)
    return _coasts(spark, sf_dir).select("id", F.size(polygon.kept_rings(rings)).cast("long").alias("n_rings"), F.round(gone, 4).alias("filled"))


@query(f"WITH {COASTS} SELECT id, 15::BIGINT AS n_points, 3::BIGINT AS n_rings, round(sum(km2), 3) AS km2, round(sum(km), 3) AS km FROM rings GROUP BY id")
def s21_form_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, rings, and the sums of their areas and lengths."""
    total = lambda of, per: F.round(F.aggregate("rings", F.lit(0.0), lambda t, r: t + of(r) / per), 3)
    return _coasts(spark, sf_dir).select("id", F.size(F.flatten("rings")).cast("long").alias("n_points"), F.size("rings").cast("long").alias("n_rings"), total(polygon.sphere_area, 1e6).alias("km2"), total(polygon.length, 1000).alias("km"))


@query(
    f"""WITH {EDGES}, m AS (SELECT region_id, part, (min(y1) + max(y1)) / 2 AS lat FROM edges GROUP BY ALL),
    c AS (SELECT e.region_id, e.part, lat, (x2 - x1) * (lat - y1) / (y2 - y1) + x1 AS x FROM edges e JOIN m USING (region_id, part) WHERE (y1 > lat) <> (y2 > lat)),
    n AS (SELECT *, row_number() OVER (PARTITION BY region_id, part ORDER BY x) AS rn, lead(x) OVER (PARTITION BY region_id, part ORDER BY x) AS nx FROM c)
    SELECT region_id, part, round(arg_max(x + (nx - x) / 2, (nx - x, x)), 6) AS lon, round(any_value(lat), 6) AS lat FROM n WHERE rn % 2 = 1 GROUP BY ALL"""
)
def s19_s20_points_on_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside each part of a region: its anchor, and what hulls are made of."""
    at = parts_of_nations(spark, sf_dir).select("region_id", "part", polygon.point_on_surface(F.col("rings")).alias("p"))
    return at.select("region_id", "part", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(
    f"""WITH {EDGES}, r AS (SELECT region_id, part, ring, count(*) + 1 AS n, sum(x1 * y2 - x2 * y1) / 2 AS area FROM edges GROUP BY ALL)
    SELECT region_id, part, count(*) AS n_rings, sum(n)::BIGINT AS n_points, round(sum(CASE WHEN ring = 0 THEN abs(area) ELSE -abs(area) END), 6) AS area FROM r GROUP BY ALL"""
)
def s16_made_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that are open, turned or have repeated points become valid, and rings without an area go."""
    rings = F.transform("rings", lambda r: F.when(F.col("region_id") % 2 == 0, F.reverse(F.slice(r, F.lit(1), F.size(r) - 1))).otherwise(F.concat(F.slice(r, 1, 1), r)))
    flat = F.transform(F.slice("rings", 1, 1), lambda r: F.slice(r, 1, 2))
    made = parts_of_nations(spark, sf_dir).withColumn("rings", polygon.valid(F.concat(rings, flat)))
    area = F.aggregate("rings", F.lit(0.0), lambda t, r: t + polygon.signed_area(r))
    return made.select("region_id", "part", F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_points"), F.round(area, 6).alias("area"))


@query(
    f"""WITH {EDGES}, r AS (SELECT region_id, part, ring, '[' || string_agg('[' || x1 || ',' || y1 || ']', ',' ORDER BY k) || ',' || any_value('[' || x1 || ',' || y1 || ']') FILTER (k = 0) || ']' AS t FROM edges GROUP BY ALL)
    SELECT region_id, part, '{{"type":"Polygon","coordinates":[' || string_agg(t, ',' ORDER BY ring) || ']}}' AS json, count(*) AS n_rings FROM r GROUP BY ALL"""
)
def io15_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To text, and back from it."""
    written = parts_of_nations(spark, sf_dir).select("region_id", "part", polygon.geojson(F.col("rings")).alias("json"))
    return written.withColumn("n_rings", F.size(polygon.from_geojson(F.col("json"))).cast("long"))


@query(f"WITH {EDGES} SELECT region_id, count(DISTINCT part) AS parts, count(DISTINCT part * 10 + ring) AS n_rings, count(*) + count(DISTINCT part * 10 + ring) AS n_points FROM edges GROUP BY region_id")
def io15_multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with all their parts to text, and back from it."""
    parts = parts_of_nations(spark, sf_dir).groupBy("region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"]).alias("parts"))
    back = parts.select("region_id", polygon.parts_from_geojson(polygon.parts_geojson(F.col("parts"))).alias("p"))
    return back.select("region_id", F.size("p").cast("long").alias("parts"), F.size(F.flatten("p")).cast("long").alias("n_rings"), F.size(F.flatten(F.flatten("p"))).cast("long").alias("n_points"))


@query(
    f"""WITH {EDGES}, r AS (SELECT region_id, part, ring, 'M ' || string_agg(format('{{:.3f}} {{:.3f}}', x1, 0.0 - y1), ' L ' ORDER BY k) || ' Z' AS t FROM edges GROUP BY ALL)
    SELECT region_id, part, string_agg(t, ' ' ORDER BY ring) AS path FROM r GROUP BY ALL"""
)
def io16_svg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_of_nations(spark, sf_dir).select("region_id", "part", polygon.svg_path(F.col("rings")).alias("path"))


@query(
    f"""WITH {EDGES}, d AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS d FROM edges), l AS (SELECT *, sum(d) OVER (PARTITION BY region_id, part, ring ORDER BY k) AS cum, sum(d) OVER (PARTITION BY region_id, part, ring) AS total FROM d),
    s AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY region_id, part, ring ORDER BY k), 0) AS was, row_number() OVER (PARTITION BY region_id, part, ring ORDER BY k DESC) = 1 AS last FROM l), t AS (SELECT * FROM range(9) j(j))
    SELECT region_id, part, ring, j, round(x1 + CASE WHEN j = 8 THEN 1 ELSE (j * total / 8 - was) / d END * (x2 - x1), 4) + 0.0 AS lon, round(y1 + CASE WHEN j = 8 THEN 1 ELSE (j * total / 8 - was) / d END * (y2 - y1), 4) + 0.0 AS lat
    FROM s JOIN t ON CASE WHEN j = 8 THEN last ELSE j * total / 8 >= was AND j * total / 8 < cum END"""
)
def io16_resampled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths read back, each ring as nine points in equal steps along it."""
    paths = parts_of_nations(spark, sf_dir).select("region_id", "part", polygon.svg_path(F.col("rings")).alias("path"))
    lines = paths.select("region_id", "part", svg.resampled(svg.from_path(F.col("path")), 9).alias("rings"))
    at = lines.select("region_id", "part", F.posexplode("rings").alias("ring", "line")).select("region_id", "part", "ring", F.posexplode("line").alias("j", "p"))
    return at.select("region_id", "part", "ring", F.col("j").cast("long").alias("j"), (F.round("p.lon", 4) + 0.0).alias("lon"), (F.round("p.lat", 4) + 0.0).alias("lat"))


SPREAD = """spread AS (SELECT n_nationkey, n_regionkey, ((n_nationkey * 14 + k * 9) % 360) - 180.0::DOUBLE AS lon, n_nationkey * 7 % 120 - 60.0::DOUBLE + k AS lat FROM nation, range(6) t(k) WHERE k <= n_nationkey % 6)"""


@query(
    f"""WITH {SPREAD}, b AS (SELECT n_nationkey, n_regionkey, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n, min((lon + 360) % 360) AS sw, max((lon + 360) % 360) AS se FROM spread GROUP BY ALL),
    own AS (SELECT n_regionkey, (n_nationkey + 100000000)::BIGINT AS id, CASE WHEN se - sw < e - w THEN CASE WHEN sw > 180 THEN sw - 360 ELSE sw END ELSE w END AS west, s AS south,
        CASE WHEN se - sw < e - w THEN CASE WHEN se > 180 THEN se - 360 ELSE se END ELSE e END AS east, n AS north,
        CASE WHEN se - sw < e - w THEN CASE WHEN (sw + se) / 2 > 180 THEN (sw + se) / 2 - 360 ELSE (sw + se) / 2 END ELSE (w + e) / 2 END AS lon FROM b),
    up AS (SELECT n_regionkey, min(w) AS w, max(e) AS e, min(s) AS s, max(n) AS n, min(sw) AS sw, max(se) AS se FROM b GROUP BY ALL),
    kids AS (SELECT n_regionkey, min(CASE WHEN west < 0 THEN west + 360 ELSE west END) AS cw, max(CASE WHEN east < 0 THEN east + 360 ELSE east END) AS ce FROM own GROUP BY ALL),
    above AS (SELECT (n_regionkey + 1000000000)::BIGINT AS id, CASE WHEN e - w > 350 THEN CASE WHEN cw > 180 THEN cw - 360 ELSE cw END WHEN se - sw < e - w THEN CASE WHEN sw > 180 THEN sw - 360 ELSE sw END ELSE w END AS west, s AS south,
        CASE WHEN e - w > 350 THEN CASE WHEN ce > 180 THEN ce - 360 ELSE ce END WHEN se - sw < e - w THEN CASE WHEN se > 180 THEN se - 360 ELSE se END ELSE e END AS east, n AS north,
        CASE WHEN e - w > 350 THEN CASE WHEN (cw + ce) / 2 > 180 THEN (cw + ce) / 2 - 360 ELSE (cw + ce) / 2 END
            WHEN se - sw < e - w THEN CASE WHEN (sw + se) / 2 > 180 THEN (sw + se) / 2 - 360 ELSE (sw + se) / 2 END ELSE (w + e) / 2 END AS lon FROM up JOIN kids USING (n_regionkey))
    SELECT id, west, south, east, north, lon, (south + north) / 2 AS lat FROM own UNION ALL SELECT id, west, south, east, north, lon, (south + north) / 2 FROM above"""
)
def m4_focus_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of nations and of the regions above, which look to their children where they span the globe; leaves first."""
    nation = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 6)))
    spread = nation.select("n_nationkey", "n_regionkey", ((F.col("n_nationkey") * 14 + F.col("k") * 9) % 360 - 180).cast("double").alias("lon"), (F.col("n_nationkey") * 7 % 120 - 60 + F.col("k")).cast("double").alias("lat"))
    shifted = F.pmod(F.col("lon") + 360, F.lit(360.0))
    bounds = [F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min(shifted).alias("sw"), F.max(shifted).alias("se")]

    def seen(rows: DataFrame) -> DataFrame:
        west, east, lon = polygon.focus(*[F.col(c) for c in ("w", "e", "sw", "se", "cw", "ce")])
        return rows.withColumn("west", west).withColumn("east", east).withColumn("lon", lon)

    none = F.lit(None).cast("double")
    own = seen(spread.groupBy("n_nationkey", "n_regionkey").agg(*bounds).withColumn("cw", none).withColumn("ce", none))
    turned = lambda c: F.when(F.col(c) < 0, F.col(c) + 360).otherwise(F.col(c))
    kids = own.groupBy("n_regionkey").agg(F.min(turned("west")).alias("cw"), F.max(turned("east")).alias("ce"))
    above = seen(spread.groupBy("n_regionkey").agg(*bounds).join(kids, "n_regionkey"))
    out = lambda rows, key, offset: rows.select((F.col(key) + F.lit(offset)).cast("long").alias("id"), "west", "south", "east", "north", "lon", ((F.col("south") + F.col("north")) / 2).alias("lat"))
    return out(own, "n_nationkey", NATIONS).unionByName(out(above, "n_regionkey", REGIONS))


@query(
    f"""WITH {BOXES}, {POINTS}, d AS (SELECT p.id AS place, b.id AS area, sqrt(pow(greatest(0.0, west - lon, lon - east), 2) + pow(greatest(0.0, south - lat, lat - north), 2)) AS gap,
        sqrt(pow((west + east) / 2 - lon, 2) + pow((south + north) / 2 - lat, 2)) AS best FROM points p, boxes b),
    n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY gap, area) AS rn FROM d)
    SELECT place, arg_min(area, (best, area)) AS area, round(min(best), 6) AS best FROM n WHERE rn <= 15 GROUP BY place"""
)
def k4_j9_nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fifteen regions with the nearest boxes the one with the nearest centre."""
    centre = F.sqrt(F.pow((F.col("west") + F.col("east")) / 2 - F.col("lon"), F.lit(2)) + F.pow((F.col("south") + F.col("north")) / 2 - F.col("lat"), F.lit(2)))
    found = areas.nearest_two_stage(points(spark, sf_dir).withColumnRenamed("id", "place"), boxes(spark, sf_dir).withColumnRenamed("id", "area").drop("name"), centre)
    return found.select("place", "area", F.round("best", 6).alias("best"))


#: Tiles: which stored form a zoom shows, and whose boxes meet the tile. Forms are stored for some regions only.
LOD = "CASE WHEN z <= 2 AND id % 3 <> 0 THEN 'overview' WHEN z <= 4 AND id % 4 <> 0 THEN 'low' WHEN z <= 8 AND id % 5 <> 0 THEN 'medium' ELSE 'full' END"
TILE_Y = "greatest(0, least(pow(2, z) - 1, floor((1 - ln(tan(pi() / 4 + radians(greatest(-85.06, least(85.06, {v}))) / 2)) / pi()) / 2 * pow(2, z))))::BIGINT"
TILE_X = "greatest(0, least(pow(2, z) - 1, floor(({v} + 180) / 360 * pow(2, z))))::BIGINT"
SHOWN = f"""shown AS (SELECT (n_nationkey + 100000000)::BIGINT AS id, (n_regionkey + 1000000000)::BIGINT AS parent_id, n_nationkey % 3 = 1 AS uses_hull, n_nationkey * 14 - 180 AS west, n_nationkey * 7 % 120 - 60 AS south,
        n_nationkey * 14 - 160 AS east, n_nationkey * 7 % 120 - 35 AS north, n_nationkey % 4 <> 0 AS has_children FROM nation
    UNION ALL SELECT (r_regionkey + 1000000000)::BIGINT, NULL, false, min(n_nationkey * 14 - 180), min(n_nationkey * 7 % 120 - 60), max(n_nationkey * 14 - 160), max(n_nationkey * 7 % 120 - 35), true
        FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
    tiles AS (SELECT z, unnest(range({TILE_X.format(v="west")}, {TILE_X.format(v="east")} + 1)) AS x, *  EXCLUDE (z) FROM shown, (VALUES (1::BIGINT), (3), (6)) zooms(z)),
    placed AS (SELECT *, unnest(range({TILE_Y.format(v="north")}, {TILE_Y.format(v="south")} + 1)) AS y FROM tiles)"""
TILE = f"WITH {SHOWN} SELECT z, x, y, id, {LOD} AS form, has_children AS has_subregions, uses_hull AS using_hull FROM placed WHERE "


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with boxes: id, parent_id, uses_hull, west to north, has_children."""
    low = boxes(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey"), "id")
    own = low.select((F.col("id") + NATIONS).alias("id"), (F.col("n_regionkey") + F.lit(REGIONS)).cast("long").alias("parent_id"), (F.col("id") % 3 == 1).alias("uses_hull"), "west", "south", "east", "north")
    above = own.groupBy(F.col("parent_id").alias("id")).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    above = above.select("id", F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("uses_hull"), "west", "south", "east", "north")
    parents = divisions(spark, sf_dir).select(F.col("parent_id").alias("id")).filter(f"id >= {REGIONS} OR id % 4 <> 0").distinct().withColumn("has_children", F.lit(True))
    return own.unionByName(above).join(parents, "id", "left").fillna(False, ["has_children"])


def _tiles(spark: SparkSession, sf_dir: str, which: str, real: bool = False) -> DataFrame:
    """Rows of tiles for the regions that a condition picks; real: coastlines, which have no overview form, in place of hulls."""
    made = areas.tiles(_shown(spark, sf_dir).filter(which), [1, 3, 6])
    held = lambda name, k: F.when(F.col("id") % k != 0, name)
    form = geo.detail(F.col("z"), F.lit(None) if real else held("overview", 3), held("low", 4), held("medium", 5), F.lit("full"))
    return made.select("z", "x", "y", "id", form.alias("form"), F.col("has_children").alias("has_subregions"), F.col("uses_hull").alias("using_hull"))


@query(TILE + "parent_id IS NULL")
def v1_root_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions without a parent on each tile, in the stored form that its zoom shows (V3 takes divisions by the same plan)."""
    return _tiles(spark, sf_dir, "parent_id IS NULL")


@query(TILE + "parent_id = 1000000002")
def v2_v4_child_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of one region or division; a null parent would show none."""
    return _tiles(spark, sf_dir, "parent_id = 1000000002")


@query(TILE.replace(LOD, LOD.replace("WHEN z <= 2 AND id % 3 <> 0 THEN 'overview' ", "")) + "uses_hull")
def v5_island_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions drawn as hulls, with their real coastlines."""
    return _tiles(spark, sf_dir, "uses_hull", real=True)


@query(TILE + "NOT has_children")
def v6_leaf_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir, "NOT has_children")


@query(
    f"""WITH {EDGES}, c AS (SELECT region_id, count(DISTINCT part) AS parts, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edges GROUP BY ALL),
    m AS (SELECT {LINE_ID} AS id, (l_partkey % 25 + 100000000)::BIGINT AS region_id, l_suppkey % 4 = 0 AS drawn FROM lineitem)
    SELECT id, region_id, CASE WHEN drawn THEN 'drawn' ELSE 'stored' END AS source, drawn AS is_partial, CASE WHEN region_id % 2 = 0 AND parts > 1 THEN 'hull' ELSE 'real' END AS render,
        CASE WHEN e - w > 19 THEN '[' || w || ',' || s || ',' || e || ',' || n || ']' END AS focus FROM m JOIN c USING (region_id)"""
)
def f5_f8_effective_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with the form that counts for them (their own drawing, else the division's), what a map draws, and the view as a JSON array."""
    b = {k: F.min(v) if k in ("west", "south") else F.max(v) for k, v in polygon.box(F.col("rings")).items()}
    forms = parts_of_nations(spark, sf_dir).groupBy("region_id").agg(F.countDistinct("part").alias("parts"), *[v.alias(k) for k, v in b.items()])
    members = table(spark, sf_dir, "lineitem").selectExpr(f"{LINE_ID} AS id", f"CAST(l_partkey % 25 + {NATIONS} AS LONG) AS region_id", "l_suppkey % 4 = 0 AS drawn")
    focus = F.when(F.col("east") - F.col("west") > 19, F.to_json(F.array("west", "south", "east", "north")))
    return members.join(small(forms), "region_id").select("id", "region_id", F.when(F.col("drawn"), "drawn").otherwise("stored").alias("source"), F.col("drawn").alias("is_partial"), F.when((F.col("region_id") % 2 == 0) & (F.col("parts") > 1), "hull").otherwise("real").alias("render"), focus.alias("focus"))


@query(
    """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 3 THEN c_custkey // 3 END AS parent_id FROM customer),
    c AS (SELECT o_custkey % 7 AS region, CASE WHEN o_custkey > 20 THEN o_custkey // 2 ELSE o_custkey END AS division, max(o_orderkey % 100) / 100 AS coverage FROM orders GROUP BY ALL HAVING coverage >= 0.9)
    , """
    + """closure AS (WITH RECURSIVE up AS (SELECT id AS node, parent_id AS ancestor FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT up.node, t.parent_id FROM up JOIN t ON t.id = up.ancestor WHERE t.parent_id IS NOT NULL) FROM up)
    SELECT region, division, coverage FROM c WHERE NOT EXISTS (FROM closure JOIN c d ON d.division = ancestor AND d.region = c.region WHERE node = c.division)"""
)
def s7_covering_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topmost divisions that a region's shape covers well enough."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey % 7 AS region", "CASE WHEN o_custkey > 20 THEN o_custkey div 2 ELSE o_custkey END AS division", "o_orderkey % 100 AS c")
    candidates = orders.groupBy("region", "division").agg((F.max("c") / 100).alias("coverage"))
    return areas.covering(candidates, h.closure(deep_tree(spark, sf_dir)), 0.9).select("region", "division", "coverage")


#: Halves of degrees: squares' corners are multiples of these, so a set of cells is an exact area.
CELLS = """SELECT {key}, unnest(range((2 * w)::INT, (2 * w + 2 * {side})::INT)) AS cx, s FROM {table}"""
COVERED = f"""{SQUARES}, strips AS ({CELLS.format(key="id", side=2, table="squares")}), cells AS (SELECT id, cx, unnest(range((2 * s)::INT, (2 * s + 4)::INT)) AS cy FROM strips),
    wide AS ({CELLS.format(key="id", side=3, table="(FROM squares WHERE id % 4 = 0)")}), covered AS (SELECT DISTINCT cx, unnest(range((2 * s)::INT, (2 * s + 6)::INT)) AS cy FROM wide)"""


@query(
    f"""WITH {COVERED}, g AS (SELECT id, count(*) FILTER (c.cx IS NULL) / 16 AS open_share FROM cells LEFT JOIN covered c USING (cx, cy) GROUP BY id)
    SELECT id, round(open_share, 5) AS open_share FROM g WHERE open_share > 0.3 ORDER BY open_share DESC, id LIMIT 30"""
)
def s8_gaps_of_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions of which more than three tenths lie outside all that is covered, the largest thirty; covers overlap each other."""
    covers = _squares(spark, sf_dir, 3.0).filter("area % 4 = 0")
    shares = faces.outside_area(_squares(spark, sf_dir), covers).select(F.col("area").alias("id"), F.round(F.col("open") / F.col("whole"), 5).alias("open_share"))
    return shares.filter("open_share > 0.3").orderBy(F.desc("open_share"), "id").limit(30)


@query(
    f"""WITH {SQUARES}, strips AS (SELECT n_regionkey::BIGINT AS region, unnest(range((2 * w)::INT, (2 * w + 4)::INT)) AS cx, s FROM squares JOIN nation ON n_nationkey = id),
    cells AS (SELECT DISTINCT region, cx, unnest(range((2 * s)::INT, (2 * s + 4)::INT)) AS cy FROM strips),
    sides AS (SELECT region, cx + dx AS cx, cy + dy AS cy FROM cells, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)), outer_ AS (SELECT region, count(*) AS n FROM sides ANTI JOIN cells USING (region, cx, cy) GROUP BY region)
    SELECT region, count(*) * 0.25::DOUBLE AS area, any_value(n) * 0.5::DOUBLE AS border FROM cells JOIN outer_ USING (region) GROUP BY region"""
)
def s13_united_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's squares as one form with rings, some of which share only part of a border: its area and the length of its borders."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("owner"), F.col("n_regionkey").cast("long").alias("grp"))
    forms = faces.united(_squares(spark, sf_dir).withColumnRenamed("area", "owner").join(nation, "owner"))
    across = lambda e: F.sqrt(F.pow(e["b"]["lon"] - e["a"]["lon"], F.lit(2)) + F.pow(e["b"]["lat"] - e["a"]["lat"], F.lit(2)))
    sizes = forms.select("grp", F.aggregate("rings", F.lit(0.0), lambda t, r: t + polygon.signed_area(r)).alias("area"), F.aggregate(polygon.edges(F.col("rings")), F.lit(0.0), lambda t, e: t + across(e)).alias("border"))
    return sizes.groupBy(F.col("grp").alias("region")).agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("border"), 6).alias("border"))


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS id, 1.0::DOUBLE + n_nationkey % 4 AS d FROM nation)
    SELECT id, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS parts, CASE id % 3 WHEN 0 THEN d * d / 2 WHEN 1 THEN d * d - d * d / 4 ELSE 2 * d * d - d * d / 2 END AS area FROM n"""
)
def s16_repaired_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow-ties, squares with a ring written twice in them, and squares that overlap as rings of one form: faces by the even-odd rule."""
    n = F.col("n_nationkey").cast("long")
    d = F.lit(1.0) + n % 4
    ring = lambda points: F.array(*[F.struct((n * 14 - 180 + d * x).alias("lon"), (n * 7 % 120 - 60 + d * y).alias("lat")) for x, y in points])
    square = lambda x, y, k: ring([(x, y), (x + k, y), (x + k, y + k), (x, y + k), (x, y)])
    bow, pair = F.array(ring([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)])), F.array(square(0, 0, 1), square(0.5, 0.5, 1))
    held = F.array(square(0, 0, 1), square(0.25, 0.25, 0.5), square(0.5, 0.5, 0.1), square(0.5, 0.5, 0.1))
    made = faces.repaired(table(spark, sf_dir, "nation").select(n.alias("grp"), F.when(n % 3 == 0, bow).when(n % 3 == 1, held).otherwise(pair).alias("rings")))
    area = F.aggregate("rings", F.lit(0.0), lambda t, r: t + polygon.signed_area(r))
    return made.groupBy(F.col("grp").alias("id")).agg(F.count("*").alias("parts"), F.round(F.sum(area), 6).alias("area"))


@query(
    f"""WITH {POINTS}, {EDGES}, held AS (SELECT id, min(region_id) AS area FROM (SELECT id, region_id, part FROM points JOIN edges ON true GROUP BY id, lon, lat, region_id, part HAVING {AROUND}) GROUP BY id),
    flat AS (SELECT id, region_id, (x1 - lon + turn) * cos(radians(lat)) * 111320.0 AS ax, (y1 - lat) * 110540.0 AS ay, (x2 - lon + turn) * cos(radians(lat)) * 111320.0 AS bx, (y2 - lat) * 110540.0 AS b_y
        FROM points, edges, (VALUES (-360.0::DOUBLE), (0.0), (360.0)) turns(turn) WHERE id NOT IN (SELECT id FROM held)),
    near AS (SELECT id, region_id, greatest(0.0, least(1.0, coalesce(-(ax * (bx - ax) + ay * (b_y - ay)) / nullif(pow(bx - ax, 2) + pow(b_y - ay, 2), 0), 0.0))) AS t, * FROM flat),
    far AS (SELECT id, region_id, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2))) AS metres FROM near GROUP BY ALL)
    SELECT id AS place, area, 0.0::DOUBLE AS km FROM held UNION ALL SELECT id, arg_min(region_id, (metres, region_id)), round(min(metres) / 1000, 3) FROM far GROUP BY id"""
)
def s9_nearest_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every point the region whose border is nearest, however far; 0 within it."""
    found = areas.nearest_borders(points(spark, sf_dir).withColumnRenamed("id", "place"), _polygons(spark, sf_dir), 500_000.0)
    return found.select("place", "area", F.round(F.col("metres") / 1000, 3).alias("km"))


@query(
    f"""WITH {SQUARES}, g AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS region, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
    sides AS (SELECT region, x + dx AS x, y + dy AS y FROM g, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)), o AS (SELECT region, count(*) * 2 AS n FROM sides ANTI JOIN g USING (region, x, y) GROUP BY region)
    SELECT region, count(*) * 4 AS area, any_value(n)::BIGINT AS border FROM g JOIN o USING (region) GROUP BY region"""
)
def s12_region_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of squares drawn with gaps of up to a thousandth of a degree: snapped, united and freed of holes, as whole degrees."""
    n = F.col("n_nationkey").cast("long")
    off = lambda k: ((n * 7 + k) % 5 - 2) * 0.00015
    w, s = (n % 5) * 2.0, F.floor(n / 5) * 2.0
    ring = F.array(*[F.struct((w + x + off(k % 4)).alias("lon"), (s + y + off(k % 4 + 1)).alias("lat")) for k, (x, y) in enumerate(((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)))])
    drawn = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("grp"), n.alias("owner"), F.array(ring).alias("rings"))
    forms = faces.region_forms(drawn, tolerance=0.001)
    across = lambda e: F.sqrt(F.pow(e["b"]["lon"] - e["a"]["lon"], F.lit(2)) + F.pow(e["b"]["lat"] - e["a"]["lat"], F.lit(2)))
    sizes = forms.select("grp", F.aggregate("rings", F.lit(0.0), lambda t, r: t + polygon.signed_area(r)).alias("area"), F.aggregate(polygon.edges(F.col("rings")), F.lit(0.0), lambda t, e: t + across(e)).alias("border"))
    return sizes.groupBy(F.col("grp").alias("region")).agg(F.round(F.sum("area")).cast("long").alias("area"), F.round(F.sum("border")).cast("long").alias("border"))


ISLES = """isles AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS g, i, n_nationkey % 5 * 3.0::DOUBLE + i * 0.5 AS w, n_nationkey // 5 * 3.0::DOUBLE + i * 0.5 AS s, 0.02 + 0.3 * (n_nationkey % 3) AS d, n_nationkey * 5 % 12 AS k FROM nation, range(12) r(i) WHERE i <= n_nationkey * 5 % 12)"""


@query(
    f"""WITH {ISLES}, z AS (SELECT id, count(*) AS n, sum(radians(d) * (sin(radians(s + d)) - sin(radians(s)))) * 6371000.0 * 6371000.0 / 1e6 AS km2, count(*) * any_value(d * d) / any_value(d * d + 2 * d * k * 0.5) AS fill FROM isles GROUP BY id),
    met AS (SELECT DISTINCT a.id FROM isles a JOIN isles b ON a.g = b.g AND a.id <> b.id AND a.w <= b.w + b.d AND b.w <= a.w + a.d AND a.s <= b.s + b.d AND b.s <= a.s + a.d)
    SELECT id AS area, (n >= 2 AND km2 < 5000) OR (n >= 10 AND fill < 0.1) OR (km2 < 100 AND id NOT IN (FROM met)) AS uses_hull FROM z"""
)
def s17_hull_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions a map draws as hulls: groups of small islands, sparse ones, and a small island by itself."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n * 5 % 12)))
    w, s, d = (n % 5) * 3.0 + F.col("i") * 0.5, F.floor(n / 5) * 3.0 + F.col("i") * 0.5, F.lit(0.02) + F.lit(0.3) * (n % 3)
    ring = F.array(*[F.struct((w + d * x).alias("lon"), (s + d * y).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    parts = rows.select(n.alias("area"), F.col("n_regionkey").alias("parent"), "i", F.array(ring).alias("rings"))
    # Parts meet parts; the pairs of one region and of different parents don't count.
    single = parts.select((F.col("area") * 100 + F.col("i")).alias("area"), "rings")
    of = parts.select((F.col("area") * 100 + F.col("i")).alias("part"), F.col("area").alias("id"), "parent")
    pairs = areas.meeting(single).join(of.selectExpr("part AS a", "id AS x", "parent AS p"), "a").join(of.selectExpr("part AS b", "id AS y", "parent AS q"), "b").filter("x <> y AND p = q")
    met = pairs.select(F.explode(F.array("x", "y")).alias("area"))
    return areas.hull_flags(parts.select("area", "rings"), met)


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS area, n_nationkey % 5 * 2.0::DOUBLE AS w, n_nationkey // 5 * 2.0::DOUBLE AS s FROM nation)
    SELECT area, 5::BIGINT AS n_points, w || ',' || s || ',' || (w + 2) || ',' || (s + 2) AS box FROM n"""
)
def w7_coverage_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of a grid with wavy borders in common: the waves go, the corners stay, and neighbours agree."""
    n = F.col("n_nationkey").cast("long")
    w, s = (n % 5) * 2.0, F.floor(n / 5) * 2.0
    wave = ((0.0, 0.0), (0.5, 0.01), (1.0, -0.01), (1.5, 0.01), (2.0, 0.0))
    low, right = [(x, y) for x, y in wave[:-1]], [(2.0 + y, x) for x, y in wave[:-1]]
    high, left = [(x, 2.0 + y) for x, y in wave[:0:-1]], [(y, x) for x, y in wave[:0:-1]]
    ring = F.array(*[F.struct((w + x).alias("lon"), (s + y).alias("lat")) for x, y in [*low, *right, *high, *left, low[0]]])
    grid = table(spark, sf_dir, "nation").select(F.lit(1).alias("parent"), n.alias("area"), F.array(ring).alias("rings"))
    made = areas.simplified_coverage(grid, 0.1)
    b = polygon.box(F.col("rings"))
    return made.select("area", F.size(F.flatten("rings")).cast("long").alias("n_points"), F.concat_ws(",", *[b[k].cast("string") for k in ("west", "south", "east", "north")]).alias("box"))


@query(
    """SELECT n_nationkey::BIGINT AS id, 5::BIGINT AS by_distance, 5::BIGINT AS by_area, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS coarse FROM nation"""
)
def s14_simplified_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that stay of squares with many points on their sides, by distance and by area, and whether anything does at a tolerance above the small ones."""
    n = F.col("n_nationkey")
    side = F.when(n % 4 == 0, 1.0).otherwise(8.0)
    corners = [(k / 10, 0.001 * (k % 2)) for k in range(10)] + [(1, k / 10) for k in range(10)] + [(1 - k / 10, 1) for k in range(10)] + [(0, 1 - k / 10) for k in range(10)] + [(0, 0)]
    ring = F.array(*[F.struct((side * float(x)).alias("lon"), (side * float(y)).alias("lat")) for x, y in corners])
    rows = table(spark, sf_dir, "nation").select(n.cast("long").alias("id"), F.array(ring).alias("rings"))
    count = lambda c: F.size(F.flatten(c)).cast("long")
    rings = F.col("rings")
    return rows.select("id", count(areas.simplified(rings, 0.1)).alias("by_distance"), count(areas.simplified(rings, 0.1, by_area=True)).alias("by_area"), F.size(areas.simplified(rings, 2.0)).cast("long").alias("coarse"))


@query()
def io17_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as vector tiles of three zooms; SQL has no encoder, a test reads the bytes back."""
    rings = parts_of_nations(spark, sf_dir)
    b = {k: v for k, v in polygon.box(F.col("rings")).items()}
    placed = areas.tiles(rings.select(F.col("region_id").alias("id"), "rings", *[v.alias(k) for k, v in b.items()]), [0, 2, 4])
    return vector_tiles.layers(vector_tiles.features(placed, F.col("rings"), F.col("id")), "regions")


@query(
    f"""WITH {EDGES}, p AS (SELECT region_id, part, radians(x1) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(greatest(-85.06, least(85.06, y1))) / 2)) * 6378137.0 AS y FROM edges)
    SELECT region_id, count(DISTINCT part) AS parts, round(min(x), 3) + 0.0 AS west, round(min(y), 3) + 0.0 AS south, round(max(x), 3) + 0.0 AS east, round(max(y), 3) + 0.0 AS north, count(*) + count(DISTINCT part * 10 + CASE WHEN part = 0 AND region_id % 2 = 0 THEN 1 ELSE 0 END)
        + CASE WHEN region_id % 2 = 0 THEN 1 ELSE 0 END AS n_points FROM p GROUP BY region_id"""
)
def s15_projected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' forms in web Mercator metres, with what is derived from them: parts, box and points."""

    def moved(p: Column) -> Column:
        x, y = geo.mercator(p["lon"], p["lat"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    made = parts_of_nations(spark, sf_dir).withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))
    b = polygon.box(F.col("rings"))
    rows = made.groupBy("region_id").agg(F.count("*").alias("parts"), F.min(b["west"]).alias("west"), F.min(b["south"]).alias("south"), F.max(b["east"]).alias("east"), F.max(b["north"]).alias("north"), F.sum(F.size(F.flatten("rings"))).alias("n_points"))
    return rows.select("region_id", "parts", *[(F.round(c, 3) + 0.0).alias(c) for c in ("west", "south", "east", "north")], "n_points")
