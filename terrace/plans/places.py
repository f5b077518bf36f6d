"""Points, boxes, tiles and hulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import geo
from terrace.operators import spatial
from terrace.plans.base import BOXES, HAVERSINE, POINTS, query
from terrace.sources.tables import boxes, points

FAR = 400_000
FLAT = {"a": "a", "b": "b"}


@query(f"WITH {POINTS}, {BOXES} SELECT p.id AS point, b.id AS box FROM points p JOIN boxes b ON lon > west AND lon < east AND lat > south AND lat < north")
def s1_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_boxes(points(spark, sf_dir), boxes(spark, sf_dir))


@query(f"WITH {POINTS} SELECT id FROM points WHERE (lon >= 150 OR lon <= -140) AND lat BETWEEN -40 AND 35")
def f2_box_over_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [F.lit(float(x)) for x in (150, -40, -140, 35)]
    return points(spark, sf_dir).filter(geo.in_box(F.col("lon"), F.col("lat"), *edges)).select("id")


@query(
    f"""WITH {POINTS}, c AS (SELECT n_nationkey::BIGINT AS id, n_nationkey * 14 - 170 AS lon, n_nationkey * 7 % 120 - 48 AS lat FROM nation),
    d AS (SELECT a.id AS a, b.id AS b, {HAVERSINE.format(a="a", b="b")} AS metres FROM points a, c b)
    SELECT a, b, round(metres, 2) AS metres FROM d WHERE metres <= {FAR}"""
)
def j7_pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pairs_within(points(spark, sf_dir), _centres(spark, sf_dir), FAR).select("a", "b", F.round("metres", 2).alias("metres"))


@query(
    f"""WITH {POINTS}, c AS (SELECT n_nationkey::BIGINT AS id, n_nationkey * 14 - 170 AS lon, n_nationkey * 7 % 120 - 48 AS lat FROM nation),
    d AS (SELECT a.id AS a, b.id AS b, {HAVERSINE.format(a="a", b="b")} AS metres FROM points a, c b)
    SELECT DISTINCT ON (a) a, b FROM d WHERE metres <= {FAR} ORDER BY a, metres, b"""
)
def j10_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_within(points(spark, sf_dir), _centres(spark, sf_dir), FAR).select("a", "b")


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("id", (F.col("west") + 10).cast("double").alias("lon"), (F.col("south") + 12).cast("double").alias("lat"))


@query(
    f"""WITH {BOXES} SELECT id, round((east - west) * 111.0 * cos(radians((south + north) / 2)), 6) AS width_km, (north - south) * 111.0::DOUBLE AS height_km FROM boxes"""
)
def m3_box_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = geo.box_size_km(*[F.col(c) for c in ("west", "south", "east", "north")])
    return boxes(spark, sf_dir).select("id", F.round(width, 6).alias("width_km"), height.alias("height_km"))


@query(
    f"""WITH {POINTS} SELECT id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM points"""
)
def s15_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", F.round(x, 3).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query(
    f"""WITH {POINTS} SELECT floor((lon + 180) / 360 * 16)::BIGINT AS x, floor((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 16)::BIGINT AS y, count(*) AS points
    FROM points GROUP BY ALL"""
)
def v1_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.tile(F.col("lon"), F.col("lat"), 4)
    return points(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("points"))


@query(f"WITH {POINTS} SELECT brand, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS lon, round(avg(lat), 6) AS lat FROM points GROUP BY brand")
def x21_mean_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("brand").agg(F.round(geo.mean_longitude(F.col("lon")), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


VIEWS = "(VALUES (1, 170.0, -60.0, 230.0, 60.0), (2, 150.0, -85.0, -140.0, 20.0), (3, -200.0, 0.0, 200.0, 90.0), (4, -20.0, -10.0, 40.0, 50.0)) v(view, west, south, east, north)"


@query(f"WITH {POINTS} SELECT view, id FROM points, {VIEWS} WHERE lat BETWEEN south AND north AND ((CASE WHEN west <= east THEN east - west ELSE east + 360 - west END) >= 360 OR (((lon - west) % 360) + 360) % 360 <= (CASE WHEN west <= east THEN east - west ELSE east + 360 - west END))")
def x29_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on each of some views: beyond 180 degrees, over the antimeridian, wider than the world, and a plain one."""
    views = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("view", "west", "south", "east", "north"), v, strict=True)]) for v in ((1, 170.0, -60.0, 230.0, 60.0), (2, 150.0, -85.0, -140.0, 20.0), (3, -200.0, 0.0, 200.0, 90.0), (4, -20.0, -10.0, 40.0, 50.0))])
    rows = points(spark, sf_dir).select("id", "lon", "lat", F.explode(views).alias("v"))
    return rows.filter(geo.in_view(F.col("lon"), F.col("lat"), *[F.col(f"v.{e}") for e in ("west", "south", "east", "north")])).select("v.view", "id")


@query()
def s18_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls by brand; SQL has no monotone chain, tests compare with brute force."""
    return spatial.hulls(points(spark, sf_dir), "brand")


@query(
    """WITH f AS (SELECT n_regionkey::BIGINT AS region, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
    e AS (SELECT region, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM f UNION ALL SELECT region, x, y + 1, x + 1, y + 1 FROM f
        UNION ALL SELECT region, x, y, x, y + 1 FROM f UNION ALL SELECT region, x + 1, y, x + 1, y + 1 FROM f)
    SELECT region, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def s13_merged_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit squares by nation, merged by region: shared borders cancel."""
    key = F.col("n_nationkey").cast("long")
    faces = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("region"), (key % 5).alias("x"), F.floor(key / 5).cast("long").alias("y"))
    side = lambda a, b, c, d: F.struct((F.col("x") + a).alias("x1"), (F.col("y") + b).alias("y1"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2"))
    edges = faces.select("region", F.inline(F.array(side(0, 0, 1, 0), side(1, 1, 0, 1), side(0, 0, 0, 1), side(1, 0, 1, 1))))
    return spatial.outer_edges(edges, "region")


@query(
    f"""WITH {POINTS}, g AS (SELECT id // 2 AS k, lon, lat FROM points WHERE id % 7 <> 0), o AS (SELECT k, bool_or(lon > 150) AND bool_or(lon < -150) AS over_ FROM g GROUP BY k),
    m AS (SELECT k, CASE WHEN over_ AND lon < 0 THEN lon + 360 ELSE lon END AS x, lat AS y FROM g JOIN o USING (k)), n AS (SELECT k, count(*) AS n, list(x ORDER BY x, y) AS xs, list(y ORDER BY x, y) AS ys FROM m GROUP BY k),
    d AS (SELECT *, (ys[2] - ys[1]) / sqrt(pow(ys[2] - ys[1], 2) + pow(xs[1] - xs[2], 2)) * 0.5 AS u, (xs[1] - xs[2]) / sqrt(pow(ys[2] - ys[1], 2) + pow(xs[1] - xs[2], 2)) * 0.5 AS v FROM n)
    SELECT k, round(CASE WHEN n = 1 THEN xs[1] - 0.5 ELSE xs[1] + u END, 6) AS x, round(CASE WHEN n = 1 THEN ys[1] - 0.5 ELSE ys[1] + v END, 6) AS y, round(CASE WHEN n = 1 THEN xs[1] + 0.5 ELSE xs[2] - u END, 6) AS far_x FROM d"""
)
def s18_drawn_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of one or two points: the first corner of the square or band, and the longitude of the opposite one."""
    grouped = points(spark, sf_dir).filter("id % 7 <> 0").selectExpr("id div 2 AS k", "lon", "lat")
    ring = spatial.drawn_hulls(grouped, "k", 0.5)
    return ring.select("k", F.round(F.get(F.get("ring", F.lit(0)), F.lit(0)), 6).alias("x"), F.round(F.get(F.get("ring", F.lit(0)), F.lit(1)), 6).alias("y"), F.round(F.get(F.get("ring", F.lit(2)), F.lit(0)), 6).alias("far_x"))
