"""Joins of points and polygons, overlaps of areas, and tiles.

Polygons are rows of an id and rings (terrace.functions.polygon). Each stands in grid cells of its own size, a power of two
above its larger side, so that it is in a few cells whatever the others' sizes; one with many edges is in finer cells, a few
hundred at most. A cell has the edges that matter there: those in its band of latitudes, at or east of it. Points look into
their cell at every level that there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import polygon
from terrace.functions.geo import tile
from terrace.operators.spatial import cell, hulls, segment_cells
from terrace.operators.steps import cut, small

RINGS = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))


#: A polygon is split into finer cells until one has about so many edges, at most so many times in half.
CELL_EDGES, SPLITS = 64, 4


def leveled(polygons: DataFrame, least: float = 1e-6, split: bool = True) -> DataFrame:
    """Adds west to north, and _level: cells of the polygon are 2**_level degrees wide, no less than `least` where it isn't split."""
    b = polygon.box(F.col("rings"))
    rows = polygons.withColumns(b).filter("west IS NOT NULL")
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(least))
    finer = F.greatest(F.lit(0), F.least(F.lit(SPLITS), F.ceil(F.log2(F.size(F.flatten("rings")) / F.lit(float(CELL_EDGES))) / 2))) if split else F.lit(0)
    return rows.withColumn("_level", (F.ceil(F.log2(side)) - finer).cast("int"))


def levels_of(rows: DataFrame) -> list[int]:
    """The levels that there are, a few dozen at most as they are powers of two between a metre and the world."""
    return sorted(r[0] for r in rows.select("_level").distinct().collect())


def width_of(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def box_cells(rows: DataFrame) -> DataFrame:
    """A row (_cx, _cy) for each cell of its level that a box touches."""
    size = width_of(F.col("_level"))
    rows = rows.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size))))
    return rows.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("south") / size), F.floor(F.col("north") / size))))


def in_cells(rows: DataFrame) -> DataFrame:
    """area, _level, _cx, _cy, west to north, _sides (the edges for rays to the east). rows: area, rings and what leveled() adds."""
    size = width_of(F.col("_level"))
    held = box_cells(rows.select("area", polygon.edges(F.col("rings")).alias("_all"), "west", "south", "east", "north", "_level"))
    low, high, left = F.col("_cy") * size, (F.col("_cy") + 1) * size, F.col("_cx") * size
    near = lambda e: (F.least(e["a"]["lat"], e["b"]["lat"]) <= high) & (F.greatest(e["a"]["lat"], e["b"]["lat"]) >= low) & (F.greatest(e["a"]["lon"], e["b"]["lon"]) >= left)
    return held.withColumn("_sides", F.filter("_all", near)).drop("_all")


def at_levels(points: DataFrame, levels: list[int]) -> DataFrame:
    """A row (_level, _cx, _cy) for the cell that a point is in at each level."""
    rows = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    size = width_of(F.col("_level"))
    return rows.withColumn("_cx", F.floor(F.col("lon") / size)).withColumn("_cy", F.floor(F.col("lat") / size))


def points_in_areas(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """place, area: each pair of a point strictly inside a polygon, once. points: place, lon, lat; polygons: area, rings, several rows of an area allowed."""
    rows = cut(leveled(polygons.select("area", "rings")))
    at = at_levels(points.select("place", "lon", "lat"), levels_of(rows))
    held = at.join(small(in_cells(rows)), ["_level", "_cx", "_cy"]).filter("lon > west AND lon < east AND lat > south AND lat < north")
    return held.filter(polygon.inside(F.col("_sides"), F.col("lon"), F.col("lat"))).select("place", "area").distinct()


def edges_in_cells(rows: DataFrame) -> DataFrame:
    """area, _level, _cx, _cy, e: a row for each cell that an edge passes through at its polygon's level."""
    sides = rows.select("area", "_level", F.explode(polygon.edges(F.col("rings"))).alias("e"))
    flat = sides.select("*", *[F.col(f"e.{p}.{k}").alias(f"{n}{i}") for i, p in ((1, "a"), (2, "b")) for n, k in (("x", "lon"), ("y", "lat"))], width_of(F.col("_level")).alias("_size"))
    return segment_cells(flat, 1e-9).select("area", "_level", "_cx", "_cy", "e")


def near_borders(points: DataFrame, polygons: DataFrame, metres: float) -> DataFrame:
    """place, area, metres: every polygon whose border is within so many metres of a point, with the distance; over the antimeridian too."""
    reach = metres / 110_000.0
    rows = cut(leveled(polygons.select("area", "rings"), least=reach, split=False))
    # A degree of longitude shrinks to the poles, where the reach is the whole circle.
    wide = F.when(F.abs(F.col("lat")) > 89.0, 180.0).otherwise(F.least(F.lit(180.0), F.lit(reach) / F.cos(F.radians("lat"))))
    turned = F.filter(F.array(F.col("lon"), F.col("lon") - 360, F.col("lon") + 360), lambda x: x.between(F.lit(-180.0) - wide, F.lit(180.0) + wide))
    at = points.select("place", "lat", wide.alias("_wide"), F.explode(turned).alias("lon"))
    at = at.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels_of(rows)]).cast("array<int>")))
    size, span = width_of(F.col("_level")), lambda low, high, size: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    at = at.withColumn("_cx", span(F.col("lon") - F.col("_wide"), F.col("lon") + F.col("_wide"), size)).withColumn("_cy", span(F.col("lat") - reach, F.col("lat") + reach, size))
    met = at.join(small(edges_in_cells(rows)), ["_level", "_cx", "_cy"]).withColumn("metres", polygon.segment_metres(F.col("lon"), F.col("lat"), F.col("e")))
    return met.filter(F.col("metres") <= metres).groupBy("place", "area").agg(F.min("metres").alias("metres"))


def containing_or_nearest(points: DataFrame, polygons: DataFrame, metres: float) -> DataFrame:
    """place, area: the polygon that holds the point (the least id of several), else the nearest within so many metres."""
    inside = points_in_areas(points, polygons).groupBy("place").agg(F.min("area").alias("area"))
    rest = points.join(inside, "place", "left_anti")
    nearest = near_borders(rest, polygons, metres).groupBy("place").agg(F.min_by("area", F.struct("metres", "area")).alias("area"))
    return inside.unionByName(nearest)


def nearest_borders(points: DataFrame, polygons: DataFrame, reach: float = 50_000.0) -> DataFrame:
    """place, area, metres: the polygon whose border is nearest to each point, however far (0 inside); the least id of equals.

    A reach that grows fourfold is searched; points that found a border leave. All border points within the reach were looked
    at, so the best of them is the nearest of all. Points of one spot are searched as one.
    """
    spots = cut(points.select("lon", "lat").distinct().withColumn("_spot", F.monotonically_increasing_id()))
    found = _nearest_of_spots(spots.withColumnRenamed("_spot", "place"), polygons, reach).withColumnRenamed("place", "_spot")
    return points.join(spots.join(found, "_spot").hint("merge"), ["lon", "lat"]).select("place", "area", "metres")


def _nearest_of_spots(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    inside = points_in_areas(points, polygons).groupBy("place").agg(F.min("area").alias("area")).withColumn("metres", F.lit(0.0))
    done, rest = cut(inside), points.select("place", "lon", "lat")
    rest = cut(rest.join(done, "place", "left_anti"))
    while reach < 80_000_000 and not rest.isEmpty():
        near = near_borders(rest, polygons, min(reach, 30_000_000.0))
        found = cut(near.groupBy("place").agg(F.min(F.struct("metres", "area")).alias("r")).select("place", "r.area", "r.metres"))
        done = done.unionByName(found)
        rest = cut(rest.join(found, "place", "left_anti"))
        reach *= 4
    return done


def adjacent(polygons: DataFrame, tolerance: float) -> DataFrame:
    """a, b (a < b): polygons whose borders touch, cross or come within so many degrees. polygons: area, rings."""
    sides = polygons.select("area", F.explode(polygon.edges(F.col("rings"))).alias("e")).select("area", "e.a", "e.b")
    mean = sides.select(F.avg(F.greatest(F.abs(F.col("a.lon") - F.col("b.lon")), F.abs(F.col("a.lat") - F.col("b.lat"))))).first()[0] or 1.0
    flat = sides.select("*", *[F.col(f"{p}.{k}").alias(f"{n}{i}") for i, p in ((1, "a"), (2, "b")) for n, k in (("x", "lon"), ("y", "lat"))], F.lit(max(mean, 4 * tolerance, 1e-6)).alias("_size"))
    cells = segment_cells(flat, max(tolerance, 1e-9))
    left, right = cells.select("_cx", "_cy", F.col("area").alias("a"), F.col("a").alias("p"), F.col("b").alias("q")), cells.select("_cx", "_cy", F.col("area").alias("b"), F.col("a").alias("r"), F.col("b").alias("s"))
    pairs = left.join(right, ["_cx", "_cy"]).filter("a < b")
    turn = lambda p, q, r: F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    def far(p: Column, a: Column, b: Column) -> Column:
        x, y = b["lon"] - a["lon"], b["lat"] - a["lat"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((p["lon"] - a["lon"]) * x + (p["lat"] - a["lat"]) * y, x * x + y * y), F.lit(0.0))))
        return F.sqrt(F.pow(p["lon"] - a["lon"] - t * x, F.lit(2)) + F.pow(p["lat"] - a["lat"] - t * y, F.lit(2)))

    p, q, r, s = (F.col(c) for c in "pqrs")
    crossing = (turn(p, q, r) * turn(p, q, s) < 0) & (turn(r, s, p) * turn(r, s, q) < 0)
    near = F.least(far(p, r, s), far(q, r, s), far(r, p, q), far(s, p, q)) <= tolerance
    return pairs.filter(crossing | near).select("a", "b").distinct()


def _segments(rings: list) -> np.ndarray:
    out = [(*((a["lon"], a["lat"])), *((b["lon"], b["lat"]))) for r in rings for a, b in zip(r, r[1:], strict=False)]
    return np.array(out, float).reshape(-1, 4)


def _heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All latitudes at which edges end or cross; between two of them every edge is straight and none crosses another."""
    both = np.vstack([a, b])
    ends = [both[:, 1], both[:, 3]]
    for x1, y1, x2, y2 in a:
        dx, dy, ex, ey = x2 - x1, y2 - y1, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
        cross = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((b[:, 0] - x1) * ey - (b[:, 1] - y1) * ex) / cross
            u = ((b[:, 0] - x1) * dy - (b[:, 1] - y1) * dx) / cross
        ok = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        ends.append(y1 + t[ok] * dy)
    return np.unique(np.concatenate(ends))


def _spans(sides: np.ndarray, y: float) -> np.ndarray:
    at = sides[(sides[:, 1] > y) != (sides[:, 3] > y)]
    return np.sort((at[:, 2] - at[:, 0]) * (y - at[:, 1]) / (at[:, 3] - at[:, 1]) + at[:, 0]).reshape(-1, 2)


def common_area(a: list, b: list) -> float:
    """Area common to two polygons, in square degrees: in each slab of latitudes the common width is linear, so its middle tells."""
    a, b = _segments(a), _segments(b)
    if not len(a) or not len(b):
        return 0.0
    ys, total = _heights(a, b), 0.0
    for low, high in zip(ys, ys[1:], strict=False):
        p, q = _spans(a, (low + high) / 2), _spans(b, (low + high) / 2)
        width = sum(max(0.0, min(e, g) - max(d, f)) for d, e in p for f, g in q)
        total += width * (high - low)
    return total


def overlap_ratio(left: Column, right: Column) -> Column:
    """The share of the left polygon's area that the right one covers; null where the left has none."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            whole = common_area(x, x) if x else 0.0
            out.append(None if not whole else common_area(x, y or []) / whole)
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(left, right)


def boxes_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: pairs of rows whose boxes meet. Both: area, rings. Each box looks up the larger ones in the cells of their levels."""
    a, b = cut(leveled(left.select("area", "rings"), split=False).drop("rings")), cut(leveled(right.select("area", "rings"), split=False).drop("rings"))

    def found(small_ones: DataFrame, large: DataFrame, strictly: bool) -> DataFrame:
        levels = levels_of(large)
        above = F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: (k > F.col("_own")) if strictly else (k >= F.col("_own")))
        looked = box_cells(small_ones.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(above)))
        named = lambda df, n: df.select("_level", "_cx", "_cy", F.col("area").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("west", "south", "east", "north")])
        met = named(looked, "s").join(named(box_cells(large), "l"), ["_level", "_cx", "_cy"])
        return met.filter("s_west <= l_east AND l_west <= s_east AND s_south <= l_north AND l_south <= s_north").select("s", "l").distinct()

    upward, downward = found(a, b, False).select(F.col("s").alias("a"), F.col("l").alias("b")), found(b, a, True).select(F.col("l").alias("a"), F.col("s").alias("b"))
    return upward.unionByName(downward).distinct()


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, ratio (of a's area that b covers, above 0): pairs whose boxes meet. Both: area, rings, one row of an area."""
    meet = boxes_meeting(left, right)
    rows = meet.join(left.select(F.col("area").alias("a"), F.col("rings").alias("_p")), "a").join(right.select(F.col("area").alias("b"), F.col("rings").alias("_q")), "b")
    return rows.withColumn("ratio", overlap_ratio(F.col("_p"), F.col("_q"))).filter("ratio > 0").select("a", "b", "ratio")


def covering(candidates: DataFrame, ancestry: DataFrame, least: float = 0.01) -> DataFrame:
    """The covering set per region: of the candidates with at least this coverage those without a candidate among their ancestors.

    candidates: region, division, coverage; ancestry: node, ancestor, distance. Divisions are taken from the root down, so
    one is left out just if one above it is taken, and the topmost candidate of a line always is.
    """
    able = candidates.filter(F.col("coverage") >= least)
    above = ancestry.filter("distance > 0").select(F.col("node").alias("division"), "ancestor")
    hidden = able.select("region", "division").join(above, "division").join(able.select("region", F.col("division").alias("ancestor")), ["region", "ancestor"], "left_semi")
    return able.join(hidden.select("region", "division").distinct(), ["region", "division"], "left_anti")


def tiles(areas: DataFrame, zooms: list[int]) -> DataFrame:
    """A row of an area for each map tile that its box meets, at each zoom: z, x, y before its columns. areas: west, south, east, north, …"""
    rows = []
    for z in zooms:
        (x1, y1), (x2, y2) = tile(F.col("west"), F.col("north"), z), tile(F.col("east"), F.col("south"), z)
        rows.append(areas.select(F.lit(z).cast("long").alias("z"), F.explode(F.sequence(x1, x2)).alias("x"), "*", y1.alias("_y1"), y2.alias("_y2")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("y", F.explode(F.sequence("_y1", "_y2"))).drop("_y1", "_y2")


def nearest_two_stage(points: DataFrame, boxes: DataFrame, exact: Column, first: int = 15) -> DataFrame:
    """place, area, best: of the `first` boxes nearest to a point the one with the least exact value. points: place, lon, lat; boxes: area, west to north.

    Points look for boxes within a reach that doubles until enough are found, in cells as large as the reach; those that
    are done leave, so a round's join is on cells and none meets all boxes but for a point far from them.
    """
    aside = lambda v, low, high: F.greatest(F.lit(0.0), low - v, v - high)
    gap = F.sqrt(F.pow(aside(F.col("lon"), F.col("west"), F.col("east")), F.lit(2)) + F.pow(aside(F.col("lat"), F.col("south"), F.col("north")), F.lit(2)))
    known, mean = boxes.agg(F.count("*"), F.avg(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")))).first()
    reach, need, rest, done = max(mean or 1.0, 1e-3), min(first, known), points.select("place", "lon", "lat"), None
    while True:
        span = lambda a, b, r=reach: F.explode(F.sequence(cell(F.col(a) - r, r), cell(F.col(b) + r, r)))
        held = boxes.withColumn("_cx", span("west", "east")).withColumn("_cy", span("south", "north"))
        at = rest.withColumn("_cx", cell(F.col("lon"), reach)).withColumn("_cy", cell(F.col("lat"), reach))
        pairs = at.join(held, ["_cx", "_cy"]).withColumn("_gap", gap).filter(F.col("_gap") <= reach)
        pairs = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("place").orderBy("_gap", "area"))).filter(F.col("_rn") <= first)
        found = pairs.withColumn("best", exact).groupBy("place").agg(F.count("*").alias("_n"), F.min_by(F.struct("area", "best"), F.struct("best", "area")).alias("r"))
        found = cut(found.filter(F.lit(reach > 1000) | (F.col("_n") >= need)).select("place", "r.area", "r.best"))
        done = found if done is None else done.unionByName(found)
        rest = cut(rest.join(found, "place", "left_anti"))
        if reach > 1000 or not known or rest.isEmpty():
            return done
        reach *= 2


def _by_distance(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: whatever lies further than the tolerance from the line between those that stay."""
    keep, waiting = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while waiting:
        a, b = waiting.pop()
        if b - a < 2:
            continue
        d, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*d)
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            waiting += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _by_area(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay when the one whose triangle with its neighbours is the smallest goes, until none is below the tolerance.

    Both ends stay, and of a closed line four points do.
    """
    keep, least = np.ones(len(points), bool), 4 if len(points) and tuple(points[0]) == tuple(points[-1]) else 2
    while keep.sum() > least:
        at = np.flatnonzero(keep)
        a, b, c = points[at[:-2]], points[at[1:-1]], points[at[2:]]
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        k = int(area.argmin())
        if area[k] >= tolerance:
            break
        keep[at[k + 1]] = False
    return keep


def simplified(rings: Column, tolerance: float, by_area: bool = False) -> Column:
    """Rings with fewer points, by distance from the line or by the area of triangles; rings that collapse go."""

    def one(ring) -> list | None:
        points = np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)
        if len(points) < 4:
            return None
        if by_area:
            keep = _by_area(points, tolerance)
        else:
            # A closed line is cut at the point that is furthest from its beginning, which so stays.
            k = int(np.hypot(*(points - points[0]).T).argmax())
            keep = np.concatenate([_by_distance(points[: k + 1], tolerance), _by_distance(points[k:], tolerance)[1:]])
        return [ring[i] for i in np.flatnonzero(keep)] if keep.sum() > 3 else None

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else [r for r in map(one, v) if r] for v in values.to_pylist()], RINGS)

    return F.arrow_udf(run, "array<array<struct<lon:double,lat:double>>>")(rings)


def simplified_coverage(polygons: DataFrame, tolerance: float) -> DataFrame:
    """area, rings: polygons (parent, area, rings) with fewer points, those of one parent still sharing their borders.

    Points where more than two borders of siblings meet stay. What lies between two of them is an arc, which every polygon
    that has it thins out in the same direction, so all get the same points. No task sees more than one ring.
    """
    rings = polygons.select("parent", "area", F.posexplode("rings").alias("ring", "_points"))
    points = rings.select("parent", "area", "ring", F.posexplode(F.slice("_points", F.lit(1), F.size("_points") - 1)).alias("k", "p"), (F.size("_points") - 1).alias("n"), "_points")
    at = lambda k: F.get("_points", k)
    beside = points.select("parent", "area", "ring", "k", "p", F.explode(F.array(at(F.pmod(F.col("k") - 1, F.col("n"))), at(F.pmod(F.col("k") + 1, F.col("n"))))).alias("q"))
    meets = beside.groupBy("parent", "p").agg((F.size(F.collect_set("q")) != 2).alias("fixed"))
    flagged = points.select("parent", "area", "ring", "k", "p").join(meets, ["parent", "p"])
    lines = flagged.groupBy("area", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "p", "fixed"))).alias("line"))

    def thin(line) -> list | None:
        pts, fixed = np.array([(r["p"]["lon"], r["p"]["lat"]) for r in line], float), [i for i, r in enumerate(line) if r["fixed"]]
        # A ring without a meeting point begins at its least point, wherever it is written to begin.
        cuts = fixed or [int(np.lexsort((pts[:, 1], pts[:, 0]))[0])]
        out: list = []
        for a, b in zip(cuts, cuts[1:] + [cuts[0] + len(pts)], strict=True):
            arc = pts[np.arange(a, b + 1) % len(pts)]
            turned = tuple(arc[0]) > tuple(arc[-1]) or (tuple(arc[0]) == tuple(arc[-1]) and tuple(arc[1]) > tuple(arc[-2]))
            arc = arc[::-1] if turned else arc
            kept = arc[_by_area(arc, tolerance)]
            out += (kept[::-1] if turned else kept)[:-1].tolist()
        return [{"lon": x, "lat": y} for x, y in [*out, out[0]]] if len(out) > 2 else None

    def run(values: pd.Series) -> pd.Series:
        return values.map(thin)

    done = lines.select("area", "ring", F.pandas_udf(run, "array<struct<lon:double,lat:double>>")("line").alias("r")).filter("r IS NOT NULL")
    return done.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda x: x["r"]).alias("rings"))


def meeting(polygons: DataFrame) -> DataFrame:
    """a, b (a < b): polygons that have a point in common: borders that meet, or one that holds the other."""
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    corners = polygons.select(F.col("area").alias("place"), first["lon"].alias("lon"), first["lat"].alias("lat"))
    within = points_in_areas(corners, polygons).filter("place <> area").select(F.least("place", "area").alias("a"), F.greatest("place", "area").alias("b"))
    return adjacent(polygons, 0.0).unionByName(within).distinct()


def hull_flags(parts: DataFrame, met: DataFrame) -> DataFrame:
    """area, uses_hull: what a map draws as a hull. parts: area, rings, a row of each part; met: areas that meet a sibling.

    Several small parts (under 5000 square kilometres), ten or more that fill less than a tenth of their hull, or one small
    one (under 100) that meets no sibling.
    """
    shell = F.aggregate("rings", F.lit(0.0), lambda t, r: t + polygon.sphere_area(r) / 1e6)
    flat = F.aggregate("rings", F.lit(0.0), lambda t, r: t + F.abs(polygon.signed_area(r)))
    sizes = parts.groupBy("area").agg(F.count("*").alias("n"), F.sum(shell).alias("km2"), F.sum(flat).alias("flat"))
    corners = parts.select("area", F.inline(F.flatten("rings"))).select("area", "lon", "lat")
    rows = sizes.join(_hull_sizes(corners), "area").join(met.select("area").distinct().withColumn("_met", F.lit(True)), "area", "left")
    sparse = F.coalesce(F.try_divide(F.col("flat"), F.col("hull")) < 0.1, F.lit(False))
    flag = ((F.col("n") >= 2) & (F.col("km2") < 5000)) | ((F.col("n") >= 10) & sparse) | ((F.col("km2") < 100) & F.col("_met").isNull())
    return rows.select("area", flag.alias("uses_hull"))


def _hull_sizes(corners: DataFrame) -> DataFrame:
    return hulls(corners.withColumnRenamed("area", "_of"), "_of").select(F.col("_of").alias("area"), F.col("area").alias("hull"))
