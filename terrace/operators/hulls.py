"""Concave hulls of groups of points, drawn with a margin and parted at the antimeridian.

A group's points are triangulated; triangles with an edge above a share of the group's extent are carved away, and the
border of what is left is the hull, stitched out of the edges that no two triangles share. Where that is no single form, the
convex hull stands in. The margin is the union of the form with a disc around each corner and a band along each edge.

A group is triangulated in one task: it is a region's parts, a point for each. What follows works on edges.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import polygon
from terrace.functions.geo import EARTH, haversine
from terrace.operators import faces
from terrace.operators.areas import simplified
from terrace.operators.spatial import hulls
from terrace.operators.steps import cut

#: The margin in km, the share of the extent that an edge may have, and degrees of simplification.
MARGIN_KM, CONCAVITY, SIMPLIFY = 50.0, 0.9, 0.02
#: Fixed values, degrees: beyond OVER on both sides a group lies over the antimeridian; one that comes within NEAR of it
#: is held on its side, with so much ROOM on the other; each half gets HALF_ROOM, and corners within SNAP of the line lie on it.
OVER, NEAR, ROOM, HALF_ROOM, SNAP = 150.0, 170.0, 10.0, 5.0, 1.0
#: Corners of a disc.
DISC = 16


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of points in order of x, then y, without repeats, counterclockwise: any triangulation first, then edges are turned until all are Delaunay's."""

    def turn(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[a], points[b], points[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def within(a: int, b: int, c: int, d: int) -> bool:
        """Whether d is in the circle around a, b, c, by more than rounding."""
        rows = [(points[k][0] - points[d][0], points[k][1] - points[d][1]) for k in (a, b, c)]
        (ax, ay), (bx, by), (cx, cy) = rows
        sa, sb, sc = (x * x + y * y for x, y in rows)
        terms = (ax * by * sc, -ax * sb * cy, -ay * bx * sc, ay * sb * cx, sa * bx * cy, -sa * by * cx)
        return sum(terms) > 1e-12 * sum(map(abs, terms))

    opposite: dict[tuple[int, int], int] = {}

    def put(a: int, b: int, c: int) -> None:
        opposite[a, b], opposite[b, c], opposite[c, a] = c, a, b

    lower, upper = [0], [0]
    for p in range(1, len(points)):
        # What of the hull so far is seen from the next point is joined to it.
        while len(lower) > 1 and turn(lower[-2], lower[-1], p) < 0:
            put(lower[-2], p, lower[-1])
            lower.pop()
        while len(upper) > 1 and turn(upper[-2], upper[-1], p) > 0:
            put(upper[-2], upper[-1], p)
            upper.pop()
        lower.append(p)
        upper.append(p)

    waiting = list(opposite)
    while waiting:
        u, v = waiting.pop()
        w, x = opposite.get((u, v)), opposite.get((v, u))
        if w is None or x is None or not within(u, v, w, x) or turn(u, x, w) <= 0 or turn(x, v, w) <= 0:
            continue
        del opposite[u, v], opposite[v, u]
        put(u, x, w)
        put(x, v, w)
        waiting += [(u, x), (x, v), (v, w), (w, u)]
    return [(a, b, c) for (a, b), c in opposite.items() if a < b and a < c]


def triangulated(points: DataFrame) -> DataFrame:
    """grp, ax to cy: the triangles of each group's points (grp, lon, lat)."""

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = sorted(set(zip(frame.lon, frame.lat, strict=True)))
        rows = [(key[0], *at[a], *at[b], *at[c]) for a, b, c in delaunay(at)] if len(at) > 2 else []
        return pd.DataFrame(rows, columns=["grp", "ax", "ay", "bx", "by", "cx", "cy"])

    kind = points.schema["grp"].dataType.simpleString()
    return points.select("grp", "lon", "lat").groupBy("grp").applyInPandas(of, f"grp {kind}, ax double, ay double, bx double, by double, cx double, cy double")


def carved(points: DataFrame, concavity: float = CONCAVITY) -> DataFrame:
    """grp, rings: the concave hull of each group of points (grp, lon, lat); the convex one where carving leaves none or several forms.

    Of one point, or of points on a line, it is a ring without an area.
    """
    extent = points.groupBy("grp").agg((F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")) * concavity).alias("_most"))
    degrees = lambda p, q: F.degrees(haversine(F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{q}x"), F.col(f"{q}y")) / F.lit(EARTH))
    longest = F.greatest(degrees("a", "b"), degrees("b", "c"), degrees("c", "a"))
    kept = cut(triangulated(points).join(extent, "grp").filter(longest <= F.col("_most")))
    edge = lambda p, q: F.struct(*[F.col(f"{s}{k}").alias(f"{t}{k}") for s, t in ((p, "a"), (q, "b")) for k in "xy"])
    edges = kept.select("grp", F.inline(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))))
    forms = cut(faces.assembled(faces.stitched(faces.cancelled(edges))))
    single = forms.groupBy("grp").agg(F.count("*").alias("n"), F.first("rings").alias("rings")).filter("n = 1").select("grp", "rings")
    closed = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    rest = points.join(single, "grp", "left_anti").select(F.col("grp"), "lon", "lat")
    convex = hulls(rest, "grp").select("grp", F.array(closed).alias("rings"))
    return single.unionByName(convex)


def with_margin(forms: DataFrame, km: float) -> DataFrame:
    """grp, rings: forms (grp, rings) with so many km around them, parts that meet united; rings without an area become discs and bands."""
    forms, reach = cut(forms), km / (math.pi * EARTH / 180 / 1000)
    narrow = lambda lat: F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    corners = forms.select("grp", F.explode(F.array_distinct(F.flatten("rings"))).alias("p"))
    at = lambda p, dx, dy: F.struct((p["lon"] + dx / narrow(p["lat"])).alias("lon"), (p["lat"] + dy).alias("lat"))
    turns = [2 * math.pi * k / DISC for k in [*range(DISC), 0]]
    discs = corners.select("grp", F.array(F.array(*[at(F.col("p"), F.lit(reach * math.cos(t)), F.lit(reach * math.sin(t))) for t in turns])).alias("rings"))
    sides = forms.select("grp", F.explode(polygon.edges(F.col("rings"))).alias("e")).filter("e.a <> e.b")
    a, b = F.col("e.a"), F.col("e.b")
    dx, dy = (b["lon"] - a["lon"]) * narrow((a["lat"] + b["lat"]) / 2), b["lat"] - a["lat"]
    size = F.sqrt(dx * dx + dy * dy)
    nx, ny = -dy / size * reach, dx / size * reach
    bands = sides.select("grp", F.array(F.array(at(a, nx, ny), at(a, -nx, -ny), at(b, -nx, -ny), at(b, nx, ny), at(a, nx, ny))).alias("rings"))
    every = forms.select("grp", "rings").unionByName(discs).unionByName(bands)
    made = faces.united(cut(every.withColumn("owner", F.monotonically_increasing_id())))
    return made.groupBy("grp").agg(F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))


def _held(rings: Column, low: Column, high: Column) -> Column:
    """Longitudes held within a range; what went round the antimeridian is brought back first."""
    turned = lambda x: F.when((low >= 0) & (x < 0), x + 360).when((high <= 0) & (x > 0), x - 360).otherwise(x)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.greatest(low, F.least(high, turned(p["lon"]))).alias("lon"), p["lat"].alias("lat"))))


def drawn(points: DataFrame, key: str, km: float = MARGIN_KM, concavity: float = CONCAVITY, simplify: float = SIMPLIFY) -> DataFrame:
    """key, side (whole, east or west), rings: the hull of each group of points (key, lon, lat) as a map draws it.

    A group over the antimeridian is drawn in two halves, which both end on it and meet there over the same latitudes.
    """
    spread = points.groupBy(key).agg(F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.max(F.when(F.col("lon") < 0, F.col("lon"))).alias("_last"), F.min(F.when(F.col("lon") >= 0, F.col("lon"))).alias("_first"))
    over = (F.col("_e") > OVER) & (F.col("_w") < -OVER)
    side = F.when(~over, "whole").when(F.col("lon") >= 0, "east").otherwise("west")
    near_east, near_west = F.col("_e") > NEAR, F.col("_w") < -NEAR
    zero = F.lit(0.0)
    ranges = {
        "low": F.when(~over, F.when(near_east, F.greatest(F.lit(-180.0), F.col("_w") - ROOM)).otherwise(-180.0)).when(F.col("lon") >= 0, F.greatest(zero, F.col("_first") - HALF_ROOM)).otherwise(-180.0),
        "high": F.when(~over, F.when(near_east | ~near_west, 180.0).otherwise(F.least(F.lit(180.0), F.col("_e") + ROOM))).when(F.col("lon") >= 0, 180.0).otherwise(F.least(zero, F.col("_last") + HALF_ROOM)),
    }
    placed = cut(points.filter("lon IS NOT NULL AND lat IS NOT NULL").join(spread, key).select(F.col(key).alias("_key"), side.alias("side"), "lon", "lat", *[c.alias(n) for n, c in ranges.items()]))
    groups = cut(placed.select("_key", "side", "low", "high").distinct().withColumn("grp", F.monotonically_increasing_id()))
    held = lambda df: df.join(groups, "grp").select("grp", _held(F.col("rings"), F.col("low"), F.col("high")).alias("rings"))
    forms = held(carved(placed.join(groups.drop("low", "high"), ["_key", "side"]).select("grp", "lon", "lat"), concavity))
    forms = held(with_margin(forms, km)) if km else forms
    forms = held(cut(forms).select("grp", simplified(F.col("rings"), simplify).alias("rings"))) if simplify else forms

    halves = F.col("side") != "whole"
    line = F.when(F.col("side") == "east", 180.0).otherwise(-180.0)
    on_line = lambda p: F.when(halves & (F.abs(p["lon"] - line) <= SNAP), line).otherwise(p["lon"])
    forms = cut(forms.join(groups, "grp").select("_key", "side", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(on_line(p).alias("lon"), p["lat"].alias("lat")))).alias("rings")))
    ends = forms.filter(halves).select("_key", "side", F.explode(F.flatten("rings")).alias("p")).filter(F.abs("p.lon") == 180)
    own = ends.groupBy("_key", "side").agg(F.min("p.lat").alias("_s"), F.max("p.lat").alias("_n"))
    both = own.groupBy("_key").agg(F.min("_s").alias("_ls"), F.max("_n").alias("_ln"), F.count("*").alias("_halves")).filter("_halves = 2")
    met = forms.join(own, ["_key", "side"], "left").join(both, "_key", "left")
    share = lambda lat: F.when(F.col("_n") == F.col("_s"), F.lit(0.5)).otherwise((lat - F.col("_s")) / (F.col("_n") - F.col("_s")))
    spread_out = lambda p: F.when(F.col("_ls").isNotNull() & (F.abs(p["lon"]) == 180), F.col("_ls") + share(p["lat"]) * (F.col("_ln") - F.col("_ls"))).otherwise(p["lat"])
    return met.select(F.col("_key").alias(key), "side", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["lon"].alias("lon"), spread_out(p).alias("lat")))).alias("rings"))
