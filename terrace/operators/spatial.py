"""Joins of points and boxes over grid cells, hulls and shared borders.

A cell is part of the join key, so that Spark shuffles or broadcasts by cells; the exact test follows. A box that spans
many cells is a row for each; points near a cell's border meet their neighbours through the cells around them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.geo import haversine
from terrace.operators.steps import small

METRES_PER_DEGREE = 111_195.0


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def box_cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a box touches; a box over the antimeridian (west > east) is split."""
    spans = F.when(F.col("west") <= F.col("east"), F.array(F.struct(F.col("west").alias("a"), F.col("east").alias("b")))).otherwise(
        F.array(F.struct(F.col("west").alias("a"), F.lit(180).cast("long").alias("b")), F.struct(F.lit(-180).cast("long").alias("a"), F.col("east").alias("b")))
    )
    rows = boxes.withColumn("_span", F.explode(spans))
    rows = rows.withColumn("_cx", F.explode(F.sequence(cell(F.col("_span.a"), size), cell(F.col("_span.b"), size))))
    return rows.withColumn("_cy", F.explode(F.sequence(cell(F.col("south"), size), cell(F.col("north"), size)))).drop("_span")


def segment_cells(rows: DataFrame, pad: float) -> DataFrame:
    """A row (_cx, _cy) for each cell of a segment's own _size that it passes through, or by at pad. rows: x1, y1, x2, y2, _size, …

    A long segment is in a line of cells, not in all of its box.
    """
    size, slope = F.col("_size"), F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    low, high = F.least("x1", "x2") - pad, F.greatest("x1", "x2") + pad
    columns = rows.withColumn("_cx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    held = lambda y: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
    at = lambda x: held(F.col("y1") + slope * (x - F.col("x1")))
    # What a slope adds within the pad beside a column's borders is at most the pad times the slope.
    wide = F.lit(2 * pad) * (1 + F.coalesce(F.abs(slope), F.lit(0.0)))
    left, right = at(F.col("_cx") * size), at((F.col("_cx") + 1) * size)
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    low_y = F.when(slope.isNull(), bottom - 2 * pad).otherwise(F.greatest(bottom - 2 * pad, F.least(left, right) - wide))
    high_y = F.when(slope.isNull(), top + 2 * pad).otherwise(F.least(top + 2 * pad, F.greatest(left, right) + wide))
    return columns.withColumn("_cy", F.explode(F.sequence(F.floor(low_y / size), F.floor(high_y / size))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float | None = None) -> DataFrame:
    """Each point strictly inside a box: point, box. points: id, lon, lat; boxes: id, west, south, east, north (longs or doubles).

    Cells are half as large as the boxes are on average, if no size is given.
    """
    if size is None:
        span = F.when(F.col("west") <= F.col("east"), F.col("east") - F.col("west")).otherwise(F.col("east") - F.col("west") + 360)
        size = max(float(boxes.select(F.avg(F.greatest(span, F.col("north") - F.col("south")))).first()[0] or 2.0) / 2, 1e-6)
    at = points.select(F.col("id").alias("point"), "lon", "lat", cell(F.col("lon"), size).alias("_cx"), cell(F.col("lat"), size).alias("_cy"))
    held = box_cells(boxes.withColumnRenamed("id", "box"), size)
    inside = (F.col("lat") > F.col("south")) & (F.col("lat") < F.col("north"))
    across = F.when(F.col("west") <= F.col("east"), (F.col("lon") > F.col("west")) & (F.col("lon") < F.col("east"))).otherwise((F.col("lon") > F.col("west")) | (F.col("lon") < F.col("east")))
    return at.join(small(held), ["_cx", "_cy"]).filter(inside & across).select("point", "box").distinct()


def pairs_within(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """Pairs at most so far apart: a, b, metres. Both: id, lon, lat. Cells are strips of latitude, split by longitude as wide as that strip needs."""
    size = max(metres / METRES_PER_DEGREE, 1e-6)

    def strips(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.col("lon").alias(f"lon_{name}"), F.col("lat").alias(f"lat_{name}"))

    def width(row: Column) -> Column:
        """Degrees of longitude that the distance spans at most in a strip or its neighbours; 360 near the poles."""
        most = F.least(F.lit(89.9), F.greatest(F.abs(row * size), F.abs((row + 1) * size)) + size)
        return F.when(most >= 89.0, F.lit(360.0)).otherwise(F.least(F.lit(360.0), F.lit(1.05 * size) / F.cos(F.radians(most))))

    def column(lon: Column, row: Column) -> Column:
        return F.floor(F.pmod(lon, F.lit(360.0)) / width(row)).cast("long")

    left = strips(points, "a").withColumn("_row", cell(F.col("lat_a"), size))
    left = left.withColumn("_col", column(F.col("lon_a"), F.col("_row")))
    right = strips(others, "b").withColumn("_row", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: cell(F.col("lat_b"), size) + d)))
    count = F.greatest(F.lit(1), F.ceil(F.lit(360.0) / width(F.col("_row"))).cast("long"))
    # The last column of a row may be narrow, so two columns on each side are looked at.
    right = right.withColumn("_col", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]), lambda d: F.pmod(column(F.col("lon_b"), F.col("_row")) + d, count)))))
    far = haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return left.join(right, ["_row", "_col"]).withColumn("metres", far).filter(F.col("metres") <= metres).select("a", "b", "metres")


def nearest_within(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """The nearest of the others to each point that has one so near, the least id of equals: a, b, metres."""
    found = pairs_within(points, others, metres)
    return found.groupBy("a").agg(F.min(F.struct("metres", "b")).alias("r")).select("a", "r.b", "r.metres")


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Convex hull by group: key, ring (array of [lon, lat], counter-clockwise from the least point), area in square degrees.

    Each partition first reduces its points of a group to their hull, so that a large group reaches one task as a few points.
    """

    def chain(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        rows = sorted(set(rows))
        if len(rows) < 3:
            return rows
        out: list[tuple[float, float]] = []
        for sweep in (rows, rows[::-1]):
            part: list[tuple[float, float]] = []
            for p in sweep:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                    part.pop()
                part.append(p)
            out += part[:-1]
        return out

    def local(frames):
        for frame in frames:
            rows = [(k, x, y) for k, group in frame.groupby(key, dropna=False) for x, y in chain(list(zip(group.lon, group.lat, strict=True)))]
            yield pd.DataFrame(rows, columns=[key, "lon", "lat"])

    def whole(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ring = chain(list(zip(frame.lon, frame.lat, strict=True)))
        area = abs(math.fsum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        return pd.DataFrame({key: [k[0]], "ring": [[list(p) for p in ring]], "area": [area]})

    kind = points.schema[key].dataType.simpleString()
    rows = points.filter("lon IS NOT NULL AND lat IS NOT NULL").select(key, "lon", "lat").mapInPandas(local, f"`{key}` {kind}, lon double, lat double")
    return rows.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, ring array<array<double>>, area double")


def drawn_hulls(points: DataFrame, key: str, reach: float) -> DataFrame:
    """key, ring: the convex hull of each group; around one point a square and along two a band, `reach` degrees to each side.

    A group with points beyond 150 degrees on both sides of the antimeridian is drawn over it, with longitudes up to 360.
    """
    known = points.filter("lon IS NOT NULL AND lat IS NOT NULL")
    first, last = F.min(F.struct("lon", "lat")), F.max(F.struct("lon", "lat"))
    crosses = points.groupBy(key).agg((F.bool_or(F.col("lon") > 150) & F.bool_or(F.col("lon") < -150)).alias("_over"))
    over = F.when(F.col("_over") & (F.col("lon") < 0), F.col("lon") + 360).otherwise(F.col("lon"))
    moved = known.join(crosses.hint("merge"), key).select(key, over.alias("lon"), "lat")
    # A group whose points are the least and the greatest alone needs no hull, and there may be millions of such groups.
    ends = moved.groupBy(key).agg(first.alias("_a"), last.alias("_b"))
    between = (F.struct("lon", "lat") != F.col("_a")) & (F.struct("lon", "lat") != F.col("_b"))
    sizes = moved.join(ends.hint("merge"), key).groupBy(key).agg(F.bool_or(between).alias("_many"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    corners = lambda *names: F.array(*[F.array(F.col(n)["lon"], F.col(n)["lat"]) for n in names])
    few = sizes.filter("NOT _many").select(key, F.when(F.col("_a") == F.col("_b"), corners("_a")).otherwise(corners("_a", "_b")).alias("ring"))
    large = moved.join(sizes.filter("_many").select(key).hint("merge"), key, "left_semi")
    at = lambda k: F.get("ring", F.lit(k))
    a, b = at(0), at(1)
    x, y = b[1] - a[1], a[0] - b[0]
    size = F.sqrt(x * x + y * y)
    dx, dy = x / size * reach, y / size * reach
    corner = lambda p, u, v: F.array(p[0] + u, p[1] + v)
    square = F.array(*[corner(a, F.lit(u * reach), F.lit(v * reach)) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    band = F.array(corner(a, dx, dy), corner(b, dx, dy), corner(b, -dx, -dy), corner(a, -dx, -dy))
    return few.unionByName(hulls(large, key).select(key, "ring")).select(key, F.when(F.size("ring") == 1, square).when(F.size("ring") == 2, band).otherwise(F.col("ring")).alias("ring"))


def outer_edges(edges: DataFrame, key: str) -> DataFrame:
    """Borders of merged faces that share vertices: edges (key, x1, y1, x2, y2) met once stay, those of two faces cancel."""
    turned = F.struct("x1", "y1") > F.struct("x2", "y2")
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return edges.select(key, *ends).groupBy(key, "x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
