"""Vector tiles: rings clipped to a tile and written as features of a layer (Mapbox Vector Tile 2.1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENT, BUFFER = 4096, 64
#: Commands of a geometry.
MOVE, LINE, CLOSE = 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def clipped(points: np.ndarray, low: float, high: float) -> np.ndarray:
    """A closed ring within a square, side by side."""
    for axis, sign, bound in ((0, 1, low), (0, -1, -high), (1, 1, low), (1, -1, -high)):
        if not len(points):
            return points
        inside = sign * points[:, axis] >= bound
        out = []
        for a, b, p, q in zip(points, np.roll(points, -1, axis=0), inside, np.roll(inside, -1), strict=True):
            if p:
                out.append(a)
            if p != q:
                out.append(a + (b - a) * (sign * bound - a[axis]) / (b[axis] - a[axis]))
        points = np.array(out).reshape(-1, 2)
    return points


def commands(rings: list, z: int, x: int, y: int) -> list[int]:
    """The geometry of a feature on a tile; shells run clockwise on the screen, holes the other way."""
    out, at = [], np.zeros(2, int)
    for k, ring in enumerate(rings):
        lon, lat = np.array([p["lon"] for p in ring[:-1]]), np.clip([p["lat"] for p in ring[:-1]], -85.06, 85.06)
        place = np.stack([(lon + 180) / 360, (1 - np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) / np.pi) / 2], axis=1) * 2**z - (x, y)
        points = np.round(clipped(place * EXTENT, -BUFFER, EXTENT + BUFFER)).astype(int)
        if len(points):
            points = points[np.any(points != np.roll(points, 1, axis=0), axis=1)]
        turn = np.roll(points, -1, axis=0) if len(points) else points
        area = int((points[:, 0] * turn[:, 1] - turn[:, 0] * points[:, 1]).sum()) if len(points) > 2 else 0
        if not area:
            continue
        points = points if (area > 0) == (k == 0) else points[::-1]
        steps = np.diff(np.vstack([at, points]), axis=0)
        coded = ((steps << 1) ^ (steps >> 63)).tolist()
        out += [MOVE | 1 << 3, *coded[0], LINE | (len(coded) - 1) << 3, *(v for pair in coded[1:] for v in pair), CLOSE | 1 << 3]
        at = points[-1]
    return out


def features(placed: DataFrame, rings: Column, feature_id: Column) -> DataFrame:
    """Adds _feature, the bytes of one feature on the tile z, x, y; rows whose form leaves nothing there go."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for a, b, c, i, form in zip(*(x.to_pylist() for x in columns), strict=True):
            body = b"".join(map(varint, commands(form or [], a, b, c)))
            out.append(field(2, field(1, i) + field(3, 3) + field(4, body)) if body else None)
        return pa.array(out, pa.binary())

    made = placed.withColumn("_feature", F.arrow_udf(run, "binary")("z", "x", "y", feature_id, rings))
    return made.filter("_feature IS NOT NULL")


def layers(rows: DataFrame, name: str) -> DataFrame:
    """z, x, y, mvt: a tile of one layer out of rows with _feature, ordered by id. A tile is one value by its nature."""
    head, tail = field(15, 2) + field(1, name.encode()), field(5, EXTENT)

    def run(parts: pa.Array) -> pa.Array:
        return pa.array([field(3, head + b"".join(p) + tail) for p in parts.to_pylist()], pa.binary())

    joined = rows.groupBy("z", "x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_feature"))), lambda s: s["_feature"]).alias("_parts"))
    return joined.select("z", "x", "y", F.arrow_udf(run, "binary")("_parts").alias("mvt"))
