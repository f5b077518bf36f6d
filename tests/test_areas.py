"""Areas, validity and sources against brute force."""

import json
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from terrace.functions import polygon
from terrace.operators import areas
from terrace.sources import files

RINGS = "area long, rings array<array<struct<lon:double,lat:double>>>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in (*points, points[0])]


def star(rng, x, y, n=7):
    import math

    return ring(*[(x + math.cos(2 * math.pi * k / n) * rng.uniform(0.4, 2), y + math.sin(2 * math.pi * k / n) * rng.uniform(0.4, 2)) for k in range(n)])


def even_odd(rings, x, y):
    hits = 0
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a["lat"] > y) != (b["lat"] > y) and x < (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]:
                hits += 1
    return hits % 2 == 1


def test_points_in_stars_with_holes(spark):
    rng = random.Random(3)
    shapes = [(i, [star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8)), ring((0.1 * i, 0), (0.1 * i + 0.3, 0), (0.1 * i, 0.3))]) for i in range(25)]
    points = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(500)]
    got = {tuple(r) for r in areas.points_in_areas(spark.createDataFrame(points, "place long, lon double, lat double"), spark.createDataFrame(shapes, RINGS)).collect()}
    assert got == {(k, i) for k, x, y in points for i, rings in shapes if even_odd(rings, x, y)}
    assert areas.points_in_areas(spark.createDataFrame(points, "place long, lon double, lat double").limit(0), spark.createDataFrame(shapes, RINGS)).count() == 0


def test_points_on_the_border_are_outside(spark):
    square = spark.createDataFrame([(1, [ring((0, 0), (2, 0), (2, 2), (0, 2))])], RINGS)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 2.0), (4, 1.0, 2.0)], "place long, lon double, lat double")
    assert {r.place for r in areas.points_in_areas(points, square).collect()} == {1}


def test_common_area_of_stars():
    rng = random.Random(4)
    for _ in range(20):
        a, b = [star(rng, 0, 0)], [star(rng, 0.7, 0.3), ring((-0.2, 0), (0.2, 0), (0, 0.2))]
        n = 160
        hits = sum(even_odd(a, -3 + 6 * (i + 0.5) / n, -3 + 6 * (j + 0.5) / n) and even_odd(b, -3 + 6 * (i + 0.5) / n, -3 + 6 * (j + 0.5) / n) for i in range(n) for j in range(n))
        assert areas.common_area(a, b) == pytest.approx(hits * 36 / n / n, abs=0.05)
    assert areas.common_area([ring((0, 0), (2, 0), (2, 2), (0, 2))], [ring((1, 1), (3, 1), (3, 3), (1, 3))]) == pytest.approx(1)
    assert areas.common_area([], [ring((0, 0), (1, 0), (0, 1))]) == 0


def test_forms(spark):
    rows = spark.createDataFrame([(1, [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), (2, 1))])], RINGS)
    r = rows.select(polygon.geojson(F.col("rings")).alias("j"), polygon.point_on_surface(F.col("rings")).alias("p"), F.size(polygon.valid(F.col("rings"))).alias("n")).first()
    assert json.loads(r.j)["coordinates"][0][1] == [4.0, 0.0]
    assert (r.p.lat, r.n) == (2.0, 2)
    nothing = spark.createDataFrame([(1, None), (2, [])], RINGS)
    assert [x.v for x in nothing.select(polygon.svg_path(F.col("rings")).alias("v")).collect()] == [None, ""]


def test_simplified_lines(spark):
    wavy = [(x, 0.01 * (x % 2)) for x in range(0, 11)] + [(10, 5), (0, 5)]
    rows = spark.createDataFrame([(1, [ring(*wavy)])], RINGS)
    r = rows.select(areas.simplified(F.col("rings"), 0.1).alias("a"), areas.simplified(F.col("rings"), 0.2, by_area=True).alias("b")).first()
    for out in (r.a, r.b):
        assert {(p.lon, round(p.lat, 1)) for p in out[0]} >= {(10.0, 5.0), (0.0, 5.0)}
        assert len(out[0]) <= 7
    holed = spark.createDataFrame([(1, [ring(*wavy), ring((4, 2), (6, 2), (5, 3))]), (2, None), (3, [])], RINGS)
    assert [r.n for r in holed.select(F.size(areas.simplified(F.col("rings"), 0.1)).alias("n")).collect()] == [2, None, 0]
    both = holed.filter("area = 1")
    assert areas.overlapping(both, both).first().ratio == pytest.approx(1)


def test_geopackage(spark, tmp_path):
    path = f"{tmp_path}/x.gpkg"

    def polygon_bytes(order, points):
        return struct.pack(order + "BIII", 1 if order == "<" else 0, 3, 1, len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)

    square = [(0, 0), (1, 0), (1, 1), (0, 0)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE layer (fid INTEGER PRIMARY KEY, NAME_0 TEXT, geom BLOB)")
        one = b"GP\x00\x01" + struct.pack("<i", 4326) + polygon_bytes("<", square)
        many = b"GP\x00\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + struct.pack(">BII", 0, 6, 2) + polygon_bytes(">", square) + polygon_bytes(">", square)
        db.executemany("INSERT INTO layer VALUES (?, ?, ?)", [(3, "A", one), (9, None, many), (12_000, "C", None)])
    rows = {r.id: r for r in files.geopackage(spark, path, "layer", ["NAME_0"]).collect()}
    assert (rows[3].NAME_0, rows[9].NAME_0, rows[12_000].parts) == ("A", None, None)
    assert [(p.lon, p.lat) for p in rows[3].parts[0][0]] == square
    assert len(rows[9].parts) == 2


def test_json_sources(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('\n [{"id": 1, "name": "A"},\n {"id": 2}]')
    bad.write_text('{"id": 1}')
    assert [(r.id, r.name) for r in files.json_records(spark, str(good), "id long, name string").orderBy("id").collect()] == [(1, "A"), (2, None)]
    with pytest.raises(ValueError):
        files.json_records(spark, str(bad), "id long")
    tree = {"name": "World", "children": [{"name": "Asia", "children": [{"name": "X"}]}, {"name": "Asia", "children": [{"name": "Y"}, {"name": "X"}]}, {"name": "Empty", "children": []}]}
    rows = files.tree_of_names(spark.createDataFrame([(json.dumps(tree),), ("no tree",), (None,)], "value string")).collect()
    assert {("/".join(r.path), r.depth, r.has_children) for r in rows} == {("World", 1, True), ("World/Asia", 2, True), ("World/Asia/X", 3, False), ("World/Asia/Y", 3, False), ("World/Empty", 2, False)}


def test_vector_tiles_read_back(spark):
    from terrace.functions import vector_tiles as vt

    def fields(data):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7:
                size = number()
                yield key >> 3, data[at : at + size]
                at += size
            else:
                yield key >> 3, number()

    def numbers_of(data):
        value = shift = 0
        for b in data:
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                yield value
                value = shift = 0

    rings = [ring((-90, -40), (90, -40), (90, 40), (-90, 40)), ring((-10, -10), (10, -10), (10, 10), (-10, 10))]
    placed = spark.createDataFrame([(5, 0, 0, 0, rings), (5, 1, 0, 0, rings), (6, 6, 0, 0, rings)], "id long, z long, x long, y long, rings array<array<struct<lon:double,lat:double>>>")
    rows = {(r.z, r.x, r.y): bytes(r.mvt) for r in vt.layers(vt.features(placed, F.col("rings"), F.col("id")), "regions").collect()}
    assert rows.keys() == {(0, 0, 0), (1, 0, 0)}, "nothing of the form is on the third tile"
    for data in rows.values():
        ((number, layer),) = fields(data)
        parts = dict(fields(layer))
        assert (number, parts[15], parts[1], parts[5]) == (3, 2, b"regions", 4096)
        feature = dict(fields(parts[2]))
        geometry = list(numbers_of(feature[4]))
        assert (feature[1], feature[3]) == (5, 3)
        assert geometry[0] == 9 and geometry[-1] == 15
    whole = list(numbers_of(dict(fields(dict(fields(dict(fields(rows[(0, 0, 0)]))[3]))[2]))[4]))
    x, y, at, corners = 0, 0, 0, []
    while at < len(whole):
        command, count = whole[at] & 7, whole[at] >> 3
        at += 1
        for _ in range(count if command != 7 else 0):
            x, y = x + ((whole[at] >> 1) ^ -(whole[at] & 1)), y + ((whole[at + 1] >> 1) ^ -(whole[at + 1] & 1))
            corners.append((x, y))
            at += 2
    assert {x for x, _ in corners[:4]} == {1024, 3072} and {x for x, _ in corners[4:]} == {1934, 2162}
    assert len(corners) == 8


def test_trees_too_deep_are_refused(spark):
    import json

    def nested(depth):
        tree = {"name": f"n{depth}"}
        for k in range(depth - 1, 0, -1):
            tree = {"name": f"n{k}", "children": [tree]}
        return json.dumps(tree)

    assert files.tree_of_names(spark.createDataFrame([(nested(files.DEPTH),)], "value string")).count() == files.DEPTH
    with pytest.raises(Exception, match="deeper than"):
        files.tree_of_names(spark.createDataFrame([(nested(files.DEPTH + 1),)], "value string")).collect()


def test_multipolygons_from_text(spark):
    rows = [('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]],[[5.1,5.1],[5.2,5.1],[5.1,5.2],[5.1,5.1]]]]}',), ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}',), ('{"type":"Point","coordinates":[1,2]}',), ("no",)]
    got = spark.createDataFrame(rows, "t string").select(polygon.parts_from_geojson(F.col("t")).alias("p"), polygon.from_geojson(F.col("t")).alias("r")).collect()
    assert [p and [len(x) for x in p] for p, _ in got] == [[1, 2], [1], None, None] and [r and len(r) for _, r in got] == [3, 1, None, None]


def test_points_of_one_spot_are_searched_as_one(spark, monkeypatch):
    searched, inner = [], areas._nearest_of_spots
    monkeypatch.setattr(areas, "_nearest_of_spots", lambda points, *rest: searched.append(points.count()) or inner(points, *rest))
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(7, [ring])], "area long, rings array<array<struct<lon:double,lat:double>>>")
    points = spark.createDataFrame([(k, 0.5, 0.5) for k in range(20)] + [(99, 2.0, 0.5)], "place long, lon double, lat double")
    got = {r.place: (r.area, r.metres > 0) for r in areas.nearest_borders(points, polygons, 500_000.0).collect()}
    assert got == {k: (7, k == 99) for k in [*range(20), 99]}
    assert searched == [2]
