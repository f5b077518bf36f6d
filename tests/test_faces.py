"""Unions, repairs, borders and hulls against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import polygon
from terrace.operators import areas, faces
from tests.test_areas import even_odd, ring, star

POLYGONS = "grp long, owner long, rings array<array<struct<lon:double,lat:double>>>"
AREAS = "area long, rings array<array<struct<lon:double,lat:double>>>"


def square(x, y, w, h=None):
    h = w if h is None else h
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def shoelace(r):
    return sum(a["lon"] * b["lat"] - b["lon"] * a["lat"] for a, b in zip(r, r[1:], strict=False)) / 2


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.grp, []).append([[p.asDict() for p in x] for x in r.rings])
    return out


def cells_of(boxes):
    return {(x, y) for a, b, w, h in boxes for x in range(a, a + w) for y in range(b, b + h)}


def components(cells):
    """Cells joined along sides: the shells of a union, as what meets in a corner is apart."""
    left, n = set(cells), 0
    while left:
        n, waiting = n + 1, [left.pop()]
        while waiting:
            x, y = waiting.pop()
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            waiting += near
    return n


def test_unions_of_boxes_against_cells(spark):
    """Boxes that overlap, share borders in part, hold each other and touch in corners."""
    rng = random.Random(1)
    groups = {g: [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 9))] for g in range(25)}
    groups[90] = [(x, y, 1, 1) for x in range(6) for y in range(6) if (x, y) not in ((1, 1), (3, 3), (4, 3), (0, 0))]
    rows = [(g, k, [square(*map(float, b))]) for g, boxes in groups.items() for k, b in enumerate(boxes)]
    got = collected(faces.united(spark.createDataFrame(rows, POLYGONS)))
    assert got.keys() == groups.keys()
    for g, boxes in groups.items():
        cells = cells_of(boxes)
        assert sum(shoelace(r) for part in got[g] for r in part) == pytest.approx(len(cells))
        assert len(got[g]) == components(cells)
        assert all(shoelace(part[0]) > 0 and all(shoelace(h) < 0 for h in part[1:]) and all(r[0] == r[-1] for r in part) for part in got[g])
        for x in range(-1, 15):
            for y in range(-1, 15):
                assert sum(even_odd(part, x + 0.5, y + 0.5) for part in got[g]) == ((x, y) in cells)


def test_unions_of_stars(spark):
    rng = random.Random(2)
    groups = {g: [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(5)] for g in range(8)}
    got = collected(faces.united(spark.createDataFrame([(g, k, [r]) for g, rs in groups.items() for k, r in enumerate(rs)], POLYGONS)))
    for g, rs in groups.items():
        for _ in range(400):
            x, y = rng.uniform(-4, 4), rng.uniform(-4, 4)
            assert sum(even_odd(part, x, y) for part in got[g]) == any(even_odd([r], x, y) for r in rs)


def test_repaired_rings_against_the_even_odd_rule(spark):
    rng = random.Random(3)
    shapes = {0: [ring((0, 0), (2, 2), (2, 0), (0, 2))], 1: [square(0, 0, 4), square(0, 0, 4)], 2: [square(0, 0, 4), square(1, 1, 2), square(1, 1, 2), square(2, 2, 1)]}
    shapes |= {k: [ring(*[(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(rng.randrange(4, 9))])] for k in range(3, 15)}
    shapes[20] = [ring((0, 0), (3, 0), (3, 3), (1.5, 0), (0, 3))]
    rows = spark.createDataFrame([(k, 0, r) for k, r in shapes.items()], POLYGONS)
    got = collected(faces.repaired(rows.select("grp", "rings")))
    assert 1 not in got and len(got[0]) == 2
    for k, rings in shapes.items():
        for _ in range(300):
            x, y = rng.uniform(-0.5, 5.5), rng.uniform(-0.5, 5.5)
            assert sum(even_odd(part, x, y) for part in got.get(k, [])) == even_odd(rings, x, y)


def test_area_outside_covers_that_overlap(spark):
    rng = random.Random(4)
    targets = [(k, [square(*map(float, (rng.randrange(9), rng.randrange(9), rng.randrange(1, 6), rng.randrange(1, 6))))]) for k in range(20)] + [(99, [square(50.0, 50.0, 2.0)])]
    covers = [(k, [square(*map(float, (rng.randrange(9), rng.randrange(9), rng.randrange(1, 4), rng.randrange(1, 4))))]) for k in range(6)] + [(6, covers_ring) for covers_ring in ([square(0.0, 0.0, 3.0)],)] + [(7, [square(0.0, 0.0, 3.0)])]
    box = lambda r: cells_of([(int(r[0]["lon"]), int(r[0]["lat"]), int(r[1]["lon"] - r[0]["lon"]), int(r[2]["lat"] - r[1]["lat"]))])
    held = set().union(*(box(r[0]) for _, r in covers))
    got = {r.area: (r.whole, r.open) for r in faces.outside_area(spark.createDataFrame(targets, AREAS), spark.createDataFrame(covers, AREAS)).collect()}
    assert got.keys() == {k for k, _ in targets}
    for k, r in targets:
        assert got[k] == pytest.approx((len(box(r[0])), len(box(r[0]) - held)))


def test_rings_of_many_edges(spark):
    """A ring's edges in any order, and two rings of one group."""
    n, rng = 700, random.Random(5)
    circle = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    edges = [(1, *a, *b) for a, b in zip(circle, circle[1:] + circle[:1], strict=True)] + [(1, 5.0, 0.0, 6.0, 0.0), (1, 6.0, 0.0, 5.0, 1.0), (1, 5.0, 1.0, 5.0, 0.0)]
    rng.shuffle(edges)
    got = faces.stitched(spark.createDataFrame(edges, "grp long, ax double, ay double, bx double, by double")).collect()
    assert sorted(len(r.points) for r in got) == [4, n + 1]
    long = max(got, key=lambda r: len(r.points)).points
    at = circle.index((long[0].lon, long[0].lat))
    assert [(p.lon, p.lat) for p in long] == [circle[(at + k) % n] for k in range(n + 1)]


def flat_metres(lon, lat, a, b):
    x, y = (lambda v: (v - lon) * math.cos(math.radians(lat)) * 111_320.0), (lambda v: (v - lat) * 110_540.0)
    ax, ay, bx, by = x(a["lon"]), y(a["lat"]), x(b["lon"]), y(b["lat"])
    d = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / d)) if d else 0.0
    return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def to_border(rings, lon, lat):
    return min(flat_metres(lon + turn, lat, a, b) for turn in (-360, 0, 360) for r in rings for a, b in zip(r, r[1:], strict=False))


SHAPES = [(1, [square(-179.9, -5.0, 1.0)]), (2, [square(170.0, 60.0, 9.99)]), (3, [square(0.0, 0.0, 0.1)]), (4, [square(-100.0, -80.0, 120.0)]), (5, [square(10.0, 89.2, 3.0, 0.5)]), (6, [square(0.3, 0.0, 0.1)])]


def test_nearest_border_against_all(spark):
    rng = random.Random(6)
    points = [(k, rng.uniform(-180, 180), rng.uniform(-89.9, 89.9)) for k in range(150)] + [(900, 179.98, -4.5), (901, -179.98, 65.0), (902, -100.0, 89.8), (903, 0.2, 0.05)]
    got = {r.place: (r.area, r.metres) for r in areas.nearest_borders(spark.createDataFrame(points, "place long, lon double, lat double"), spark.createDataFrame(SHAPES, AREAS)).collect()}
    for k, lon, lat in points:
        inside = [a for a, r in SHAPES if even_odd(r, lon, lat)]
        metres, area = (0.0, min(inside)) if inside else min((to_border(r, lon, lat), a) for a, r in SHAPES)
        assert got[k][0] == area and got[k][1] == pytest.approx(metres), (k, lon, lat)


def test_nearest_within_reach_over_the_antimeridian(spark):
    points = [(1, 179.98, -4.5), (2, 178.0, -4.5), (3, -179.5, -4.5)]
    got = {r.place: r.area for r in areas.containing_or_nearest(spark.createDataFrame(points, "place long, lon double, lat double"), spark.createDataFrame(SHAPES, AREAS), 20_000).collect()}
    assert got == {1: 1, 3: 1}


def test_one_huge_polygon_among_small_ones(spark):
    rng = random.Random(7)
    shapes = [(k, [square(rng.uniform(-170, 170), rng.uniform(-80, 80), 0.1)]) for k in range(400)] + [(1000, [square(-60.0, -60.0, 120.0)])]
    rows = areas.leveled(spark.createDataFrame(shapes, AREAS))
    cells = areas.in_cells(rows)
    assert cells.filter("area = 1000").count() <= 300 and cells.count() < 5 * 400 + 300
    points = [(k, rng.uniform(-170, 170), rng.uniform(-80, 80)) for k in range(300)] + [(1000 + k, r[0][0]["lon"] + 0.05, r[0][0]["lat"] + 0.05) for k, r in shapes[:40]]
    got = {tuple(r) for r in areas.points_in_areas(spark.createDataFrame(points, "place long, lon double, lat double"), spark.createDataFrame(shapes, AREAS)).collect()}
    assert got == {(k, a) for k, x, y in points for a, r in shapes if even_odd(r, x, y)}
    met = {tuple(r) for r in areas.boxes_meeting(spark.createDataFrame(shapes[:60] + shapes[-1:], AREAS), spark.createDataFrame(shapes, AREAS)).collect()}
    box = lambda r: (r[0][0]["lon"], r[0][0]["lat"], r[0][2]["lon"], r[0][2]["lat"])
    meet = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    assert met == {(a, b) for a, r in shapes[:60] + shapes[-1:] for b, q in shapes if meet(box(r), box(q))}
    assert polygon and F
