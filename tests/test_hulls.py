"""Concave hulls against brute-force carving."""

import itertools
import math
import random

import pytest

from terrace.operators import hulls
from tests.test_areas import even_odd
from tests.test_faces import shoelace

POINTS = "grp long, lon double, lat double"


def cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def in_circle(a, b, c, d):
    rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    sa, sb, sc = (x * x + y * y for x, y in rows)
    return ax * (by * sc - sb * cy) - ay * (bx * sc - sb * cx) + sa * (bx * cy - by * cx) > 1e-9


def plain_triangles(points):
    """Every counterclockwise triangle whose circle holds no other point."""
    out = set()
    for a, b, c in itertools.combinations(range(len(points)), 3):
        t = cross(points[a], points[b], points[c])
        if t:
            a, b, c = (a, b, c) if t > 0 else (a, c, b)
            if not any(in_circle(points[a], points[b], points[c], points[d]) for d in range(len(points)) if d not in (a, b, c)):
                out.add((a, b, c))
    return out


def degrees(p, q):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, v)) for v in (p, q))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h)))


def plain_parts(triangles):
    """How many forms triangles joined along edges make; what meets in a corner is apart."""
    left, n = set(triangles), 0
    edges = lambda t: {frozenset(e) for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    while left:
        n, waiting = n + 1, [left.pop()]
        while waiting:
            t = waiting.pop()
            near = {u for u in left if edges(u) & edges(t)}
            left -= near
            waiting += near
    return n


def test_triangulation_against_empty_circles():
    rng = random.Random(1)
    for n in (3, 4, 5, 8, 15, 30):
        points = sorted((rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n))
        assert {tuple(sorted(t)) for t in hulls.delaunay(points)} == {tuple(sorted(t)) for t in plain_triangles(points)}
    grid = sorted((float(x), float(y)) for x in range(7) for y in range(5))
    made = hulls.delaunay(grid)
    assert sum(cross(*(grid[k] for k in t)) / 2 for t in made) == 24 and all(cross(*(grid[k] for k in t)) > 0 for t in made)
    assert hulls.delaunay([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == []
    many = sorted((rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(800))
    made = hulls.delaunay(many)
    assert len({frozenset(t) for t in made}) == len(made) > 1500


@pytest.mark.parametrize("concavity", [0.3, 0.5, 0.9])
def test_carving_against_brute_force(spark, concavity):
    rng = random.Random(2)
    groups = {g: sorted({(rng.choice([0.0, 12.0]) * (g % 2) + rng.uniform(0, 5), rng.uniform(0, 8)) for _ in range(rng.randrange(3, 16))}) for g in range(20)}
    rows = [(g, *p) for g, ps in groups.items() for p in ps]
    got = {r.grp: [[p.asDict() for p in x] for x in r.rings] for r in hulls.carved(spark.createDataFrame(rows, POINTS), concavity).collect()}
    carved = 0
    for g, ps in groups.items():
        most = concavity * max(max(p[k] for p in ps) - min(p[k] for p in ps) for k in (0, 1))
        kept = [t for t in plain_triangles(ps) if max(degrees(ps[a], ps[b]) for a, b in itertools.combinations(t, 2)) <= most]
        whole = plain_parts(kept) == 1
        carved += whole
        kept = kept if whole else list(plain_triangles(ps))
        assert sum(map(shoelace, got[g])) == pytest.approx(sum(cross(*(ps[k] for k in t)) / 2 for t in kept))
        for t in kept[:10]:
            x, y = (sum(ps[k][i] for k in t) / 3 for i in (0, 1))
            assert even_odd(got[g], x, y)
    assert concavity < 0.5 or carved > 5


def test_points_and_lines_have_no_area(spark):
    rows = [(1, 3.0, 4.0), (1, 3.0, 4.0), (2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0)]
    got = {r.grp: r.rings for r in hulls.carved(spark.createDataFrame(rows, POINTS)).collect()}
    assert got.keys() == {1, 2} and {(p.lon, p.lat) for p in got[2][0]} == {(0.0, 0.0), (2.0, 2.0)}
    wide = {r.grp: r.rings for r in hulls.with_margin(hulls.carved(spark.createDataFrame(rows, POINTS)), 111.0).collect()}
    assert all(len(r) == 1 for r in wide.values()) and 2.9 < shoelace(wide[1][0]) < 3.2
    assert even_odd([[p.asDict() for p in wide[2][0]]], 1.3, 0.7) and not even_odd([[p.asDict() for p in wide[2][0]]], 2.0, 0.0)


def test_halves_meet_on_the_antimeridian(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice([-1, 1]) * rng.uniform(174, 179.5), rng.uniform(-20, -15)) for _ in range(20)] + [(1, 179.4, -18.0), (1, -179.4, -17.0), (2, 171.0, 1.0), (2, 175.0, 3.0), (2, 172.0, 5.0), (3, 10.0, 10.0), (4, None, 1.0)]
    got = {(r.grp, r.side): [p for x in r.rings for p in x] for r in hulls.drawn(spark.createDataFrame(rows, POINTS), "grp").collect()}
    assert got.keys() == {(1, "east"), (1, "west"), (2, "whole"), (3, "whole")}
    on = lambda side, lon: [p.lat for p in got[1, side] if p.lon == lon]
    assert (min(on("east", 180.0)), max(on("east", 180.0))) == pytest.approx((min(on("west", -180.0)), max(on("west", -180.0))))
    assert all(p.lon >= 0 for p in got[1, "east"]) and all(p.lon <= 0 for p in got[1, "west"]) and max(p.lon for p in got[2, "whole"]) <= 180
    assert min(p.lat for p in got[3, "whole"]) == pytest.approx(10 - 50 / 111.195, abs=0.01)
