"""Arrangements of polygons: segments noded where they meet, who holds either side of a piece, and rings stitched anew.

Unions, repairs and differences are conditions on what lies left and right of a piece:

1. Segments of one group meet in grid cells that they pass through; each is split where another meets it, so equal pieces
   are one row and no two pieces cross. Coordinates are held to DECIMALS.
2. From a piece's middle a ray is cast across it. How often a polygon's segments cross the ray tells by the even-odd rule
   whether it holds the one side, and with those through the middle the other. Segments meet rays in bands.
3. A condition on both sides picks the pieces of a border and turns them so that what is held lies on their left.
4. Each directed edge goes on to the edge that bounds the same corner. Edges find their ring's least edge and their place in
   it by doubling pointers, so a ring takes as many rounds as its length has binary digits and no task holds a region.

Segments: grp, owner, x1, y1, x2, y2. A group may hold any number of polygons (owners); rings that touch in a point come out
apart where what is held is apart there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import polygon
from terrace.operators.areas import boxes_meeting, points_in_areas, simplified
from terrace.operators.graph import components
from terrace.operators.spatial import segment_cells
from terrace.operators.steps import cut

#: Coordinates are kept to so many decimals; what lies as near to a segment is on it.
DECIMALS, ON = 9, 2e-9
#: A ray that passes so near to a segment's crossing goes through it.
THROUGH = 1e-8
#: Segments in a band, about.
BAND = 8


def segments(polygons: DataFrame, group: str = "grp", owner: str = "owner") -> DataFrame:
    """The segments of rows of a group, an owner and rings."""
    e = polygons.select(F.col(group).alias("grp"), F.col(owner).alias("owner"), F.explode(polygon.edges(F.col("rings"))).alias("e"))
    held = lambda c: F.round(F.col(c), DECIMALS)
    rows = e.select("grp", "owner", held("e.a.lon").alias("x1"), held("e.a.lat").alias("y1"), held("e.b.lon").alias("x2"), held("e.b.lat").alias("y2"))
    return rows.filter("x1 <> x2 OR y1 <> y2")


def _sizes(rows: DataFrame) -> DataFrame:
    """grp, _size: half the mean extent of a group's segments, in whose cells they meet."""
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return rows.groupBy("grp").agg(F.greatest(F.avg(extent) / 2, F.lit(1e-6)).alias("_size"))


def _off(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far a point is from a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return F.sqrt(F.pow(px - x1 - t * dx, F.lit(2)) + F.pow(py - y1 - t * dy, F.lit(2)))


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def noded(rows: DataFrame) -> DataFrame:
    """grp, px, py, qx, qy (p before q, by x and then y): the pieces of a group's segments, each once; none crosses or overlaps another."""
    ends = _point("x1", "y1"), _point("x2", "y2")
    single = rows.select("grp", F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).distinct()
    flat = single.select("grp", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
    lines = cut(flat.withColumn("s", F.monotonically_increasing_id()))
    celled = segment_cells(lines.join(_sizes(lines), "grp"), ON)
    other = celled.select("grp", "_cx", "_cy", *[F.col(c).alias(f"o{c}") for c in ("s", "x1", "y1", "x2", "y2")])
    pairs = celled.join(other, ["grp", "_cx", "_cy"]).filter("s < os").select("s", "os", "x1", "y1", "x2", "y2", "ox1", "oy1", "ox2", "oy2").distinct()

    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "ox1", "oy1", "ox2", "oy2")}
    mine, theirs = (c["x1"], c["y1"], c["x2"], c["y2"]), (c["ox1"], c["oy1"], c["ox2"], c["oy2"])
    touching = lambda ends, line: [(F.when(_off(*ends[k : k + 2], *line) <= ON, F.struct(ends[k].alias("x"), ends[k + 1].alias("y")))) for k in (0, 2)]
    on_mine, on_theirs = touching(theirs, mine), touching(mine, theirs)
    dx, dy, ex, ey = c["x2"] - c["x1"], c["y2"] - c["y1"], c["ox2"] - c["ox1"], c["oy2"] - c["oy1"]
    turn = dx * ey - dy * ex
    t = F.try_divide((c["ox1"] - c["x1"]) * ey - (c["oy1"] - c["y1"]) * ex, turn)
    u = F.try_divide((c["ox1"] - c["x1"]) * dy - (c["oy1"] - c["y1"]) * dx, turn)
    across = F.when(t.between(0, 1) & u.between(0, 1), F.struct(F.round(c["x1"] + t * dx, DECIMALS).alias("x"), F.round(c["y1"] + t * dy, DECIMALS).alias("y")))
    ends = F.array_compact(F.array(*on_mine, *on_theirs))
    # Where an end lies on the other segment, that end is the place; else they cross in a new one.
    crossing = F.when(F.size(ends) == 0, across)
    found = pairs.select("s", "os", F.array_compact(F.array(*on_mine, crossing)).alias("a"), F.array_compact(F.array(*on_theirs, crossing)).alias("b"))
    splits = found.select(F.explode(F.array(F.struct("s", F.col("a").alias("at")), F.struct(F.col("os").alias("s"), F.col("b").alias("at")))).alias("r")).select("r.s", F.explode("r.at").alias("at"))
    at = splits.groupBy("s").agg(F.collect_set("at").alias("at"))
    whole = lines.join(at, "s", "left")
    along = lambda p: F.struct(((p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))).alias("t"), p["x"].alias("x"), p["y"].alias("y"))
    own = F.array(_point("x1", "y1"), _point("x2", "y2"))
    points = F.array_sort(F.transform(F.array_union(own, F.coalesce("at", F.slice(own, 1, 0))), along))
    steps = whole.select("grp", points.alias("_p")).select("grp", F.explode(F.transform(F.sequence(F.lit(0), F.size("_p") - 2), lambda k: F.struct(F.get("_p", k).alias("a"), F.get("_p", k + 1).alias("b")))).alias("e"))
    ends = _point("e.a.x", "e.a.y"), _point("e.b.x", "e.b.y")
    ordered = steps.select("grp", F.least(*ends).alias("p"), F.greatest(*ends).alias("q"))
    return cut(ordered.filter("p <> q").distinct().select("grp", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy")))


def sides(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """The pieces with left and right: the sorted owners that hold what lies on either side of the way from p to q. rows: segments of the same groups."""
    numbered = cut(pieces.withColumn("piece", F.monotonically_increasing_id()))
    steep = F.abs(F.col("qy") - F.col("py")) >= F.abs(F.col("qx") - F.col("px"))
    mx, my = (F.col("px") + F.col("qx")) / 2, (F.col("py") + F.col("qy")) / 2
    # A steep piece's ray goes east, another's north: v is the place across the ray's way, w the place along it.
    rays = numbered.select("grp", "piece", steep.alias("east"), F.when(steep, my).otherwise(mx).alias("v"), F.when(steep, mx).otherwise(my).alias("w"))
    extent = rows.groupBy("grp").agg(((F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))) + (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")))).alias("_e"), F.count("*").alias("_n"))
    band = extent.select("grp", F.greatest(F.col("_e") * BAND / (2 * F.col("_n")), F.lit(1e-6)).alias("_band"))
    turned = rows.select("grp", "owner", F.explode(F.array(
        F.struct(F.lit(True).alias("east"), F.col("y1").alias("v1"), F.col("x1").alias("w1"), F.col("y2").alias("v2"), F.col("x2").alias("w2")),
        F.struct(F.lit(False).alias("east"), F.col("x1").alias("v1"), F.col("y1").alias("w1"), F.col("x2").alias("v2"), F.col("y2").alias("w2")),
    )).alias("t")).select("grp", "owner", "t.*").filter("v1 <> v2")
    banded = turned.join(band, "grp").withColumn("_k", F.explode(F.sequence(F.floor(F.least("v1", "v2") / F.col("_band")), F.floor(F.greatest("v1", "v2") / F.col("_band"))))).drop("_band")
    cast = rays.join(band, "grp").withColumn("_k", F.floor(F.col("v") / F.col("_band"))).drop("_band")
    hit = cast.join(banded, ["grp", "east", "_k"]).filter((F.col("v1") > F.col("v")) != (F.col("v2") > F.col("v")))
    at = F.col("w1") + (F.col("w2") - F.col("w1")) * (F.col("v") - F.col("v1")) / (F.col("v2") - F.col("v1")) - F.col("w")
    tally = hit.groupBy("piece", "owner").agg(F.count_if(at > THROUGH).alias("beyond"), F.count_if(F.abs(at) <= THROUGH).alias("through"))
    odd = lambda c: F.array_sort(F.collect_list(F.when(c % 2 == 1, F.col("owner"))))
    held = tally.groupBy("piece").agg(odd(F.col("beyond")).alias("far"), odd(F.col("beyond") + F.col("through")).alias("near"))
    out = numbered.join(held, "piece", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(held.schema["far"].dataType))
    # Going up, the east is on the right; a flat piece goes east, and the north is on its left.
    far_is_left = ~steep | (F.col("qy") < F.col("py"))
    return cut(out.select("grp", "px", "py", "qx", "qy", F.when(far_is_left, empty(F.col("far"))).otherwise(empty(F.col("near"))).alias("left"), F.when(far_is_left, empty(F.col("near"))).otherwise(empty(F.col("far"))).alias("right")))


def border(sided: DataFrame, held) -> DataFrame:
    """Directed edges grp, ax, ay, bx, by with what is held on their left: held(owners) tells it of a side."""
    left, right = held(F.col("left")), held(F.col("right"))
    kept = sided.filter(left != right)
    forth = [F.when(left, F.col(f"p{k}")).otherwise(F.col(f"q{k}")).alias(f"a{k}") for k in "xy"]
    back = [F.when(left, F.col(f"q{k}")).otherwise(F.col(f"p{k}")).alias(f"b{k}") for k in "xy"]
    return kept.select("grp", *forth, *back)


def border_area(edges: DataFrame) -> DataFrame:
    """grp, area: the area within a border's directed edges, in square degrees; no ring is needed for it."""
    return edges.groupBy("grp").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))


def cancelled(edges: DataFrame) -> DataFrame:
    """Directed edges without those that another one runs against."""
    a, b = _point("ax", "ay"), _point("bx", "by")
    net = edges.select("grp", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.when(a < b, 1).otherwise(-1).alias("w")).groupBy("grp", "p", "q").agg(F.sum("w").alias("w")).filter("w <> 0")
    way = lambda first, second, k: F.when(F.col("w") > 0, F.col(f"{first}.{k}")).otherwise(F.col(f"{second}.{k}"))
    return net.select("grp", way("p", "q", "x").alias("ax"), way("p", "q", "y").alias("ay"), way("q", "p", "x").alias("bx"), way("q", "p", "y").alias("by"))


def _ahead(rows: DataFrame, columns: list[str]) -> DataFrame:
    """r, d: each row (e, to, …) that goes on, and the columns of the row that it goes on to. At most one row goes on to another.

    What asks and what is asked for meet in a group of two, with one shuffle and without a join of the table with itself.
    """
    asked = rows.select(F.col("e").alias("_at"), F.struct(*columns).alias("d"))
    asks = rows.filter("to IS NOT NULL").select(F.col("to").alias("_at"), F.struct("e", *columns).alias("r"))
    return asked.unionByName(asks, allowMissingColumns=True).groupBy("_at").agg(F.max("d").alias("d"), F.max("r").alias("r")).filter("r IS NOT NULL")


def stitched(edges: DataFrame) -> DataFrame:
    """grp, ring (a number), points (a closed array of lon, lat), area (below 0 for a hole): the rings of directed edges with what is held on their left."""
    numbered = cut(edges.withColumn("e", F.monotonically_increasing_id()))
    # At its end an edge goes on to the first edge clockwise from the way it came: what lies between is the corner that both bound.
    ahead = numbered.select("grp", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("e").alias("next"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("out"))
    come = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    clockwise = F.pmod(come - F.col("out"), F.lit(6.283185307179586))
    after = numbered.join(ahead, ["grp", "bx", "by"]).groupBy("e").agg(F.min_by("next", F.struct(F.when(clockwise <= 1e-12, 7.0).otherwise(clockwise), "next")).alias("next"))
    after = cut(after)

    # The least edge of each ring.
    known = cut(after.select("e", F.col("next").alias("to"), F.least("e", "next").alias("ring")))
    while True:
        met = _ahead(known, ["to", "ring"])
        stepped = cut(met.select(F.col("r.e").alias("e"), F.col("d.to").alias("to"), F.least("r.ring", "d.ring").alias("ring"), (F.col("d.ring") < F.col("r.ring")).alias("_changed")))
        known = stepped.drop("_changed")
        if stepped.filter("_changed").isEmpty():
            break
    # How many edges there are from each one on to its ring's least edge.
    left = cut(after.join(known.select("e", "ring"), "e").select("e", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("rest")))
    edges_in_all = numbered.count()
    for _ in range(edges_in_all.bit_length() + 1):
        if left.filter("to IS NOT NULL").isEmpty():
            break
        jumped = _ahead(left, ["ring", "to", "rest"]).select(F.col("r.e").alias("e"), F.col("r.ring").alias("ring"), F.col("d.to").alias("to"), (F.col("r.rest") + F.col("d.rest")).alias("rest"))
        left = cut(left.filter("to IS NULL").unionByName(jumped))
    if left.filter("to IS NULL").count() != edges_in_all:
        raise ValueError("the edges do not close to rings")
    placed = numbered.join(left.select("e", "ring", "rest"), "e")
    term = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    points = placed.groupBy("grp", "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("rest")).alias("k"), "ax", "ay"))).alias("p"), (F.sum(term) / 2).alias("area"))
    line = F.transform("p", lambda s: F.struct(s["ax"].alias("lon"), s["ay"].alias("lat")))
    return points.select("grp", "ring", F.concat(line, F.slice(line, 1, 1)).alias("points"), "area")


def assembled(rings: DataFrame) -> DataFrame:
    """grp, part (a number), rings: each shell with the holes in it, the shell first. A hole is in the smallest shell of its group that holds it."""
    rings = cut(rings)
    shells, holes = rings.filter("area > 0"), rings.filter("area < 0")
    first, second = (F.get("points", F.lit(k)) for k in (0, 1))
    # The middle of a hole's first edge is on no other ring's corner.
    inner = holes.select(F.col("ring").alias("place"), ((first["lon"] + second["lon"]) / 2).alias("lon"), ((first["lat"] + second["lat"]) / 2).alias("lat"))
    inside = points_in_areas(inner, shells.select(F.col("ring").alias("area"), F.array("points").alias("rings")))
    of = shells.select("grp", F.col("ring").alias("_shell"), F.col("area").alias("_size"))
    met = inside.join(of, F.col("area") == F.col("_shell")).join(holes.select("grp", F.col("ring").alias("place")), ["grp", "place"])
    home = met.groupBy("place").agg(F.min_by("_shell", F.struct("_size", "_shell")).alias("part"))
    within = holes.join(home, F.col("ring") == F.col("place")).select("part", "ring", "points")
    gathered = within.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("_holes"))
    joined = shells.withColumnRenamed("ring", "part").join(gathered, "part", "left")
    return joined.select("grp", "part", F.when(F.col("_holes").isNull(), F.array("points")).otherwise(F.concat(F.array("points"), F.col("_holes"))).alias("rings"))


def united(polygons: DataFrame) -> DataFrame:
    """grp, part, rings: the union of each group's polygons (grp, owner, rings), whatever they share or overlap."""
    rows = cut(segments(polygons))
    return assembled(stitched(border(sides(noded(rows), rows), lambda owners: F.size(owners) > 0)))


def repaired(polygons: DataFrame) -> DataFrame:
    """grp, part, rings: polygons (grp, rings) made valid: rings that cross themselves or each other become the faces that the even-odd rule holds."""
    rows = cut(segments(polygons.withColumn("owner", F.lit(1))))
    return assembled(stitched(border(sides(noded(rows), rows), lambda owners: F.size(owners) > 0)))


def outside_area(targets: DataFrame, covers: DataFrame) -> DataFrame:
    """area, whole, open: a target's area and what of it lies outside all covers, however these overlap. Both: area, rings, rows of one area have ids of their own.

    A target is worked on with the covers whose box meets its own.
    """
    near = boxes_meeting(targets, covers)
    own = targets.select(F.col("area").alias("grp"), F.lit(-1).cast("long").alias("owner"), "rings")
    others = near.join(covers.select(F.col("area").alias("b"), "rings"), "b").select(F.col("a").alias("grp"), F.col("b").cast("long").alias("owner"), "rings")
    rows = cut(segments(own.unionByName(others)))
    sided = sides(noded(rows), rows)
    whole = border_area(border(sided, lambda owners: F.array_contains(owners, F.lit(-1).cast("long"))))
    free = border_area(border(sided, lambda owners: F.array_contains(owners, F.lit(-1).cast("long")) & (F.size(owners) == 1)))
    return whole.select(F.col("grp").alias("area"), F.col("area").alias("whole")).join(free.select(F.col("grp").alias("area"), F.col("area").alias("open")), "area", "left").fillna(0.0, ["open"])


def snapped(polygons: DataFrame, tolerance: float) -> DataFrame:
    """Polygons (grp, owner, rings) whose corners within the tolerance of each other are one corner, the least of those in a chain.

    Corners of one group meet in cells as wide as the tolerance; only chains of near corners are joined, never all pairs.
    """
    corners = polygons.select("grp", "owner", F.posexplode("rings").alias("ring", "_line")).select("grp", "owner", "ring", F.posexplode("_line").alias("k", "p"))
    corners = corners.select("grp", "owner", "ring", "k", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
    single = cut(corners.select("grp", "x", "y").distinct().withColumn("c", F.monotonically_increasing_id()))
    at = single.withColumn("_cx", F.floor(F.col("x") / tolerance)).withColumn("_cy", F.floor(F.col("y") / tolerance))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    beside = at.select("grp", F.col("c").alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("_cx")).alias("_ux"), F.col("_cy").alias("_uy"), around.alias("d"))
    beside = beside.select("grp", "_c", "_x", "_y", (F.col("_ux") + F.col("d.i")).alias("_cx"), (F.col("_uy") + F.col("d.j")).alias("_cy"))
    near = at.join(beside, ["grp", "_cx", "_cy"]).filter("c < _c").filter(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= tolerance)
    chains = components(single.select(F.col("c").alias("id")), near.select(F.col("c").alias("a"), F.col("_c").alias("b")))
    moved = cut(single.join(chains.select(F.col("id").alias("c"), F.col("component").alias("chain")), "c"))
    least = moved.groupBy("chain").agg(F.min(F.struct(F.col("x").alias("lon"), F.col("y").alias("lat"))).alias("to"))
    to = moved.join(least, "chain").select("grp", "x", "y", "to")
    lines = corners.join(to, ["grp", "x", "y"]).groupBy("grp", "owner", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda s: s["to"]).alias("line"))
    return lines.groupBy("grp", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "line"))), lambda r: r["line"]).alias("rings"))


def region_forms(polygons: DataFrame, tolerance: float = 0.001, simplify: float = 0.0) -> DataFrame:
    """grp, part, rings: a region's form out of its members' (grp, owner, rings): neighbours snapped, united, without holes that are small or slivers, and simplified."""
    made = united(snapped(polygons, tolerance)).withColumn("rings", polygon.kept_rings(F.col("rings")))
    return made.withColumn("rings", simplified(F.col("rings"), simplify)).filter(F.size("rings") > 0) if simplify else made
