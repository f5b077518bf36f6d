"""Every query with SQL against DuckDB; the rest against brute force."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import changes, graph, hierarchy, spatial, steps
from terrace.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_closure_of_cycles_and_several_parents(spark):
    edges = [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 7), (7, 6)]
    links = {(r.node, r.ancestor): r.distance for r in hierarchy.closure(spark.createDataFrame(edges, "id long, parent_id long")).collect()}
    assert links[(5, 1)] == 3
    assert links[(4, 1)] == 2
    assert links[(6, 7)] == links[(7, 6)] == 1
    assert links[(6, 6)] == 0


def test_simplified_against_brute_force(spark):
    rng = random.Random(2)
    tree = [(k, k // 3 if k > 3 else None, f"n{k}") for k in range(1, 80)]
    members = {(g, k) for g in (1, 2) for k, *_ in tree if rng.random() < (0.9 if g == 1 else 0.5)}
    frame = spark.createDataFrame(tree, "id long, parent_id long, name string")
    got = {(r.group_id, r.division) for r in hierarchy.simplified(spark.createDataFrame(sorted(members), "group_id long, division long"), frame).collect()}
    children, held, again = {}, set(members), True
    for k, p, _ in tree:
        children.setdefault(p, set()).add(k)
    while again:
        again = False
        for g in (1, 2):
            own = {d for h, d in held if h == g}
            full = [p for p, c in children.items() if p is not None and c <= own]
            for p in full:
                held, again = held - {(g, c) for c in children[p]} | {(g, p)}, True
    assert got == held


def test_collapsed_and_flattened(spark):
    tree = spark.createDataFrame([(1, None, "A"), (2, 1, "A"), (3, 2, "A"), (4, 3, "B"), (5, 3, "C")], "id long, parent_id long, name string")
    assert {(r.id, r.parent_id) for r in hierarchy.collapsed(tree).collect()} == {(1, None), (4, 1), (5, 1)}
    flat = hierarchy.flattened(tree, hierarchy.closure(tree), tree.filter("id IN (2, 3)"))
    assert {(r.id, r.parent_id) for r in flat.collect()} == {(1, None), (4, 1), (5, 1)}


def test_components_and_fragments(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(1, 60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)]
    nodes = list(range(1, 61)) + list(range(100, 140))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert got == part

    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 1), (7, 1)], "id long, group_id long")
    border = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (4, 6)], "a long, b long")
    found = {(r.component, r.size, r.neighbour) for r in graph.fragments(members, border).collect()}
    assert found == {(6, 1, 2)}, "an island borders nobody"


def test_hulls_and_near_pairs(spark):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 2], rng.uniform(-180, 180), rng.uniform(-89, 89)) for k in range(300)] + [(900, "a", 179.99, 10.0), (901, "b", -179.99, 10.0)]
    points = spark.createDataFrame(rows, "id long, brand string, lon double, lat double")
    for r in spatial.hulls(points, "brand").collect():
        ring, own = r.ring, [(x, y) for _, b, x, y in rows if b == r.brand]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in own)
    far = 900_000
    got = {(r.a, r.b) for r in spatial.pairs_within(points, points, far).collect()}
    other = points.select(F.col("id").alias("b"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    from terrace.functions.geo import haversine

    want = points.crossJoin(other).filter(haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= far)
    assert got == {(r.id, r.b) for r in want.collect()}
    assert (900, 901) in got


def test_names(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert round(value(text.similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))), 4) == 0.3636
    assert value(text.is_prefix_match(F.lit("bavar"), F.lit("bavaria")))
    assert not value(text.is_prefix_match(F.lit("bav"), F.lit("bava")))
    assert value(text.normalised(F.lit(" Île-de-Frânce "))) == "ile-de-france"
    score = value(text.relevance(F.lit("Bavaria"), F.lit("Germany > Bavaria"), F.lit(1), "bavaria"))
    # The parts add up: exact, beginning, trigrams, in the path, in the name, all terms, depth, length.
    assert score == 1000 + 500 + 400 + 300 + 200 + 100 + 90 + 26
    begun = value(text.relevance(F.lit("Bavaria North"), F.lit("Germany > Bavaria North"), F.lit(1), "bavaria", fuzzy=False))
    assert begun == 500 + 300 + 200 + 100 + 90 + 14


def test_components_of_all_order_lines(spark):
    edges = duckdb.sql(f"SELECT DISTINCT l_partkey, l_suppkey + 1000000000 FROM '{FOLDER}/lineitem.parquet'").fetchall()
    tied = {n: n for e in edges for n in e}

    def end(n):
        while tied[n] != n:
            n = tied[n]
        return n

    for a, b in edges:
        low, high = sorted((end(a), end(b)))
        tied[high] = low
    got = {r.id: r.component for r in QUERIES["g13_all_components"](spark, FOLDER).collect()}
    assert got == {n: end(n) for n in tied}


def test_simplified_does_not_broadcast(spark, monkeypatch):
    """Trees and members are large, though their files may be small."""
    plans, cut = [], hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 1, "c")], "id long, parent_id long, name string")
    got = hierarchy.simplified(spark.createDataFrame([(7, 2), (7, 3)], "group_id long, division long"), tree)
    assert [tuple(r) for r in got.collect()] == [(7, 1)]
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_hulls_of_few_points_need_no_group(spark, monkeypatch):
    """Only groups of more than two distinct points are sent to the chain."""
    sent, hulls = [], spatial.hulls
    monkeypatch.setattr(spatial, "hulls", lambda points, key: sent.append({r[0] for r in points.select(key).collect()}) or hulls(points, key))
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 179.0, 1.0), (2, -179.0, 1.0), (2, 179.0, 1.0), (3, 0.0, 0.0), (3, 1.0, 0.0), (3, 0.0, 1.0), (4, None, None)]
    got = {r.k: r.ring for r in spatial.drawn_hulls(spark.createDataFrame(rows, "k long, lon double, lat double"), "k", 0.5).collect()}
    assert sent == [{3}]
    assert got == {1: [[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]], 2: [[179.0, 0.5], [181.0, 0.5], [181.0, 1.5], [179.0, 1.5]], 3: [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]}


def test_visits_of_equal_crowds(spark):
    """Places that the same users saw are one row by object; an object's other places count in its total."""
    from terrace.plans.catalogue_reads import visited_objects

    offered = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 11), (2, 12), (3, 13)], "object_id long, o long")
    seen = spark.createDataFrame([(5, 10), (5, 11), (6, 10), (6, 11), (7, 12)], "user_id long, o long")
    got = {tuple(r) for r in visited_objects(offered, seen, F.col("user_id") + F.col("object_id") == 7).collect()}
    assert got == {(5, 1, 3, "visited"), (6, 2, 1, "partial"), (7, 2, 1, "partial")}


def test_deferred_withdrawals_are_shuffled_once(spark):
    """By object; whatever follows groups within objects."""
    plan = QUERIES["c7_w5_deferred_withdrawals"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_arms_and_what_waits(spark):
    incoming = [(1, 10, "a", 0.0, 0.0), (1, 11, "a", 0.0, 0.0), (1, 12, None, 5.0, 5.0), (1, 13, "b", 0.0, 0.0), (2, 14, None, 5.0, 5.00001), (None, 15, "a", 0.0, 0.0)]
    stored = [(1, 20, "a", 0.0, 0.00001, False, False), (1, 21, "a", 9.0, 9.0, False, False), (1, 22, None, 5.0, 5.0, True, False), (1, 23, "b", 9.0, 9.0, False, True), (2, 24, None, 5.0, 5.0, False, None), (2, 25, "z", 0.0, 0.0, True, False), (None, 26, "a", 0.0, 0.0, False, False)]
    a, b = spark.createDataFrame(incoming, "object_id long, ordinal long, ref string, lon double, lat double"), spark.createDataFrame(stored, "object_id long, place long, ref string, lon double, lat double, missing boolean, claimed boolean")
    got = changes.arms(a, b)
    assert {(r.object_id, r.ordinal, r.place, r.arm) for r in got.collect()} == {
        (1, 10, 20, "keep"), (1, 11, None, "insert"), (1, 12, 22, "return"), (1, 13, 23, "keep"), (2, 14, None, "insert"), (None, 15, None, "insert"),
        (1, None, 21, "withdraw"), (2, None, 24, "withdraw"), (None, None, 26, "withdraw"),
    }
    assert {(r.ordinal, r.place) for r in changes.paired_places(a, b).collect()} == {(10, 20), (12, 22), (13, 23)}
    rows = got.filter("arm IN ('withdraw', 'insert')").selectExpr("object_id", "coalesce(ordinal, place) AS id", "ref", "arm = 'insert' AS arrived")
    assert {tuple(r) for r in changes.deferred(rows).collect()} == {(1, 21, 11), (2, 24, 14)}


def test_components_take_more_tasks_for_more_edges(spark, monkeypatch):
    """However many edges there are, a task has TASK_ROWS of them, or about so."""
    tasks, cut = [], graph.cut
    monkeypatch.setattr(steps, "TASK_ROWS", 10)
    monkeypatch.setattr(graph, "cut", lambda df: tasks.append(df.rdd.getNumPartitions()) or cut(df))
    edges = [(k, k + 1) for k in range(200) if k % 7] + [(900, 900), (3, 3), (4, 3)]
    got = {r.id: r.component for r in graph.components(None, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {900: 900} | {k: k - (k - 1) % 7 for k in range(1, 201)}
    assert max(tasks) >= 17
