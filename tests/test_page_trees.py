"""Trees over pages against a recursive build."""

import random

from terrace.operators import page_trees as pt

PAGES = "title string, regions array<struct<name:string,linked:boolean,items:array<string>>>"


def build(title, pages, redirects, most, depth=0, seen=frozenset()):
    """A node as (name, children), or what it is instead."""
    if title in seen:
        return "self"
    if depth >= most:
        return (title, [])
    resolved = redirects.get(title, title)
    if resolved not in pages:
        return "missing"
    if resolved in seen:
        return "self"
    regions = pages[resolved]
    if not regions or (len(regions) == 1 and not regions[0][2]):
        return (title, [])
    above, children = seen | {title, resolved}, []
    for name, linked, items in regions:
        made = [build(t, pages, redirects, most, depth + 1, above) for t in ([name] if linked else items)]
        made = [(t, []) if m == "self" else m for t, m in zip([name] if linked else items, made, strict=True) if m != "missing"]
        children += made if linked or len(made) < 2 else [(name, made)]
    return (title, [] if len(children) == 1 and not children[0][1] else children)


def paths(node, above=()):
    yield (*above, node[0])
    for child in node[1]:
        yield from paths(child, (*above, node[0]))


def test_against_a_recursive_build(spark):
    rng = random.Random(1)
    for seed in range(2):
        names = [f"p{k}" for k in range(14)]
        region = lambda: (rng.choice([*names, "nowhere", "r0", "r1"]), rng.random() < 0.75, [rng.choice([*names, "nowhere", "r1"]) for _ in range(rng.randrange(4))])
        pages = {n: [region() for _ in range(rng.choice([0, 2, 2, 3, 3]))] for n in names}
        redirects = {"r0": "p1", "r1": f"p{2 + seed}", "r2": "nowhere"}
        most, roots = 4, ["p0", "p5", "r0", "r2", "nowhere"]
        got = pt.page_trees(spark.createDataFrame([(r,) for r in roots], "title string"), spark.createDataFrame(list(pages.items()), PAGES), spark.createDataFrame(list(redirects.items()), "title string, target string"), most).collect()
        names_of = {(r.root, tuple(r.path)): (r["name"], r.parent) for r in got}

        def line(root, path):
            name, parent = names_of[root, path]
            return ((*line(root, tuple(parent)), name)) if parent is not None else (name,)

        have = sorted((root, line(root, path)) for root, path in names_of)
        built = {r: build(r, pages, redirects, most) for r in roots}
        want = sorted((r, p) for r, node in built.items() if isinstance(node, tuple) for p in paths(node))
        assert have == want and len(want) > 10
    empty = pt.page_trees(spark.createDataFrame([], "title string"), spark.createDataFrame(list(pages.items()), PAGES), spark.createDataFrame([("a", "b")], "title string, target string"), 3)
    assert empty.collect() == []


def test_registered_query(spark):
    from terrace.plans import trees
    from terrace.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    pages = {r.title: [tuple(x) for x in r.regions] for r in trees.linked_pages(spark, folder).collect()}
    redirects = {r.title: r.target for r in trees.page_redirects(spark, folder).collect()}
    got = QUERIES["t14_built_trees"](spark, folder).collect()
    want = {r: build(r, pages, redirects, trees.PAGE_DEPTH) for r in ("P1", "P2", "P3")}
    lines = sorted((r, p[-1], len(p) - 1) for r, node in want.items() for p in paths(node))
    names = {(r.root, r.path): r for r in got}
    depth = lambda r: 0 if r.parent is None else 1 + depth(names[r.root, r.parent])
    assert sorted((r.root, r["name"], depth(r)) for r in got) == lines and len(lines) > 60
