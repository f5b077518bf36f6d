"""Awkward texts, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import wikitext as w

PAGE = """intro {{marker|name=[[Here|There]]|lat=1.5}}
<!-- {{Regionlist|region9name=[[Hidden]]}} -->
== Regions ==
{{Regionlist|regionmap=My map.svg
|region1name=[[Alpha|The alpha]]
|region1items=[[One]], [[Two|2]], [[File:x.png]]
|region1description=far, {{convert|10|km|{{a|b}}}} from [[nowhere]] }
|region2name=[[Georgia (state)]] ([[USA]])
|region3name=[[France]]'s [[Brittany]]
|region4name=[[North]] and [[South|the south]]
|region4items=[[Other]]
|region5name={{flag|x}} '''Plain''' [http://a.example/b Name]
|region6name={{gone}}
|region7name=Just a name
|region7items=
|region12name=[[Last]] ([[One]], [[Two]]
}}
* [[Beyond]] — near [[not this]]
* [[Hidden]] is described separately
** [[Below hidden]]
*** [[Deeper]]
* [[Next|x]] - more [[no]]
* see what is described in [[Elsewhere]]
** [[Below again]]
text ends that
** [[Seen again]]
# '''[[Numbered]]''' text
* [[File:y.png]] [[late]]
* [[Beyond]]
plain [[neither]]"""


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").withColumn("all", w.templates(F.col("t"))).select(*columns).collect()[0]


def test_templates_and_regions(spark):
    found = F.col("all")
    row = one(spark, PAGE, F.transform(found, lambda t: t["name"]).alias("names"), w.regions(F.get(w.named(found, "regionlist"), F.lit(0))).alias("regions"))
    assert row.names == ["marker", "regionlist", "convert", "a", "flag", "gone"]
    assert [tuple(r) for r in row.regions] == [
        (1, "Alpha", True, ["One", "Two"]), (2, "Georgia (state)", True, []), (3, "Brittany", True, []), (4, "North and South", False, ["North", "South"]),
        (5, "Plain Name", False, []), (7, "Just a name", False, []), (12, "Last", True, []),
    ]


def test_bullets_behind_the_list(spark):
    found = F.col("all")
    start = F.get(w.named(found, "regionlist"), F.lit(0))["after"]
    plain = w.without_comments(F.col("t"))
    row = one(spark, PAGE, w.bullets(F.substring(plain, start + 1, F.length(plain))).alias("links"))
    assert row.links == ["Beyond", "Next", "Seen again", "Numbered"]


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", []), ("{{a", []), ("}} {{a}}", ["a"]), ("{{a|[[b}} c", ["a"]), ("{{a|{{b}}|c={{d|e=1}}}}", ["a", "b", "d"]), ("[[x|{{y}}]]", ["y"])])
def test_broken_templates(spark, text, want):
    names = one(spark, text, F.transform("all", lambda t: t["name"]).alias("n")).n
    assert names == (want or [])


def test_parameters(spark):
    text = "{{Geo| 1.5 |2|zoom = 4|note=a=b|name=[[x|y]]|url={{u|k=v}}|empty=}}"
    g = F.get("all", F.lit(0))
    row = one(spark, text, w.positional(g).alias("p"), *[w.parameter(g, k).alias(k) for k in ("zoom", "note", "name", "url", "empty", "missing")], w.parameter(g, "empty", "zoom").alias("either"))
    assert tuple(row) == (["1.5", "2"], "4", "a=b", "[[x|y]]", "{{u|k=v}}", None, None, "4")


def test_shapes(spark):
    text = (
        "{{mapframe|{{mapshape|type=geoshape|fill={{StdColor|T1}}|title=[[Coast|the coast]] and [[Hills]]|wikidata=Q1, Q2,}}}}"
        "{{Mapshape|fill=#ffcc00 |name=B|wikidata=Q3}}{{mapshape|title=No entity}}{{mapshape|wikicommons=Data:x.map|fill={{StdColor|zz}}}}{{mapshape|wikidata=Q9}}"
    )
    rows = one(spark, text, w.shapes(F.col("all")).alias("s")).s
    assert [tuple(r) for r in rows] == [("Coast and Hills", "#cfd48c", ["Q1", "Q2"], None), ("B", "#ffcc00", ["Q3"], None), ("", "#cccccc", [], "Data:x.map")]


def test_groups_of_links(spark):
    got = [one(spark, t, w.grouped_links(F.col("t")).alias("g")).g for t in ("[[A]]'s [[B|b]]", "[[A]] ([[B]])", "[[A|a]] and [[B]]")]
    assert [(g.linked, g["name"], g.children) for g in got] == [(True, "B", []), (True, "A", []), (False, "A and B", ["A", "B"])]


def test_image_candidates(spark):
    text = "[[File:Some map.svg|thumb]] [[Image:photo.JPG]] [[file:District_photo.jpg]] [[File:Flag of x.png]] [[File:Some map.svg]] [[Category:x.png]] [[File:no ending]]"
    assert one(spark, text, w.image_candidates(F.col("t")).alias("f")).f == ["Some_map.svg", "District_photo.jpg"]


def test_components(spark):
    text = "{Name: A: b, REF: 1-001, latitude: 1.5, longitude: -2.5}, {name: B, ref: 2, latitude: 91, longitude: 0}\n{ref: 3, latitude: 1, longitude: 1} {name: C, the big, latitude:.5 N, longitude: 7°, ref: 4} {name: D, ref: 5, latitude: x, longitude: 1} {open: 1"
    assert [tuple(c) for c in one(spark, text, w.components(F.col("t")).alias("c")).c] == [("A: b", "1-001", 1.5, -2.5), ("C", "4", 0.5, 7.0)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("48.8566, 2.3522", (48.8566, 2.3522)), ("48.8566 2.3522", (48.8566, 2.3522)), ("-33.8688;151.2093", (-33.8688, 151.2093)), ("lng: 2.3522, lat: 48.8566", (48.8566, 2.3522)),
        ("Latitude = 1; Longitude = -2.5", (1.0, -2.5)), ("48°51'24\"N, 2°21'8\"E", (48 + 51 / 60 + 24 / 3600, 2 + 21 / 60 + 8 / 3600)), ("2°21′8.5″ W 48°51′24″ s", (-(48 + 51 / 60 + 24 / 3600), -(2 + 21 / 60 + 8.5 / 3600))),
        ("48.8566N, 2.3522E", (48.8566, 2.3522)), ("-5° S 7 W", (-5.0, -7.0)), ("https://maps.example/place/@48.5,-7.25,12z/data", (48.5, -7.25)), ("91, 0", None), ("0 181", None), ("", None), (None, None), ("one two", None),
        ("1 2 3", None), ("5N 6S", None), ("48.5N", None), ("lat: 95, lon: 3", None), ("7", None),
    ],
)
def test_coordinates(spark, text, want):
    got = one(spark, text, w.coordinates(F.col("t")).alias("c")).c
    assert (got is None) == (want is None)
    if want:
        assert (got.lat, got.lon) == pytest.approx(want)


def longest_common(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def test_shortest_edits_keep_the_most_words():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        same = w.shortest_edits(a, b)
        assert len(same) == longest_common(a, b) and all(a[i] == b[j] for i, j in same)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(same, same[1:], strict=False))


def test_differences_keep_every_character(spark):
    rows = [("a b c", "a x c"), ("", "new text"), (None, None), ("  two  spaces\n", "two spaces"), ("w " * 401, "w"), ("the heart of ancient x", "the heart of x")]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", w.word_diff(F.col("x"), F.col("y")).alias("d")).collect()
    for r in got:
        assert "".join(p.text for p in r.d.before) == (r.x or "") and "".join(p.text for p in r.d.after) == (r.y or "")
        assert r.d.capped == (r.x is not None and len(r.x) > 800)
    assert [p.text for p in got[0].d.before if p.changed] == ["b "] and [p.text for p in got[0].d.after if p.changed] == ["x "]
    assert [p.text for p in got[5].d.before if p.changed] == ["ancient "] and not any(p.changed for p in got[5].d.after)


def test_kinds_and_tags(spark):
    row = one(spark, "(i)(IV) x(vi (q)(x)", w.criteria_tags(F.col("t")).alias("c"))
    assert row.c == ["criterion_i", "criterion_iv", "criterion_x"]


def test_values_that_are_used_often_are_computed_once(spark):
    """Tokens, kinds, entries and centres are bound: the expressions stay short, as every use of a value repeats its expression."""
    rows = spark.createDataFrame([("48°51'30\"N, 2°21'0\"E",)], "t string")
    plan = rows.select(w.coordinates(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    listed = rows.select(w.medoid(w.components(F.col("t"))).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert listed.count("split(t") == 1
