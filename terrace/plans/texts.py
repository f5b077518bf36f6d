"""Texts made of keys, in the forms that sources write, and what is read out of them. What is read is known by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import wikitext as w
from terrace.operators.ranking import first_per
from terrace.operators.steps import cut, small, spread
from terrace.plans.base import query
from terrace.sources.tables import LINE_ID, table


@query(
    """WITH r AS (SELECT r_regionkey::BIGINT AS page, n.n_nationkey::INT AS n, n_name AS name, n_nationkey % 3 <> 0 AS linked, n_nationkey % 2 = 0 AS items FROM region JOIN nation n ON n_regionkey = r_regionkey)
    SELECT page, n, name, linked, CASE WHEN items THEN 'one ' || n || ';two ' || n ELSE '' END AS items, 'Beyond ' || page || ';Last' AS extra FROM r"""
)
def t11_region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of regions in a template with others in it: names, links, items, and the links of the list after it."""
    n = F.col("n_nationkey").cast("string")
    entry = F.concat(
        F.lit("\n|region"), n, F.lit("name="), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("[["), "n_name", F.lit("|shown]]"))).otherwise(F.col("n_name")), F.lit("\n|region"), n, F.lit("items="),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("[[one "), n, F.lit("]], [[two "), n, F.lit("|2]], [[File:x.png]]"))).otherwise(F.lit(" ")), F.lit("\n|region"), n, F.lit("description=far, {{convert|10|km|{{a|b}}}} from [[nowhere]]"),
    )
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("body"))
    tail = F.concat(F.lit("\n}}\n* [[Beyond "), F.col("page").cast("string"), F.lit("]] — near [[not this]]\n* [[Hidden]] is described separately\n# '''[[Last|x]]''' - more [[no]]\nplain [[neither]]"))
    text = F.concat(F.lit("== Regions ==\n{{regionlist|regionmap=x.svg"), "body", tail)
    found = cut(pages.select("page", text.alias("text"), w.templates(text).alias("all")))
    lists = found.select("page", "text", F.explode(w.named(F.col("all"), "Regionlist")).alias("t"))
    rest = F.substring("text", F.col("t.after") + 1, F.length("text"))
    rows = lists.select("page", F.inline(w.regions(F.col("t"))), F.array_join(w.bullets(rest), ";").alias("extra"))
    return rows.select("page", "n", "name", "linked", F.array_join("items", ";").alias("items"), "extra")


@query(
    """SELECT p_partkey AS id, 'Mark ' || p_partkey AS name, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 80)::DOUBLE + 0.5 END AS lat, CASE WHEN p_partkey % 5 <> 0 THEN 'Q' || p_partkey END AS entity,
    CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 90)::DOUBLE ELSE (p_partkey % 45)::DOUBLE END AS geo_lat FROM part"""
)
def t11_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers and the place of a page, given by names or by position."""
    k = F.col("p_partkey")
    s = k.cast("string")
    text = F.concat(
        F.lit("x {{marker|name=[[Some|Mark "), s, F.lit("]]"), F.when(k % 3 != 0, F.concat(F.lit("|lat="), (k % 80).cast("string"), F.lit(".5|long=7.25"))).otherwise(""), F.when(k % 5 != 0, F.concat(F.lit("|wikidata=Q"), s)).otherwise(""),
        F.lit("}} y {{marker|lat=1|long=2}} {{geo|"), F.when(k % 2 == 0, F.concat((k % 90).cast("string"), F.lit("|10.5|zoom=4"))).otherwise(F.concat(F.lit("lat="), (k % 45).cast("string"), F.lit("|long=10.5"))), F.lit("}}"),
    )
    rows = table(spark, sf_dir, "part").select(k.alias("id"), w.templates(text).alias("all"))
    marks = rows.select("id", F.explode(w.named(F.col("all"), "marker")).alias("m"), F.get(w.named(F.col("all"), "geo"), F.lit(0)).alias("g"))
    place = F.coalesce(w.parameter(F.col("g"), "lat"), F.get(w.positional(F.col("g")), F.lit(0))).try_cast("double")
    shown = F.regexp_replace(w.parameter(F.col("m"), "name"), r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    named = marks.select("id", shown.alias("name"), w.parameter(F.col("m"), "lat").try_cast("double").alias("lat"), w.parameter(F.col("m"), "wikidata").alias("entity"), place.alias("geo_lat"))
    return named.filter("name IS NOT NULL")


PIECES = f"""pieces AS (SELECT l_partkey AS id, {LINE_ID} AS k, 'P' || l_linenumber AS name, l_orderkey || '-' || l_linenumber AS ref, (l_orderkey * 91 % 1999) / 10 - 100.0::DOUBLE AS lat,
    CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 179.5 ELSE -179.5 END + l_orderkey % 100 / 1000 ELSE l_orderkey * 37 % 3600 / 10 - 180.0::DOUBLE END AS lon FROM lineitem WHERE l_orderkey % 5 <> 1)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that list components; one in five lacks its reference, some are out of range."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS id", f"{LINE_ID} AS k", "l_orderkey", "'P' || l_linenumber AS name", "l_orderkey || '-' || l_linenumber AS ref", "(l_orderkey * 91 % 1999) / 10 - 100.0D AS lat",
        "CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 179.5D ELSE -179.5D END + l_orderkey % 100 / 1000 ELSE l_orderkey * 37 % 3600 / 10 - 180.0D END AS lon",
    )
    ref = F.when(F.col("l_orderkey") % 5 != 1, F.concat(F.lit(", ref: "), "ref")).otherwise("")
    text = F.concat(F.lit("{name: "), "name", ref, F.lit(", latitude: "), F.col("lat").cast("string"), F.lit(", longitude: "), F.col("lon").cast("string"), F.lit("}"))
    texts = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda s: s["t"]), ", ").alias("text"))
    return texts.select("id", w.components(F.col("text")).alias("parts"))


@query(f"WITH {PIECES} SELECT id, count(*) AS parts, string_agg(name || '/' || ref, ',' ORDER BY k) AS names FROM pieces WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY id")
def x20_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components out of a text; incomplete and impossible ones are left out."""
    shown = lambda parts: F.struct(F.size(parts).cast("long").alias("parts"), F.array_join(F.transform(parts, lambda p: F.concat(p["name"], F.lit("/"), p["ref"])), ",").alias("names"))
    # One generator reads a text once; a filter of its own would read it again.
    return _pieces(spark, sf_dir).select("id", F.inline(F.filter(F.transform(F.array("parts"), shown), lambda s: s["parts"] > 0)))


@query(
    f"""WITH {PIECES}, p AS (SELECT * FROM pieces WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), c AS (SELECT id, avg(lat) AS clat, degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) AS clon FROM p GROUP BY id),
    d AS (SELECT p.*, clat, CASE WHEN abs(lon - clon) % 360 > 180 THEN 360 - abs(lon - clon) % 360 ELSE abs(lon - clon) % 360 END AS turn FROM p JOIN c USING (id))
    SELECT id, arg_min(ref, (round(pow(lat - clat, 2) + pow(turn * cos(radians(clat)), 2), 9), k)) AS ref FROM d GROUP BY id"""
)
def x21_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component nearest to the middle of all, over the antimeridian too."""
    return _pieces(spark, sf_dir).select("id", F.inline(F.transform(F.filter(F.array("parts"), lambda p: F.size(p) > 0), lambda p: F.struct(w.medoid(p)["ref"].alias("ref")))))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'cultural' WHEN 1 THEN 'natural' WHEN 2 THEN 'mixed' WHEN 3 THEN 'other kind' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'criterion_i,criterion_iv' WHEN p_partkey % 3 = 1 THEN 'criterion_x' ELSE '' END
    || CASE WHEN p_partkey % 4 = 0 THEN ',in_danger' ELSE '' END AS tags, 'FR|ES' AS codes FROM part"""
)
def x22_kinds_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("A Cultural site"), F.lit("NATURAL"), F.lit("Mixed"), F.lit("Other Kind"), F.lit("")), (k % 5 + 1).cast("int"))
    criteria = F.when(k % 3 == 0, "(i)(IV)").when(k % 3 == 1, "(x)(zz)").otherwise("none")
    danger = F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, "False").when(k % 4 == 2, "0")
    tags = F.concat(F.array_join(w.criteria_tags(criteria), ","), F.when(w.is_yes(danger), ",in_danger").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("id"), w.kind(kind).alias("kind"), tags.alias("tags"), F.array_join(w.listed(F.lit("FR, ES ,,")), "|").alias("codes"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 < 6 THEN CASE WHEN p_partkey % 7 = 3 THEN -(p_partkey % 80 + 0.5) ELSE p_partkey % 80 + 0.5 END END::DOUBLE AS lat, CASE WHEN p_partkey % 7 < 6 THEN -(p_partkey % 170 + 0.25) END::DOUBLE AS lon FROM part"""
)
def x28_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place written in each form, and one that is none."""
    k = F.col("p_partkey")
    a, b = (k % 80).cast("string"), (k % 170).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        text("https://maps.example/@", a, ".5,-", b, ".25,12z"), text("Latitude: ", a, ".5; lng = -", b, ".25"), text("lon=-", b, ".25, lat=", a, ".5"), text(a, "°30'0\"S ", b, "°15′00″W"),
        text(a, ".5N, ", b, ".25° W"), text(" ", a, ".5  -", b, ".25 "), text("95.", a, " 10"),
    ]
    out = forms[6]
    for n, form in enumerate(forms[:6]):
        out = F.when(k % 7 == n, form).otherwise(out)
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"))
    return rows.select(k.alias("id"), F.inline(F.array(w.coordinates(out)))).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '0 a b c ' ELSE '0 a 1[' || p_partkey || ' ]0 c ' END AS before,
    CASE WHEN p_partkey % 3 = 0 THEN '0 a b c ' ELSE '0 a 1[new words ]0 c ' END AS after FROM part"""
)
def x27_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts as parts that agree (0) and differ (1[…])."""
    k = F.col("p_partkey")
    first = F.when(k % 3 == 0, "a b c ").otherwise(F.concat(F.lit("a "), k.cast("string"), F.lit(" c ")))
    second = F.when(k % 3 == 0, "a b c ").otherwise("a new words c ")
    shown = lambda side: F.array_join(F.transform(f"d.{side}", lambda p: F.when(p["changed"], F.concat(F.lit("1["), p["text"], F.lit("]"))).otherwise(F.concat(F.lit("0 "), p["text"]))), "")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), w.word_diff(first, second).alias("d"))
    return rows.select("id", shown("before").alias("before"), shown("after").alias("after"))


PRICES = "(VALUES ('click', 1.5, 6.0), ('view-large', 2.5, 10.0), ('sign', 0.5, 2.0))"


@query(
    f"""WITH c AS (SELECT event_id, event_type AS model, event_id % 1000 * 37 AS prompt, event_id % 77 * 11 AS answer, event_id % 10 = 0 AS searched FROM events), p AS (SELECT * FROM {PRICES} v(k, i, o)),
    m AS (SELECT c.*, coalesce(any_value(i), 1.0) AS i, coalesce(any_value(o), 4.0) AS o FROM c LEFT JOIN p ON starts_with(model, k) OR starts_with(k, model) GROUP BY ALL)
    SELECT model, sum(round((prompt * i::DOUBLE + answer * o::DOUBLE) * 1000 + CASE WHEN searched THEN 3e7::DOUBLE ELSE 0 END)::BIGINT)::BIGINT / 1e9::DOUBLE AS cost, count(*) AS calls FROM m GROUP BY model"""
)
def x25_usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by a price table, by name or beginning of a name, with rates for models that it doesn't know and a charge per search."""
    prices = small(spark.createDataFrame([("click", 1.5, 6.0), ("view-large", 2.5, 10.0), ("sign", 0.5, 2.0)], "k string, i double, o double"))
    calls = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS model", "event_id % 1000 * 37 AS prompt", "event_id % 77 * 11 AS answer", "event_id % 10 = 0 AS searched")
    models = calls.select("model").distinct()
    # Exact names first; of several beginnings the first in the table's order.
    found = models.join(prices, F.startswith("model", "k") | F.startswith("k", "model"), "left").groupBy("model").agg(F.min_by(F.struct("i", "o"), F.struct(F.col("k") != F.col("model"), "k")).alias("p"))
    rows = calls.join(small(found), "model")
    # Rates are for a million tokens; sums are of whole billionths, so that their order doesn't matter.
    billionths = (F.col("prompt") * F.coalesce("p.i", F.lit(1.0)) + F.col("answer") * F.coalesce("p.o", F.lit(4.0))) * 1000 + F.when(F.col("searched"), 3e7).otherwise(0.0)
    return rows.groupBy("model").agg((F.sum(F.round(billionths).cast("long")) / 1e9).alias("cost"), F.count("*").alias("calls"))


@query("SELECT event_type AS decision, count(*) AS n, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (rn <= 3) AS first_three FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS rn FROM events) GROUP BY event_type")
def x26_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each decision was taken, with three of those concerned."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    some = first_per(events, ["event_type"], [F.asc("user_id"), F.asc("event_id")], 3).groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda u: u.cast("string")), ",").alias("first_three"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).join(some, "event_type").select(F.col("event_type").alias("decision"), "n", "first_three")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CC BY-SA 4.0' WHEN p_partkey % 3 = 1 THEN 'CC BY 3.0' ELSE 'Photo of Anna ' || p_partkey END AS credit, 'https://example.org/entity/Q' || p_partkey AS address FROM part")
def t15_t16_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences spelled alike, names without markup, and addresses of entities."""
    k = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, "<a href='x'>cc-by-sa-4.0</a>").when(F.col("p_partkey") % 3 == 1, " CC BY 3.0 ").otherwise(F.concat(F.lit("<b>Photo</b>  of\n Anna "), k))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.credit(raw).alias("credit"), F.concat(F.lit("https://example.org/entity/Q"), k).alias("address"))
