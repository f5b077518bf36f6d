"""Texts of sources: templates, links, lists of components, coordinates and differences of words.

Page texts are read once by a scanner of templates and their parameters; what is wanted of them are expressions over its
result. Coordinates are read as tokens, whose kinds make a short text of their own, on which the known forms are looked for.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a difference of two texts looks at; image candidates of a page.
MOST_WORDS, MOST_IMAGES = 400, 15
#: What follows "described" on a line that only refers to another page.
ELSEWHERE = ("separately", "elsewhere", "on that page", "in [[", "as [[")
#: Colours of a map's shapes by their code, and that of an unknown code.
COLOURS = {"t1": "#cfd48c", "t2": "#b5d29b", "t3": "#d4a76a", "t4": "#c7b8d1", "t5": "#8cc2c4", "t6": "#d4a4a7", "t7": "#b8c7d1", "t8": "#d1c7a4", "t9": "#a4b8d1", "t10": "#c4c78c"}
OTHER_COLOUR = "#cccccc"
#: Words of a file's name that tell a map, and those that tell that it is none.
MAP_WORDS = ("map", "karte", "carte", "mappa", "mapa", "region", "regions", "district", "districts", "province", "provinces", "prefecture", "prefectures", "county", "counties", "canton", "cantons", "oblast", "oblasts", "department", "departments", "administrative", "division", "divisions")
NO_MAP_WORDS = ("flag", "coat", "seal", "emblem", "logo", "icon", "banner", "wikivoyage")

PARAMETERS = "array<struct<key:string,value:string>>"
TEMPLATES = f"array<struct<name:string,parameters:{PARAMETERS},start:int,after:int>>"


def scanned(text: str | None) -> list[dict]:
    """Every template of a text with balanced braces, those within others too, in order of their starts.

    A bar parts parameters only outside of links and of inner templates. after: where the text goes on.
    """
    found: list[dict] = []
    # What is open: [mark, start, places of its bars]. A link that is not closed ends with its template.
    open_marks: list[tuple[str, int, list[int]]] = []
    for token in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", text or ""):
        mark, at = token[0], token.start()
        if mark in ("{{", "[["):
            open_marks.append((mark, at, []))
        elif mark == "|":
            if open_marks and open_marks[-1][0] == "{{":
                open_marks[-1][2].append(at)
        elif mark == "]]":
            if open_marks and open_marks[-1][0] == "[[":
                open_marks.pop()
        else:
            while open_marks and open_marks[-1][0] == "[[":
                open_marks.pop()
            if not open_marks:
                continue
            _, start, bars = open_marks.pop()
            ends = [*bars, at]
            pieces = [text[a + 1 : b] for a, b in zip(bars, ends[1:], strict=True)]
            pairs = [x.split("=", 1) if re.match(r"[\w \t\n.-]*=", x) else (None, x) for x in pieces]
            parameters = [{"key": k and k.strip().lower(), "value": v.strip()} for k, v in pairs]
            found.append({"name": text[start + 2 : ends[0]].strip().lower(), "parameters": parameters, "start": start, "after": at + 2})
    return sorted(found, key=lambda t: t["start"])


def templates(text: Column) -> Column:
    """Array of structs name, parameters (key or null, value), start and after (0-based) of the templates of a text; comments don't count."""
    return F.pandas_udf(lambda values: values.map(scanned), TEMPLATES)(without_comments(text))


def without_comments(text: Column) -> Column:
    """Without what stands between <!-- and -->; a comment that isn't closed stays."""
    parts = F.split(text, "<!--")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.when(F.contains(x, F.lit("-->")), F.substring(x, F.instr(x, "-->") + 3, F.length(x))).otherwise(F.concat(F.lit("<!--"), x)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def named(found: Column, name: str) -> Column:
    """The templates of a name."""
    return F.filter(found, lambda t: t["name"] == name.lower())


def parameter(template: Column, *keys: str) -> Column:
    """The value of the first of the keys that a template has with a value."""
    value = lambda key: F.get(F.filter(template["parameters"], lambda p: (p["key"] == key) & (p["value"] != "")), F.lit(0))["value"]
    return F.coalesce(*[value(key) for key in keys])


def positional(template: Column) -> Column:
    """The values without a key, in order."""
    return F.transform(F.filter(template["parameters"], lambda p: p["key"].isNull()), lambda p: p["value"])


def _bracketed(text: Column) -> Column:
    """What stands within [[ and the next ]], in order, with what follows up to the next [[."""
    parts = F.split(text, r"\[\[")
    return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.split(x, r"\]\]", 2)), lambda x: F.size(x) == 2)


def links(text: Column) -> Column:
    """Targets of [[links]] in order, without those of namespaces."""
    targets = F.transform(_bracketed(text), lambda x: F.trim(F.substring_index(F.get(x, F.lit(0)), "|", 1)))
    return F.filter(targets, lambda t: (t != "") & ~F.contains(t, F.lit(":")))


def as_text(text: Column) -> Column:
    """Links as their targets."""
    parts = F.split(text, r"\[\[")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.when(F.contains(x, F.lit("]]")), F.concat(F.substring_index(F.substring_index(x, "]]", 1), "|", 1), F.substring(x, F.instr(x, "]]") + 2, F.length(x)))).otherwise(x))
    return F.trim(F.concat(F.get(parts, F.lit(0)), F.array_join(rest, "")))


def without_asides(text: Column) -> Column:
    """Without parentheses that hold nothing but links; one at the end may be open."""
    return F.regexp_replace(text, r"\s*\((?:[,\s]*+\[\[[^\[\]]*+\]\])++[,\s]*+(?:\)|$)", "")


def bare(text: Column) -> Column:
    """A plain name: no templates, no addresses but their words, no bold or link marks."""
    out = F.regexp_replace(text, r"\{\{[^}\n]*(?:\}\}|$)", "")
    out = F.regexp_replace(out, r"\[https?://\S++\s+([^\]]+)\]", "$1")
    return F.trim(F.regexp_replace(out, r"'{2,3}|\[\[|\]\]|https?://\S+", ""))


def regions(template: Column) -> Column:
    """Array of structs n, name, linked, items out of a template's numbered parameters region<n>name and region<n>items.

    One link makes a linked region with its items. Of a link's own ("[[A]]'s [[B]]") the second counts. Several links are a
    group, which is not linked: its items are the links. What has none is a plain name; an empty one is left out. A link in
    parentheses behind the name is an aside.
    """
    line = lambda value: F.trim(F.substring_index(value, "\n", 1))
    number = lambda key: F.regexp_extract(key, r"^region(\d{1,4})name$", 1)

    def one(p: Column) -> Column:
        n, value = number(p["key"]), line(p["value"])
        items = F.get(F.filter(template["parameters"], lambda q: q["key"] == F.concat(F.lit("region"), n, F.lit("items"))), F.lit(0))["value"]
        core = without_asides(value)
        found = links(core)
        owned = (F.size(found) == 2) & core.rlike(r"\]\]'s\s*\[\[")
        linked = (F.size(found) == 1) | owned
        group = F.size(found) > 1
        name = F.when(linked, F.get(found, F.size(found) - 1)).when(group, as_text(core)).otherwise(bare(value))
        listed_items = F.coalesce(links(line(items)), F.array().cast("array<string>"))
        return F.struct(n.cast("int").alias("n"), name.alias("name"), linked.alias("linked"), F.when(group & ~linked, found).otherwise(listed_items).alias("items"))

    return F.filter(F.transform(F.filter(template["parameters"], lambda p: number(p["key"]) != ""), one), lambda r: r["name"] != "")


def grouped_links(text: Column) -> Column:
    """Struct linked, name, children of a name with several links: "[[A]]'s [[B]]" is B, "[[A]] ([[B]])" is A, else all are children of a group."""
    targets = links(text)
    owned, aside = text.rlike(r"\]\]'s\s+\[\["), text.rlike(r"\]\]\s*\(")
    name = F.when(owned, F.get(targets, F.size(targets) - 1)).when(aside, F.get(targets, F.lit(0))).otherwise(as_text(text))
    return F.struct((owned | aside).alias("linked"), name.alias("name"), F.when(owned | aside, F.array().cast("array<string>")).otherwise(targets).alias("children"))


def bullets(text: Column) -> Column:
    """The first link of each line of a list, from what stands before a dash.

    A line that says that something is described elsewhere doesn't count, nor do the lines below it that are indented
    deeper; a line that is no list's ends that.
    """
    elsewhere = "|".join(re.escape(x).replace("\\ ", r"\s+") for x in ELSEWHERE)
    refers = rf"(?i)described\s+(?:{elsewhere})"
    none = F.lit(None).cast("int")

    def step(state: Column, raw: Column) -> Column:
        line = F.trim(raw)
        depth = F.length(F.regexp_extract(line, r"^[*#]+", 0))
        hidden = (depth > 0) & F.coalesce(depth > state["under"], F.lit(False))
        refer = (depth > 0) & ~hidden & line.rlike(refers)
        head = F.get(F.split(line, r"\s*[—–]\s*|\s+-\s+", 2), F.lit(0))
        first = F.trim(F.substring_index(F.get(F.get(_bracketed(head), F.lit(0)), F.lit(0)), "|", 1))
        counts = (depth > 0) & ~hidden & ~refer & first.isNotNull() & (first != "") & ~F.contains(first, F.lit(":"))
        under = F.when(hidden, state["under"]).when(refer, depth).otherwise(none)
        return F.struct(under.alias("under"), F.when(F.coalesce(counts, F.lit(False)), F.array_append(state["links"], first)).otherwise(state["links"]).alias("links"))

    start = F.struct(none.alias("under"), F.array().cast("array<string>").alias("links"))
    return F.array_distinct(F.aggregate(F.split(text, "\n"), start, step)["links"])


def shapes(found: Column) -> Column:
    """Array of structs title, colour, entities, file of a page's map shapes: those with a title and entities, else those with a file."""
    code = lambda t: F.lower(F.trim(F.regexp_extract(t, r"(?i)^\{\{\s*stdcolor\s*\|([^}|]*)", 1)))
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])

    def one(t: Column) -> Column:
        fill = F.coalesce(parameter(t, "fill"), F.lit(""))
        colour = F.when(fill.startswith("{{"), F.coalesce(F.try_element_at(table, code(fill)), F.lit(OTHER_COLOUR))).otherwise(F.regexp_extract(fill, r"^[#\w]*", 0))
        title = as_text(F.coalesce(parameter(t, "title", "name"), F.lit("")))
        entities, file = listed(F.coalesce(parameter(t, "wikidata"), F.lit(""))), parameter(t, "wikicommons")
        whole = (title != "") & (F.size(entities) > 0)
        return F.struct(title.alias("title"), colour.alias("colour"), F.when(whole, entities).otherwise(F.array().cast("array<string>")).alias("entities"), F.when(~whole, file).alias("file"))

    return F.filter(F.transform(named(found, "mapshape"), one), lambda s: (F.size(s["entities"]) > 0) | s["file"].isNotNull())


def image_candidates(text: Column) -> Column:
    """Files of a page that may be maps, at most MOST_IMAGES: photographs only by a word in their name, none with a word for what is no map."""
    word = lambda words: rf"\b(?:{'|'.join(words)})\b"
    plain = lambda f: F.replace(F.lower(f), F.lit("_"), F.lit(" "))
    targets = F.transform(_bracketed(text), lambda x: F.substring_index(F.get(x, F.lit(0)), "|", 1))
    files = F.filter(F.transform(targets, lambda t: F.regexp_extract(t, r"(?i)^(?:file|image):(.{1,300}\.\w{1,10})", 1)), lambda f: f != "")
    photo = lambda f: F.lower(f).rlike(r"\.jpe?g$")
    kept = F.filter(files, lambda f: ~plain(f).rlike(word(NO_MAP_WORDS)) & (~photo(f) | plain(f).rlike(word(MAP_WORDS))))
    return F.slice(F.array_distinct(F.transform(kept, lambda f: F.replace(F.trim(f), F.lit(" "), F.lit("_")))), 1, MOST_IMAGES)


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(text: Column) -> Column:
    """Array of structs name, ref, lat, lon of `{name: …, ref: …, latitude: …, longitude: …}`, whole ones within range only."""
    objects = F.filter(F.transform(F.split(text, r"\{"), lambda x: F.when(F.contains(x, F.lit("}")), F.substring_index(x, "}", 1))), lambda x: x.isNotNull())

    def read(o: Column) -> Column:
        return bound(entries_of(o), fields)

    def entries_of(o: Column) -> Column:
        return F.transform(F.split(o, ","), lambda e: F.struct(F.lower(F.trim(F.substring_index(e, ":", 1))).alias("key"), F.trim(F.substring(e, F.instr(e, ":") + 1, F.length(e))).alias("value"), F.contains(e, F.lit(":")).alias("whole")))

    def fields(entries: Column) -> Column:
        field = lambda key: F.get(F.filter(entries, lambda e: e["whole"] & (e["key"] == key)), F.lit(0))["value"]
        named = lambda key: bound(field(key), lambda v: F.when(v != "", v))
        degrees = lambda key: F.regexp_extract(field(key), r"^-?\d*\.?\d+", 0).try_cast("double")
        return F.struct(named("name").alias("name"), named("ref").alias("ref"), degrees("latitude").alias("lat"), degrees("longitude").alias("lon"))

    whole = lambda c: c["name"].isNotNull() & c["ref"].isNotNull() & in_range(c["lat"], c["lon"])
    return F.filter(F.transform(objects, read), whole)


def in_range(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def medoid(places: Column) -> Column:
    """Of structs lat, lon the one nearest to their mean latitude and mean direction of longitude, the first of equals; null of none."""
    return bound(places, _medoid)


def _medoid(places: Column) -> Column:
    n = F.size(places)
    total = lambda of: F.aggregate(places, F.lit(0.0), lambda t, p: t + of(p))
    lat = total(lambda p: p["lat"]) / n
    lon = F.degrees(F.atan2(total(lambda p: F.sin(F.radians(p["lon"]))), total(lambda p: F.cos(F.radians(p["lon"])))))
    turn = lambda p, c: F.pmod(F.abs(p["lon"] - c["lon"]), F.lit(360.0))
    short = lambda p, c: F.when(turn(p, c) > 180, 360 - turn(p, c)).otherwise(turn(p, c))
    far = lambda c: F.transform(places, lambda p, k: F.struct((F.pow(p["lat"] - c["lat"], F.lit(2)) + F.pow(short(p, c) * F.cos(F.radians(c["lat"])), F.lit(2))).alias("d"), k.alias("k")))
    return F.when(n > 0, F.get(places, bound(F.struct(lat.alias("lat"), lon.alias("lon")), lambda c: F.array_min(far(c)))["k"]))


def criteria_tags(text: Column) -> Column:
    """criterion_i and so on out of `(i)(iv)`."""
    parts = F.split(text, r"\(")
    inside = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.when(F.contains(x, F.lit(")")), F.lower(F.substring_index(x, ")", 1))))
    return F.transform(F.filter(inside, lambda x: x.rlike("^[ivx]+$")), lambda c: F.concat(F.lit("criterion_"), c))


def listed(text: Column) -> Column:
    """Entries of a list with commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_yes(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)^(true|1|y|yes)$"), F.lit(False))


def kind(text: Column) -> Column:
    """The kind of a site by the word in it, else the text in lower case; null for an empty one."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("cultural")), "cultural").when(F.contains(t, F.lit("natural")), "natural").when(F.contains(t, F.lit("mixed")), "mixed").otherwise(F.nullif(t, F.lit("")))


def coordinates(text: Column) -> Column:
    """Struct lat, lon of the first form that gives a place in range: a map's address, labels, degrees with minutes and seconds, degrees with a direction, two plain numbers.

    The text is cut into tokens, each of one kind: 0 a number, d m s marks of degrees, minutes and seconds, N S E W
    directions, A and O labels, and signs. The forms are patterns of kinds; a kind's place is its token's.
    """
    tokens_of = lambda t: F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d*)?|[A-Za-z]+|[^\sA-Za-z\d]"), F.lit(0))
    return bound(F.trim(text), lambda t: bound(tokens_of(t), lambda tokens: bound(_shape(tokens), lambda shape: _first_form(t, tokens, shape))))


def _shape(tokens: Column) -> Column:
    """A letter for each token's kind."""
    marks = {"°": "d", "′": "m", "'": "m", "″": "s", '"': "s", "@": "@", ":": "=", "=": "=", ",": ",", ";": ","}
    kinds = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    labels = {"lat": "A", "latitude": "A", "lng": "O", "lon": "O", "longitude": "O"}
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])

    def kind_of(token: Column) -> Column:
        word = token.rlike("^[A-Za-z]")
        first = F.upper(F.substring(token, 1, 1))
        return F.when(token.rlike(r"^-?\d"), "0").when(word, F.coalesce(F.try_element_at(names, F.lower(token)), F.when(first.isin("N", "S", "E", "W"), first), F.lit("x"))).otherwise(F.coalesce(F.try_element_at(kinds, token), F.lit("x")))

    return F.array_join(F.transform(tokens, kind_of), "")


def _first_form(t: Column, tokens: Column, shape: Column) -> Column:
    number = lambda i: F.get(tokens, i).try_cast("double")
    place = lambda pattern: F.regexp_instr(shape, F.lit(pattern)) - 1

    both = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))

    def pair(pattern: str, lat: int, lon: int, least: int = 1) -> Column:
        """The numbers that stand so many tokens behind a pattern's place."""
        return bound(place(pattern), lambda at: numbers(at, lat, lon, least))

    def numbers(at: Column, lat: int, lon: int, least: int) -> Column:
        there = (at >= 0) & (F.length(F.regexp_replace(F.get(tokens, at + lat), "[^0-9]", "")) >= least) & (F.length(F.regexp_replace(F.get(tokens, at + lon), "[^0-9]", "")) >= least)
        return F.when(there, both(number(at + lat), number(at + lon)))

    def directed(pattern: str, value) -> Column:
        """The two values of a pattern that ends in a direction; there must be just two."""
        ends = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.substring(shape, F.lit(1), i).rlike(pattern + "$"))
        return bound(ends, lambda found: F.when(F.size(found) == 2, of_ends(found, value)))

    def of_ends(ends: Column, value) -> Column:
        parts = F.transform(ends, lambda i: F.struct(F.substring(shape, i, F.lit(1)).alias("d"), F.abs(value(i)).alias("v")))
        signed = F.transform(parts, lambda p: F.struct(p["d"].alias("d"), F.when(p["d"].isin("S", "W"), -p["v"]).otherwise(p["v"]).alias("v")))
        of = lambda rows, a, b: F.get(F.filter(rows, lambda p: p["d"].isin(a, b)), F.lit(0))["v"]
        return bound(signed, lambda rows: both(of(rows, "N", "S"), of(rows, "E", "W")))

    words = F.filter(F.split(t, r"[,;\s]+"), lambda x: x != "")
    forms = [
        pair("@0,0", 1, 3, least=2), pair("A=0,O=0", 2, 6), pair("O=0,A=0", 6, 2),
        directed("0d0m0s[NSEW]", lambda i: F.abs(number(i - 7)) + number(i - 5) / 60 + number(i - 3) / 3600),
        directed("0d?[NSEW]", lambda i: F.when(F.substring(shape, i - 1, F.lit(1)) == "d", number(i - 3)).otherwise(number(i - 2))),
        bound(words, lambda w: F.when(F.size(w) == 2, both(F.get(w, F.lit(0)).try_cast("double"), F.get(w, F.lit(1)).try_cast("double")))),
    ]
    return F.coalesce(*[bound(form, lambda p: F.when(in_range(p["lat"], p["lon"]), p)) for form in forms])


def shortest_edits(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places that stay the same along a shortest way of deletions and insertions from a to b.

    A search by number of edits: on each diagonal (place in a less place in b) the furthest place reached so far is kept, and
    the way back follows what each step came from.
    """
    reached, steps = {1: 0}, []
    for edits in range(len(a) + len(b) + 1):
        steps.append(dict(reached))
        for diagonal in range(-edits, edits + 1, 2):
            insert = diagonal == -edits or (diagonal != edits and reached[diagonal - 1] < reached[diagonal + 1])
            x = reached[diagonal + 1] if insert else reached[diagonal - 1] + 1
            while x < len(a) and x - diagonal < len(b) and a[x] == b[x - diagonal]:
                x += 1
            reached[diagonal] = x
            if x >= len(a) and x - diagonal >= len(b):
                return _way_back(steps, len(a), len(b))
    return []


def _way_back(steps: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    same = []
    for edits in range(len(steps) - 1, -1, -1):
        reached, diagonal = steps[edits], x - y
        insert = diagonal == -edits or (diagonal != edits and reached[diagonal - 1] < reached[diagonal + 1])
        before = diagonal + 1 if insert else diagonal - 1
        from_x = reached[before] if edits else 0
        from_y = from_x - before if edits else 0
        while x > from_x and y > from_y:
            x, y = x - 1, y - 1
            same.append((x, y))
        x, y = from_x, from_y
    return same[::-1]


def word_diff(before: Column, after: Column) -> Column:
    """Struct before, after, capped: both texts as parts (text, changed) by a shortest edit of their words; whole where one has too many."""
    part = "array<struct<text:string,changed:boolean>>"

    def parts(words: list[str], same: set[int]) -> list[dict]:
        out: list[dict] = []
        for i, word in enumerate(words):
            if out and out[-1]["changed"] == (i not in same):
                out[-1]["text"] += word
            else:
                out.append({"text": word, "changed": i not in same})
        return out

    def one(x: str, y: str) -> tuple:
        # A word goes with the white space behind it, so that the parts together are the text.
        a, b = (re.findall(r"\s+|\S+\s*", t) for t in (x, y))
        if max(len(a), len(b)) > MOST_WORDS:
            return [{"text": x, "changed": False}], [{"text": y, "changed": False}], True
        same = shortest_edits(a, b)
        return parts(a, {i for i, _ in same}), parts(b, {j for _, j in same}), False

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p or "", q or "") for p, q in zip(x, y, strict=True)], columns=["before", "after", "capped"])

    return F.pandas_udf(run, f"before {part}, after {part}, capped boolean")(before, after)


def credit(text: Column) -> Column:
    """Credit lines without markup and with single spaces; licence codes in their usual spelling."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]{0,500}>", ""), r"\s+", " "))
    licence = F.regexp_extract(bare, r"(?i)cc[- ]by(?:[- ](sa|nc|nd))?[- ](\d\.\d)", 2)
    variant = F.upper(F.regexp_extract(bare, r"(?i)cc[- ]by(?:[- ](sa|nc|nd))?[- ](\d\.\d)", 1))
    spelled = F.concat(F.lit("CC BY"), F.when(variant != "", F.concat(F.lit("-"), variant)).otherwise(""), F.lit(" "), licence)
    return F.when(licence != "", spelled).otherwise(bare)
