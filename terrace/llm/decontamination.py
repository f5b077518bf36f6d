"""Benchmark decontamination by template canonicalisation.

A text becomes a template: capitalised words within a sentence are names, digits are numbers and what follows them may
be a unit; each is replaced by a typed placeholder, the rest is lower-cased, and punctuation separates words. Windows of
eight template words of all documents are hash-joined to those of the benchmark. A document that shares a window is
looked at again with the values in its slots: its windows are laid along an item's (the same distance between their
places in both), and along one such line each value of the item must always stand for the same value of the document.
So a question with other numbers or names is found, but not a text that only has a like pattern. Windows that have the
item's own values count whatever the line's other windows hold, and of those others the ones count that agree with the
commonest value for each of the item's, so one edit does not hide a copy. A document is contaminated by an item if such
lines cover at least LEAST of the item's windows, or all where it has fewer.

Windows with fewer than LITERAL ordinary words say too little for a template and are not used. Every item is also looked
for word for word: its windows of eight lower-cased words, numbers and names as they are, without any test of what they
say. So a copy is found whatever its case, line breaks or place in a sentence, on which names depend. An item of fewer
than eight words has one window, the whole item.

Main path: DataFrame functions only. Windows of documents are neither shuffled nor sent anywhere: they are probed where
they stand against a broadcast set of the benchmark's 64-bit window hashes, of all widths in one scan. Of an item's windows
those are probed that the fewest items have, and no more than any match needs. A document found so is laid along the items
whose probed windows it has, and no others, so a window that many items have brings nothing together by itself. The set is
cut in blocks of a fixed size; each block is a pass of its own over the documents.

Defined cases: a null or empty text or item has no windows; rows with one id count as one document, those without an id as
one too, with a null id; copies of an item are all named; items of one id and different texts are looked for each by itself; the private-use characters U+E001 to U+E003 separate words; an
empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, small, text_of

WIDTH, LITERAL, LEAST = 8, 4, 6
#: Hashes of the benchmark that are broadcast at a time.
BLOCK = 2_000_000

#: Placeholders, and what they stand for.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
NAMES = r"\p{Lu}(?<=[\p{L}\p{N}][,;]? \p{Lu})\p{Ll}++(?!\p{L})"
UNITS = (
    "mm|cm|dm|km|m|kg|mg|g|lbs?|oz|ml|cl|dl|l|ms|s|min|h|hrs?|hz|khz|mhz|ghz|w|kw|kwh|mw|v|kv|j|kj|pa|kpa|mph|kmh|km/h|m/s"
    "|inch(?:es)?|feet|foot|ft|yards?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|centimet(?:er|re)s?|grams?|kilograms?|pounds?|ounces?|tons?|tonnes?"
    "|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent|dollars?|euros?|cents?|usd|eur|gbp"
)
NUMBERS = rf"(?<![\p{{L}}\p{{N}}])(\p{{Nd}}++(?:[.,:/]\p{{Nd}}++)*+)(?: ?((?i:{UNITS})(?![\p{{L}}\p{{N}}])|[%€$£¥°]))?"
BETWEEN = r"[^\p{L}\p{M}\p{N}\uE001-\uE003]++"
#: A word, or a placeholder with its value.
VALUED = r"[\uE001-\uE003][^\uE001-\uE003 ]*+|[\p{L}\p{M}\p{N}]++"


def unmarked(text: Column) -> Column:
    """The text without placeholders of its own."""
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in (NUMBER, NAME, UNIT)])
    return F.when(marked, F.translate(text, NUMBER + NAME + UNIT, "   ")).otherwise(text)


def template(text: Column) -> Column:
    """The template's words."""
    named = F.regexp_replace(unmarked(text), NAMES, f" {NAME} ")
    numbered = F.regexp_replace(named, NUMBERS, f" {NUMBER} {UNIT} ")
    # The text gets a separator at both ends; the empty words before and after are cut off.
    words = F.split(F.concat(F.lit(" "), F.lower(numbered), F.lit(" ")), BETWEEN)
    return F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2))


def valued(text: Column) -> Column:
    """The same words, with the values after their placeholders."""
    named = F.regexp_replace(unmarked(text), NAMES, f" {NAME}$0 ")
    return F.regexp_extract_all(F.lower(F.regexp_replace(named, NUMBERS, f" {NUMBER}$1 {UNIT}$2 ")), F.lit(VALUED), F.lit(0))


def plain(text: Column) -> Column:
    """The lower-cased words as they stand."""
    words = F.split(F.concat(F.lit(" "), F.lower(unmarked(text)), F.lit(" ")), BETWEEN)
    return F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2))


def bare(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(first.isin(NUMBER, NAME, UNIT), first).otherwise(word)


def hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def windows(rows: DataFrame, words: str, width: int) -> DataFrame:
    """Adds _place (from 0) and _hash for each window of so many words in a row.

    Only places are generated; the words are read from the array where it stands.
    """
    places = rows.select("*", F.posexplode_outer(words).alias("_place", "_first")).filter(F.col("_place") <= F.size(words) - width)
    return places.withColumn("_hash", hashed([F.col("_first"), *(F.get(words, F.col("_place") + k) for k in range(1, width))])).drop("_first")


def laid_out(items: DataFrame, usable: Callable[[Column], Column]) -> DataFrame:
    """All usable windows of rows of _item and _words: _item, _copy (a hash of the words), _of (how many windows), _at, _width, _values (an array of words)."""
    items = items.filter("size(_words) > 0").withColumn("_width", F.least(F.size("_words"), F.lit(WIDTH)))
    cut_out = F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("_width") + 1), lambda k: F.struct(k.alias("_at"), F.slice("_words", k, F.col("_width")).alias("_values")))
    cut_out = items.select("_item", F.xxhash64("_words").alias("_copy"), "_width", F.filter(cut_out, lambda w: usable(w["_values"])).alias("_cut"))
    return cut_out.select("_item", "_copy", F.size("_cut").alias("_of"), "_width", F.inline("_cut"))


def with_hash(cutout: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """Adds _bare, of() each of the _values, its _hash, and _rank: the window's place among its item's, those first that few items have."""
    by_width = F.lit(None).cast("long")
    for width in range(1, WIDTH + 1):
        by_width = F.when(F.col("_width") == width, hashed([of(F.get("_values", F.lit(k))) for k in range(width)])).otherwise(by_width)
    rows = cutout.withColumn("_bare", F.transform("_values", of)).withColumn("_hash", by_width)
    often = rows.groupBy("_hash").agg(F.count("*").alias("_often"))
    return rows.join(often, "_hash").withColumn("_rank", F.row_number().over(Window.partitionBy("_item", "_copy").orderBy("_often", "_hash", "_at"))).drop("_often")


def item_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """_item, _copy, _of, _width, _at, _values (an array of valued words), _bare, _hash, _rank: all windows that say enough."""
    rows = benchmark.select(F.col(item_col).alias("_item"), valued(text_of(text_col)).alias("_words")).distinct()
    literal = lambda values: F.size(F.filter(values, lambda w: ~F.substring(w, 1, 1).isin(NUMBER, NAME, UNIT)))
    return with_hash(laid_out(rows, lambda values: literal(values) >= LITERAL), bare)


def plain_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """The same of plain words: all windows."""
    rows = benchmark.select(F.col(item_col).alias("_item"), plain(text_of(text_col)).alias("_words")).distinct()
    return with_hash(laid_out(rows, lambda values: F.lit(True)), lambda w: w)


def sharing(rows: DataFrame, hashes: DataFrame, widths: list[int], words: Callable[[Column], Column]) -> DataFrame:
    """The rows (_id, _text) that have a window among the hashes, each once. One scan looks at the windows of all widths."""
    places = rows.withColumn("_words", words(F.col("_text"))).select("*", F.posexplode_outer("_words").alias("_place", "_first"))
    ahead = [F.col("_first"), *(F.get("_words", F.col("_place") + k) for k in range(1, max(widths)))]
    of_width = [F.when(F.col("_place") <= F.size("_words") - w, hashed(ahead[:w])) for w in widths]
    if len(widths) == 1:
        found = places.withColumn("_hash", of_width[0]).filter("_hash IS NOT NULL")
    else:
        found = places.select("_id", "_text", F.explode(F.array_compact(F.array(*of_width))).alias("_hash"))
    return found.join(F.broadcast(hashes), "_hash", "left_semi").groupBy("_id", "_text").agg(F.count("*").alias("_n")).drop("_n")


def telling_windows(items: DataFrame, least: int) -> DataFrame:
    """Of each item's windows those that any match needs one of: _item, _copy, _width, _hash.

    A row with `least` of an item's windows (all, where it has fewer) has one of any `_of - least + 1` of them; those are
    taken that the fewest items have, so that phrases common to many questions make no suspects.
    """
    return cut(items.filter(F.col("_rank") <= F.greatest(F.lit(1), F.col("_of") - least + 1)).select("_item", "_copy", "_width", "_hash").distinct())


def suspects(rows: DataFrame, telling: DataFrame, words: Callable[[Column], Column], block: int) -> tuple[DataFrame | None, list[int]]:
    """The rows that may hold an item, and the widths of the items' windows; None if there is no window."""
    hashes = cut(telling.select("_width", "_hash").distinct())
    counts = {r["_width"]: r["n"] for r in hashes.groupBy("_width").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, []
    blocks = -(-sum(counts.values()) // block)
    passes = [sharing(rows, hashes.filter(F.pmod("_hash", F.lit(blocks)) == k).select("_hash"), sorted(counts), words) for k in range(blocks)]
    found = reduce(DataFrame.unionByName, passes)
    return cut(found.distinct() if blocks > 1 else found), sorted(counts)


def laid(words: DataFrame, items: DataFrame, telling: DataFrame, widths: list[int]) -> DataFrame:
    """Windows of rows (_id, _text, _words, _bare) at the windows of those items of which they have a telling one: _id, _text, _place, _own, and the items' columns."""
    numbered = cut(words.withColumn("_row", F.monotonically_increasing_id()))
    lines = []
    for width in widths:
        of_width = lambda df, w=width: df.filter(F.col("_width") == w)
        own = windows(numbered, "_bare", width).select("_row", "_place", "_hash")
        own = cut(own.join(small(of_width(items).select("_hash").distinct()), "_hash", "left_semi"))
        pairs = own.join(small(of_width(telling)), "_hash").select("_row", F.col("_item").alias("_i"), F.col("_copy").alias("_c")).distinct()
        wanted = pairs.join(small(of_width(items)), F.col("_i").eqNullSafe(F.col("_item")) & (F.col("_c") == F.col("_copy"))).drop("_i", "_c")
        met = own.join(wanted, ["_row", "_hash"]).withColumnRenamed("_bare", "_item_bare").join(numbered, "_row")
        lines.append(met.select("*", *[F.slice(x, F.col("_place") + 1, F.lit(width)).alias(y) for x, y in (("_words", "_own"), ("_bare", "_own_bare"))]).drop("_row", "_words", "_bare"))
    # Hashes agree; the words themselves must too. An equation would become a key of the join, and its table a large one.
    return reduce(DataFrame.unionByName, lines).filter(F.col("_own_bare").between(F.col("_item_bare"), F.col("_item_bare")))


def nothing(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select("_id", F.lit(None).alias("_item"), F.lit(0).alias("_windows"), F.lit(0).alias("_of"))


def counted(hits: DataFrame) -> DataFrame:
    """_id, _item, _windows (how many of the item's windows were found), _of (how many it has); rows: _id, _item, _copy, _of, _at."""
    return hits.groupBy("_id", "_item", "_copy", "_of").agg(F.countDistinct("_at").alias("_windows")).select("_id", "_item", "_windows", "_of")


def most_of(slots: Column) -> Column:
    """The pairs (of, is) that are the most frequent of their value of the item; of equally frequent ones the greatest."""
    counted = F.transform(F.array_distinct(slots), lambda p: F.struct(p["of"].alias("of"), F.size(F.filter(slots, lambda q: q == p)).alias("n"), p["is"].alias("is")))
    # Sorted, the last one of each value is its best.
    best = F.transform(F.array(F.array_sort(counted)), lambda c: F.filter(c, lambda p, i: ~p["of"].eqNullSafe(F.get(c, i + 1)["of"])))[0]
    return F.transform(best, lambda p: F.struct(p["of"].alias("of"), p["is"].alias("is")))


def matches(rows: DataFrame, items: DataFrame, block: int, least: int) -> DataFrame:
    """_id, _item, _windows (of the item, found along consistent lines or as they are), _of (the item's windows)."""
    telling = telling_windows(items, least)
    found, widths = suspects(rows, telling, template, block)
    if found is None:
        return nothing(rows)
    words = found.select("_id", F.xxhash64("_text").alias("_text"), valued(F.col("_text")).alias("_words")).withColumn("_bare", F.transform("_words", bare))
    pairs = F.filter(F.arrays_zip(F.col("_values").alias("of"), F.col("_own").alias("is")), lambda p: F.substring(p["of"], 1, 1).isin(NUMBER, NAME, UNIT))
    item = "_item", "_copy", "_of"
    line = laid(words, items, telling, widths).select("_id", "_text", *item, (F.col("_place") - F.col("_at")).alias("_shift"), "_at", (F.col("_own") == F.col("_values")).alias("_same"), pairs.alias("_pairs"))
    # Along a line each slot value of the item has one value of the document. A line is at most as long as its item.
    consistent = lambda slots: F.size(F.array_distinct(F.transform(slots, lambda p: p["of"]))) == F.size(slots)
    keys = "_id", "_text", *item, "_shift"
    line = cut(line)
    # Windows with the item's own values count by themselves; of the others those that have the line's commonest values.
    same = line.filter("_same").select("_id", *item, "_at")
    changed = line.filter("NOT _same").groupBy(*keys).agg(F.collect_list(F.struct("_at", "_pairs")).alias("_changed"))
    changed = changed.withColumn("_slots", F.flatten(F.transform("_changed", lambda c: c["_pairs"])))
    changed = changed.withColumn("_most", F.when(consistent(F.array_distinct("_slots")), F.array_distinct("_slots")).otherwise(most_of(F.col("_slots"))))
    agreeing = changed.select("_id", *item, "_most", F.explode("_changed").alias("_c")).filter(F.size(F.array_except("_c._pairs", "_most")) == 0)
    kept = same.unionByName(agreeing.select("_id", *item, F.col("_c._at").alias("_at")))
    return counted(kept)


def verbatim_matches(rows: DataFrame, items: DataFrame, block: int, least: int) -> DataFrame:
    """The same of windows of plain words."""
    telling = telling_windows(items, least)
    found, widths = suspects(rows, telling, plain, block)
    if found is None:
        return nothing(rows)
    words = found.select("_id", F.lit(0).alias("_text"), plain(F.col("_text")).alias("_bare")).withColumn("_words", F.col("_bare"))
    return counted(laid(words, items, telling, widths))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per contaminated document: id, item_ids (sorted), n_windows (of all these items)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    items = cut(item_windows(benchmark, item_col, item_text_col))
    enough = F.col("_windows") >= F.least(F.lit(least), F.col("_of"))
    exact = cut(plain_windows(benchmark, item_col, item_text_col))
    found = matches(rows, items, block, least).filter(enough).unionByName(cut(verbatim_matches(rows, exact, block, least).filter(enough)))
    found = found.groupBy("_id", "_item").agg(F.max("_windows").alias("_windows"))
    return found.groupBy("_id").agg(F.sort_array(F.collect_set("_item")).alias("item_ids"), F.sum("_windows").alias("n_windows")).withColumnRenamed("_id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that no item contaminates."""
    bad = cut(contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias("_bad")))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_key"))
    return rows.join(small(bad), F.col("_key").eqNullSafe(F.col("_bad")), "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
