"""Names: normalising, variants, trigrams and scores as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose canonical decomposition is a plain letter and marks, from the Unicode tables.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]

#: Administrative nouns that end a name.
SUFFIXES = (
    "province", "state", "prefecture", "oblast", "county", "district", "department", "region", "territory", "governorate", "municipality",
    "division", "parish", "canton", "voivodeship", "krai", "republic", "autonomous", "community", "emirate", "principality",
)
#: What a search hit's score is made of.
EXACT, BEGINS, FUZZY, IN_PATH, IN_NAME, ALL_TERMS = 1000, 500, 400, 300, 200, 100


#: Parts of words by which a work's type is a sculpture's.
SCULPTURAL = ("sculpt", "statue", "bust", "relief", "cast", "figurine", "torso", "stele", "monument")


def is_sculptural(kind: Column) -> Column:
    lower = F.lower(kind)
    return F.exists(F.array(*[F.lit(x) for x in SCULPTURAL]), lambda part: F.contains(lower, part))


def plain(text: Column) -> Column:
    """Without accents; case stays."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_PLAIN)), "[\\u0300-\\u036f]", "")


def normalised(text: Column) -> Column:
    return F.trim(F.lower(plain(text)))


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""))


def without_suffix(text: Column) -> Column:
    """A last word that is an administrative noun goes, if another word is before it."""
    return F.regexp_replace(text, rf"(?i)(?<=\S)\s+(?:{'|'.join(SUFFIXES)})$", "")


def trigrams(text: Column) -> Column:
    """The set of a text's trigrams; each word has two spaces before it and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_words(text: Column) -> Column:
    """The words of which trigrams() takes trigrams, each once and in order, with a space between them."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def similarity(a: Column, b: Column) -> Column:
    """Of two sets of trigrams: common by all; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def without_note(text: Column) -> Column:
    """What is before the first parenthesis."""
    return F.trim(F.substring_index(text, "(", 1))


def variants(name: Column) -> Column:
    """The normalised name, and without its suffix if it has one."""
    n = normalised(name)
    return F.array_distinct(F.filter(F.array(n, F.trim(without_suffix(n))), lambda x: x != ""))


#: The shorter of two names of which one begins the other has so many characters, and so much of the longer one.
LEAST_PREFIX, LEAST_SHARE = 4, 0.6


def is_prefix_match(a: Column, b: Column) -> Column:
    """One begins the other; the shorter has 4 characters and 0.6 of the longer. With as many hyphens in both, part by part."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    left, right = F.split(short, "-"), F.split(long, "-")
    pairs = F.zip_with(left, right, lambda x, y: F.startswith(x, y) | F.startswith(y, x))
    whole = F.when((F.size(left) > 1) & (F.size(left) == F.size(right)), F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))).otherwise(F.startswith(long, short))
    return (F.length(short) >= LEAST_PREFIX) & (F.length(short) / F.length(long) >= LEAST_SHARE) & whole


def prefixes(text: Column, least: Column) -> Column:
    """The beginnings of a text that have at least so many characters, the whole text included."""
    return F.when(F.length(text) >= least, F.transform(F.sequence(least, F.length(text)), lambda k: F.substring(text, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def prefix_keys(name: Column, asking: bool) -> Column:
    """Keys on which two names meet, one asking and one not, wherever is_prefix_match may hold; few others share one.

    A name's beginnings that are long enough meet a name that is just that. Of names with the same number of parts between
    hyphens, the longest part of the asking one and the part in its place of the other one are such a pair, of any length.
    """
    long = prefixes(name, F.greatest(F.lit(LEAST_PREFIX), F.ceil(F.length(name) * LEAST_SHARE).cast("int")))
    keyed = lambda tag, values: F.transform(values, lambda x: F.concat(tag, x))
    roles = ("s|", "l|") if asking else ("l|", "s|")
    # A role names which of the two is the shorter: s the asking one, l the other.
    whole = F.concat(keyed(F.lit(roles[0]), F.array(name)), keyed(F.lit(roles[1]), long))
    parts = F.split(name, "-")
    at = F.sequence(F.lit(0), F.size(parts) - 1)
    if asking:
        longest = F.array_max(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
        at = F.array(-longest["i"])
    by_part = F.flatten(F.transform(at, lambda i: F.concat(
        keyed(F.concat_ws("|", F.lit(roles[0]), F.size(parts), i, F.lit("")), F.array(F.get(parts, i))),
        keyed(F.concat_ws("|", F.lit(roles[1]), F.size(parts), i, F.lit("")), prefixes(F.get(parts, i), F.lit(0))),
    )))
    return F.concat(whole, F.when(F.size(parts) > 1, by_part).otherwise(F.array().cast("array<string>")))

def child_score(wanted: Column, name: Column, names: Column) -> Column:
    """700 for the exact name, 650 for a variant or the beginning of it, else null. wanted: variants of what is looked for; name: normalised; names: its variants."""
    return (
        F.when(F.array_contains(wanted, name), 700)
        .when(F.arrays_overlap(wanted, names) | F.exists(wanted, lambda w: is_prefix_match(w, name)), 650)
    )


def relevance(name: Column, path: Column, depth: Column, query: str, fuzzy: bool = True) -> Column:
    """Score of a search hit: how the name matches, whether the path holds the query, how shallow and how short it is. The parts add up."""
    term, n, p = normalised(F.lit(query)), normalised(name), normalised(path)
    points = lambda c, k: F.when(c, k).otherwise(0)
    close = similarity(trigrams(n), trigrams(term)) * FUZZY if fuzzy else F.lit(0.0)
    return (
        points(n == term, EXACT) + points(F.startswith(n, term), BEGINS) + close + points(F.contains(p, term), IN_PATH) + points(F.contains(n, term), IN_NAME)
        + points(F.forall(F.split(term, r"\s+"), lambda t: F.contains(p, t)), ALL_TERMS)
        + points(depth <= 10, (F.lit(10) - depth) * 10) + points(F.length(name) < 20, (F.lit(20) - F.length(name)) * 2)
    )
