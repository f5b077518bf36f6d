"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Take the shorter one's length m:
an edit leaves its first m // 2 code points intact or else the rest of them, so near words share a prefix or a suffix of
known length. Every word stands in the forward dictionary under its prefix and in the reversed one under its suffix, each
once as the shorter (or equal) and once as the longer word of a pair.

A block (what shares a prefix or suffix) above BLOCK words is subdivided by the same rule: one edit of what lies between
leaves its first or its second half intact. That is repeated until blocks are small, or what lies between is one code point
and all shorter words of the block are near each other. The dictionaries are range-partitioned by their blocks, sorted, and scanned
block by block; pairs are verified and only each word's count and best near word leave the task. A pair is in a block of the
second halves only if its words first differ before them, so each pair is counted once.

Word counts are Spark's partial sums, so a frequent word is no hot key.

Defined cases: a null text has no words; a null id counts as the empty text where ids are hashed; repeated rows count each;
of near words as frequent the first in code-point order is the form; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import ascii_lower, cut, pieces, small, text_of

#: The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: A block of more words is subdivided.
BLOCK = 64
KEY = ["m", "a", "b", "head", "tail"]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, deleting: int | None = None) -> DataFrame:
    """word, n of the runs of letters in whole texts, A-Z lower-cased.

    deleting: where it divides the crc32 of `<id>:<run>`, one code point of that run is left out, as a typist would.
    """
    # Shorter runs stay too short, as no rule makes a run longer.
    runs = F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("word"))
    if deleting is not None:
        digest = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (digest % F.length("word")).cast("int")
        cut_out = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(digest % deleting == 0, cut_out).otherwise(F.col("word")).alias("word"))
        rows = rows.filter(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what the words of a block share: the first a and the last b code points, these reversed."""
    return rows.withColumn("head", F.substring("word", F.lit(1), F.col("a"))).withColumn("tail", F.substring(F.reverse("word"), F.lit(1), F.col("b")))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under the first and under the second half of what lies between; bound: pairs of a block differ before it."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("bound").alias("bound"))
    second = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b"), (F.col("a") + half).alias("bound"))
    return _keyed(rows.withColumn("_half", F.explode(F.array(first, second))).select("word", "n", "m", "_half.*").filter("bound > a"))


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """word, n, m, a, b, bound, head, tail: every word's rows in both dictionaries, large blocks subdivided."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m >= 0")
    rows = rows.withColumns({"a": F.lit(0), "b": F.lit(0), "bound": F.col("m") + 1})
    rows = cut(_halved(rows))
    out = None
    while True:
        # What lies between shrinks by half each time; with one code point left, all shorter words are near each other.
        large = cut(rows.filter("m - a - b > 1").groupBy(*KEY).count().filter(F.col("count") > limit).select(*KEY))
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        large = small(large)
        stay = rows.join(large, KEY, "left_anti").select(rows.columns)
        out = stay if out is None else out.unionByName(stay)
        rows = cut(_halved(rows.join(large, KEY, "left_semi")))


def one_edit(u: str, v: str, bound: int) -> bool:
    """Whether v, as long as u or longer by one, is u after one edit, and they first differ before bound."""
    i, end = 0, min(len(u), bound)
    while i < end and u[i] == v[i]:
        i += 1
    if i >= bound:
        return False
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def near_words(rows: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: of all its near words the number, and the most frequent one. rows: blocks()."""

    def scanned(block: list[tuple[str, int]], m: int, bound: int, out: list[tuple]) -> None:
        found: dict[str, list] = {}

        def link(u: str, v: str, n: int) -> None:
            best = found.setdefault(u, [0, v, n])
            best[0] += 1
            if n > best[2] or n == best[2] and v < best[1]:
                best[1:] = v, n

        shorter, longer = [x for x in block if len(x[0]) == m], [x for x in block if len(x[0]) > m]
        for i, (u, n) in enumerate(shorter):
            for others in (shorter[:i], longer):
                for v, k in others:
                    if one_edit(u, v, bound):
                        link(u, v, k)
                        link(v, u, n)
        out += [(word, *best) for word, best in found.items()]

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out = None, [], []
        for batch in pieces(batches):
            for word, n, m, a, b, bound in zip(*(batch[c].to_pylist() for c in ("word", "n", "m", "a", "b", "bound")), strict=True):
                now = (m, a, b, word[:a], word[len(word) - b :], bound)
                if now != key:
                    if len(block) > 1:
                        scanned(block, key[0], key[-1], out)
                    key, block = now, []
                block.append((word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if len(block) > 1:
            scanned(block, key[0], key[-1], out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ordered = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word").select("word", "n", "m", "a", "b", "bound")
    links = ordered.mapInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near"))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", (-F.col("best.down")).alias("near_n"))


def spelling_variants(words: DataFrame, ratio: int = 5, limit: int = BLOCK) -> DataFrame:
    """Per word of words (word, n): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that is at least ratio times as frequent; its root is where its forms end.
    """
    words = cut(words.select("word", "n"))
    found = words.join(near_words(blocks(words, limit)), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))

    # Every form is more frequent than its word, so forms end; each round doubles the steps taken.
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = cut(roots)
        ahead = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        jumped = roots.join(small(ahead), F.col("root") == F.col("_at"), "left")
        if jumped.filter("_next IS NOT NULL").isEmpty():
            break
        roots = jumped.select("word", F.coalesce("_next", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
