"""Fuzzy scans for short licence notices.

Texts are taken as their words (A-Z lower-cased, joined by one space). A notice is a line of words; those in brackets are
its key words, which must stand as they are, as "2" does in a version. The rest may hold up to a bounded number of edits
(inserted, deleted or replaced characters). Split into one piece more than that, a notice with so many edits still holds
one piece as it is (the pigeonhole principle): an Aho-Corasick automaton finds the pieces of all notices, and around each
of them the regex library's bounded-error matching looks for the notice and tells its place and edits.

Base phrases are those without brackets and edits: their words stand consecutively.

It is one pass, with no shuffle; a text is the unit of work.

Defined cases: a null or empty text has no words, no label and a score of 0; notices may overlap, matches of one notice
don't: of those that share a character the one with the fewest edits stays, then the first; repeated rows are treated each
alike; an empty table gives an empty result; the input's other columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import pieces

#: Phrases that are found word by word, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices, and their labels.
NOTICES = (
    ("under the [mit] license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("[apache] license version [2]", "apache-2"),
    ("[apache] software license [2]", "apache-2"),
    ("creative commons attribution [noncommercial]", "cc-by-nc"),
    ("creative commons attribution non [commercial]", "cc-by-nc"),
    ("creative commons attribution [sharealike]", "cc-by-sa"),
    ("creative commons attribution share [alike]", "cc-by-sa"),
    ("[cc0] 1 0 universal", "cc0"),
    ("dedicated to the [public] [domain]", "public-domain"),
    ("released into the [public] [domain]", "public-domain"),
    ("[gnu] general public license version [2]", "gpl-2"),
    ("[gnu] general public license version [3]", "gpl-3"),
    ("[gnu] lesser general public license", "lgpl"),
    ("[gnu] affero general public license", "agpl"),
    ("[mozilla] public license version [2]", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("under the [bsd] license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("[boost] software license version", "bsl-1"),
    ("[all] rights reserved", "reserved"),
)
#: One edit for so many characters beside the key words, and at most so many.
CHARS_PER_EDIT, MOST_EDITS = 8, 4

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_scanners: dict = {}


def words_of(text: str | None) -> list[bytes]:
    # bytes: lower() knows A-Z only, and all bytes of other characters belong to words.
    return (text or "").encode().lower().translate(_TO_SPACE).split()


@dataclass(frozen=True)
class Notice:
    """name: its words; edits: how many it may hold; parts: what may hold them, and key words, in turn; pattern: all of it."""

    name: str
    label: str
    edits: int
    parts: tuple[tuple[bool, str], ...]
    pattern: regex.Pattern

    @classmethod
    def of(cls, text: str, label: str, chars_per_edit: int = CHARS_PER_EDIT) -> Notice:
        words = [(w.startswith("["), w.strip("[]")) for w in text.split()]
        parts: list[tuple[bool, str]] = []
        for i, (key, word) in enumerate(words):
            last = parts[-1] if parts else None
            if key:
                if last and not last[0]:
                    parts[-1] = (False, last[1] + " ")
                elif last:
                    parts.append((False, " "))
                parts.append((True, word))
            elif last and not last[0]:
                parts[-1] = (False, f"{last[1]} {word}")
            else:
                parts.append((False, f" {word}" if i else word))
        edits = min(MOST_EDITS, sum(len(x) for key, x in parts if not key) // chars_per_edit)
        body = "".join(f"(?<![^ ]){regex.escape(x)}(?![^ ])" if key else f"(?:{regex.escape(x)}){{e<={edits}}}" if len(x) > 1 else regex.escape(x) for key, x in parts)
        return cls(" ".join(w for _, w in words), label, edits, tuple(parts), regex.compile(f"(?b){body}"))

    def seeds(self) -> list[tuple[str, int]]:
        """The pieces, one more than edits, and where they stand: one of them is whole in every match."""
        n, k = len(self.name), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(self.name[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Span:
    label: str
    notice: str
    start: int
    end: int
    edits: int


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...], chars_per_edit: int):
        self.notices = [Notice.of(text, label, chars_per_edit) for text, label in notices]
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base]
        seeds = defaultdict(list)
        for i, notice in enumerate(self.notices):
            for seed, at in notice.seeds():
                seeds[seed].append((i, len(seed) + at - 1))  # from a piece's last character back to the notice's first
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, places)
        self.automaton.make_automaton()

    def phrases(self, joined: bytes) -> Iterator[tuple[str, int]]:
        """Label and first word of every base phrase in the words, each between single spaces."""
        for phrase, label in self.base:
            at, seen, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                yield label, word
                at = joined.find(phrase, at + 1)

    def spans(self, joined: str) -> list[Span]:
        """Every notice's matches, in characters of the joined words."""
        starts: defaultdict[int, set[int]] = defaultdict(set)
        for end, places in self.automaton.iter(joined):
            for i, back in places:
                starts[i].add(end - back)
        out = []
        for i, at in sorted(starts.items()):
            notice, tried, found = self.notices[i], None, set()
            k, n = notice.edits, len(notice.name)
            for start in sorted(at):
                # What begins within k characters lies in the last window too, which is too short for two matches apart.
                if tried is None or start > tried + k:
                    tried = start
                    high = joined.find(" ", min(len(joined), start + n + 3 * k))
                    match = notice.pattern.search(joined, max(0, start - k), high if high >= 0 else len(joined))
                    if match and sum(match.fuzzy_counts) <= k:
                        found.add((sum(match.fuzzy_counts), match.start(), match.end()))
            taken: list[tuple[int, int, int]] = []
            for edits, first, last in sorted(found):
                # taken is in order of place and its matches are apart, so only the neighbours can share a character.
                at_place = bisect(taken, (first, last))
                if (not at_place or taken[at_place - 1][1] <= first) and (at_place == len(taken) or taken[at_place][0] >= last):
                    taken.insert(at_place, (first, last, edits))
            out += [Span(notice.label, notice.name, *x) for x in taken]
        return out


def scanner(notices: tuple, base: tuple, chars_per_edit: int) -> Scanner:
    """One per Python worker and set of notices."""
    key = (notices, base, chars_per_edit)
    if key not in _scanners:
        _scanners[key] = Scanner(*key)
    return _scanners[key]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES, base: tuple = BASE, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word (of base phrases), base_labels, labels, score, spans.

    score: 1 with a base phrase or an unedited notice, else the largest part of a notice's characters that is unedited.
    spans: label, notice, first_word and last_word that the match touches, edits.
    """
    ints, texts = ("n_words", "n_base", "first_word", "last_word"), ("base_labels", "labels")
    span_type = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
    types = [*[pa.int64()] * len(ints), *[pa.string()] * len(texts), pa.float64(), pa.list_(span_type)]
    names = [*ints, *texts, "score", "spans"]

    def described(scan: Scanner, text: str | None) -> tuple:
        words = words_of(text)
        joined = b" ".join(words)
        places = sorted((at, label) for label, at in scan.phrases(b" " + joined + b" "))
        line = joined.decode()
        spans, seen, word = [], 0, 0
        for s in sorted(scan.spans(line), key=lambda s: (s.start, s.end, s.label, s.notice)):
            word, seen = word + line.count(" ", seen, s.start), s.start
            inside = line[s.start : s.end]
            first = word + (len(inside) - len(inside.lstrip(" ")))
            spans.append({"label": s.label, "notice": s.notice, "first_word": first, "last_word": word + inside.rstrip(" ").count(" "), "edits": s.edits})
        whole = [1 - s["edits"] / len(s["notice"]) for s in spans]
        base_labels = {label for _, label in places}
        return (
            len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s["label"] for s in spans})), 1.0 if places else max(whole, default=0.0), spans,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(notices, base, chars_per_edit)
        for batch in pieces(batches):
            rows = [described(scan, text.as_py()) for text in batch["_text"]]
            if rows:
                yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["_id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    ddl = ", ".join([f"_id {kind}", *[f"{x} long" for x in ints], *[f"{x} string" for x in texts], "score double", "spans array<struct<label: string, notice: string, first_word: long, last_word: long, edits: long>>"])
    return rows.mapInArrow(run, ddl).withColumnRenamed("_id", id_col)
