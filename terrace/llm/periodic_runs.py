"""Periodic runs of words, by divide and conquer after Main and Lorentz.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least LEAST words and
TIMES periods, which no neighbouring word extends. Words of a text are interned as numbers. A stretch of the text is
halved; runs that cross its middle are found by Z-functions: for each period, how far words a period apart stay the same
from the middle to the right and to the left, once with a period's words before the middle and once with them behind it.
Runs on one side are found in the halves. What could go on beyond the stretch is the part of a run found before and is
passed over; of runs over the same words the one with the smallest period stays.

Only stretches that can hold a run are looked into: all but a period's words of a run begin windows of WINDOW words that
come once more later in the text, so a run lies within one and a half times such a stretch of windows. This leaves no run out,
as windows are compared by hash and a collision only adds a stretch.

It is one pass; a text is the unit of work, and time is n log n in its words.

Defined cases: a null or empty text has no words and no run; repeated rows are treated each alike; an empty table gives an
empty result; the input's other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import WORD, pieces, text_of

LEAST, TIMES = 24, 3
#: A run with LEAST and TIMES as above has at least FLAGS windows in a row that come again.
WINDOW, FLAGS = 8, 9

#: Odd multipliers, one for each word of a window.
_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (1 << 64) - 1) for i in range(WINDOW)]


def z_function(s: list[int], count: int) -> list[int]:
    """For each of the first count positions of s: how many items from there on equal those from the start on."""
    n, z, left, right = len(s), [len(s)], 0, 0
    for i in range(1, min(count, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z.append(k)
    return z


def common(pattern: list[int], z: list[int], s: list[int], count: int) -> list[int]:
    """For each of the first count positions of s: how many items from there on equal those of pattern. z: its Z-function."""
    m, n, out, left, right = len(pattern), len(s), [], 0, 0
    for i in range(count):
        k = min(right - i, z[i - left]) if i < right else 0
        while k < m and i + k < n and pattern[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out.append(k)
    return out


def crossing(s: list[int], low: int, mid: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and period of the repetitions within s[low:high] that cross mid and are long enough."""
    after, before = s[mid:high], s[low:mid][::-1]
    most = (high - low) // TIMES
    left, right = min(most, len(before)), min(most, len(after))
    z_after, z_before = z_function(after, max(right, left) + 1), z_function(before, max(right, left) + 1)
    # A period's words before the middle: s[mid - p:] goes on like s[mid:], and s[:mid - p] backwards like s[:mid].
    ahead = np.array(common(after, z_after, s[mid - left : high], left)[::-1], np.int64)
    back = np.array((z_before[1 : left + 1] + [0] * left)[:left], np.int64)
    period = np.arange(1, left + 1)
    for k in np.flatnonzero((ahead > 0) & (period + ahead + back >= np.maximum(LEAST, TIMES * period))).tolist():
        yield mid - (k + 1) - int(back[k]), mid + int(ahead[k]), k + 1
    # And behind it.
    back = np.array(common(before, z_before, s[low : mid + right][::-1], right)[::-1], np.int64)
    ahead = np.array((z_after[1 : right + 1] + [0] * right)[:right], np.int64)
    period = np.arange(1, right + 1)
    for k in np.flatnonzero((back > 0) & (period + ahead + back >= np.maximum(LEAST, TIMES * period))).tolist():
        yield mid - int(back[k]), mid + (k + 1) + int(ahead[k]), k + 1


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text, apart from each other, that hold all its runs."""
    n = len(ids) - WINDOW + 1
    if len(ids) < LEAST:
        return []
    keys = ids.astype(np.uint64) + np.uint64(1)
    hashes = np.zeros(n, np.uint64)
    for i, mix in enumerate(_MIX):
        x = keys[i : i + n] * mix
        hashes += x ^ (x >> np.uint64(29))
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[:-1]] == hashes[order[1:]]
    if np.count_nonzero(again) < FLAGS:
        return []
    flags = np.zeros(n + 2, np.int8)
    flags[order[:-1][again] + 1] = 1
    edges = np.diff(flags)
    out: list[tuple[int, int]] = []
    for x, y in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        if y - x >= FLAGS:
            end = min(len(ids), x + (3 * (y - x) + 2 * WINDOW + 7) // 2)
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((x, end))
    return out


def periodic_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run of a text's words, by start, then period. ids: equal for equal words."""
    found: dict[tuple[int, int], int] = {}
    for first, last in stretches(ids):
        s = ids[first:last].tolist()
        waiting = [(0, len(s))]
        while waiting:
            low, high = waiting.pop()
            if high - low < LEAST:
                continue
            mid = (low + high) // 2
            for start, end, p in crossing(s, low, mid, high):
                if (start == low > 0 and s[start - 1] == s[start - 1 + p]) or (end == high < len(s) and s[end] == s[end - p]):
                    continue
                key = (first + start, first + end)
                found[key] = min(p, found.get(key, p))
            waiting += [(low, mid), (mid, high)]
    return sorted(((start, end - start, p) for (start, end), p in found.items()), key=lambda r: (r[0], r[2]))


def interned(words: list[bytes]) -> np.ndarray:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; runs are in order, so of equal ones the first stays."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run has after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document: id, n_runs, the strongest run's start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    texts: also runs (array of start, length, period) and collapsed, the text without repeated periods.
    """
    fields = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    ddl = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts:
        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        fields += [("runs", pa.list_(run_type)), ("collapsed", pa.string())]
        ddl += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def described(text: str | None) -> tuple:
        words = (text or "").encode().split()  # bytes: split() knows ASCII white space only
        runs = periodic_runs(interned(words))
        best = strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(collapsed(words, runs))
        row = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode()) if texts else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [described(text.as_py()) for text in batch["_text"]]
            if rows:
                yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], ["_id", *(name for name, _ in fields)])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {ddl}").withColumnRenamed("_id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of a document, but in one of ten by the id's hash, where words from a place on repeat a period; a row without an id stays as it is.

    With h the crc32 of the id, g = h // 10 and n words: from a = g % n on, words repeat those from a on with period
    1 + (n - a) // (3 + g % 8).
    """
    digest = F.crc32(docs[id_col].cast("string").cast("binary"))
    words = F.regexp_extract_all(text_of(docs[text_col]), F.lit(WORD), F.lit(0))
    g = F.floor(digest / 10).cast("long")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at(w, a + i % p + 1))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), tail)).otherwise("")

    return F.when(digest % 10 == 0, F.element_at(F.transform(F.array(words), planted), 1)).otherwise(docs[text_col])
