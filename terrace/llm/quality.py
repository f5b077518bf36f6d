"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

Statistics of each whole text (shares of kinds of characters, repetition of words and lines, lengths) are standardised
over all documents and mapped to random Fourier features, whose inner products approximate a Gaussian kernel. The ridge
scores solve normal equations that are summed over partitions: a partition sends its sums by rows of the matrix, these
are added up by row, and one matrix of fixed size reaches the driver. Isotonic regression on a part of the labelled
documents that the ridge hasn't seen, in bins of its scores, turns scores into chances of label 1.

Defined cases: a null text counts as empty and gets a score like any other; a document's label is the mean of its label
rows that aren't null; labels of ids that no document has are ignored, and so are null ids; where the labels to learn
from are all equal or missing, every document scores (ones + 1) / (labels + 1); repeated rows are scored each alike, and
learned from once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import PIECE_ROWS, cut, pieces, text_of

FOURIER = 256
RIDGE = 1e-3
SEED = 17
#: Standardised statistics are held within so many deviations.
WITHIN = 4.0
#: One of so many labelled documents calibrates, the others fit; scores are calibrated in so many bins.
CALIBRATES, BINS = 4, 512
THRESHOLD = 0.7

LOWER, UPPER, DIGIT, SPACE, STOP, MARK, SIGN, WIDE = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, SIGN, np.uint8)
    kinds[0x80:] = WIDE
    for kind, chars in ((LOWER, "abcdefghijklmnopqrstuvwxyz"), (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (SPACE, " \t\n\r\x0b\x0c"), (STOP, ".,;:'\"()-"), (MARK, "!?")):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


KINDS = _kinds()
STATISTICS = (
    "characters", "words", "lines", "word_length", "upper", "digits", "spaces", "stops", "marks", "signs", "wide", "entropy",
    "variety", "repeats", "commonest", "same_lines", "marked_words", "sign_words", "line_length",
)


def statistics(text: str) -> list[float]:
    """The statistics of one text, all finite; 0 where there is nothing to divide by."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    of = np.bincount(KINDS, weights=counts, minlength=8)
    used = counts[counts > 0] / n
    words = text.split()
    many, lines = max(1, len(words)), text.split("\n")
    seen = Counter(words)
    kinds = KINDS[data]
    odd = (kinds == MARK) | (kinds == SIGN)
    space = kinds == SPACE
    # A word's end after two marks or signs; a word of one mark or sign.
    ends = np.append(space[2:], True)[: max(0, n - 1)]
    marked = int((odd[:-1] & odd[1:] & ends).sum())
    starts, alone = np.append(True, space[:-1]), np.append(space[1:], True)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), min(40.0, n / many),
        of[UPPER] / max(1, of[LOWER] + of[UPPER] + of[WIDE]), of[DIGIT] / n, of[SPACE] / n, of[STOP] / n, of[MARK] / n, of[SIGN] / n, of[WIDE] / n,
        float(-(used * np.log(used)).sum()), math.log1p(len(seen)) / math.log1p(many), sum(map(eq, words, words[1:])) / many,
        max(seen.values(), default=0) / many, 1 - len(set(lines)) / len(lines), marked / many, int((odd & starts & alone).sum()) / many, math.log1p(n / len(lines)),
    ]


def measured(rows: DataFrame) -> DataFrame:
    """Adds _stats to rows that have _text; other columns stay."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_stats array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stats = [statistics(text) for text in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(stats, pa.list_(pa.float64()))], [*(f.name for f in kept), "_stats"])

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    """constant: the score of all documents where nothing could be learned."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    values: np.ndarray | None = None

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant one."""
        draw = np.random.default_rng(SEED)
        directions = draw.normal(size=(len(STATISTICS), FOURIER)) / math.sqrt(len(STATISTICS))
        phases = draw.uniform(0, 2 * math.pi, FOURIER)
        x = np.clip((stats - self.mean) / self.scale, -WITHIN, WITHIN)
        return np.append(np.sqrt(2 / FOURIER) * np.cos(x @ directions + phases), np.ones((len(x), 1)), axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(stats) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the ridge score keeps an order where the calibration is flat."""
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.ridge(stats)
        return 0.999 * np.interp(raw, (np.arange(BINS) + 0.5) / BINS, self.values) + 0.001 * raw


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pools adjacent violators over bins; a value for each bin, those without rows interpolated. One row at the mean smooths each block."""
    mean = sums.sum() / counts.sum()
    blocks: list[list[float]] = []  # sum, count, sum of bin times count
    for at in np.flatnonzero(counts):
        blocks.append([sums[at], counts[at], at * counts[at]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    values = np.maximum.accumulate([(s + mean) / (n + 1) for s, n, _ in blocks])
    return np.interp(np.arange(len(counts)), [at / n for _, n, at in blocks], values)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: _id, _stats of all documents. labels: _id, _label (0 to 1), the rows to learn from."""
    by_id = labels.filter("_id IS NOT NULL AND _label IS NOT NULL").groupBy("_id").agg(F.avg(F.col("_label").cast("double")).alias("_label"))
    known = cut(stats.join(by_id, "_id").select("_stats", "_label", (F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(CALIBRATES)) == 0).alias("_calibrates")))
    rows, ones, least, most = known.agg(F.count("*"), F.sum("_label"), F.min("_label"), F.max("_label")).first()
    parts = known.groupBy("_calibrates").agg(F.count("*")).count()
    if not rows or least == most or parts < 2:
        return Model(constant=((ones or 0) + 1) / (rows + 1))
    dims = range(len(STATISTICS))
    sums = stats.agg(*[F.avg(F.col("_stats")[i]) for i in dims], *[F.stddev_pop(F.col("_stats")[i]) for i in dims]).first()
    model = Model(mean=np.array(sums[: len(dims)], float), scale=np.maximum(np.array(sums[len(dims) :], float), 1e-6))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's sums by row: the features' products, and last the products with the label and the square of the label."""
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for batch in pieces(batches):
            if batch.num_rows:
                z = model.fourier(np.array(batch["_stats"].to_pylist()))
                y = np.array(batch["_label"].to_pylist())
                total += z.T @ np.append(z, y[:, None], axis=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["row", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch["row"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                of[row] = of.get(row, 0) + np.frombuffer(part)
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([x.tobytes() for x in of.values()], pa.binary())], ["row", "sums"])

    fits = known.filter("NOT _calibrates").select("_stats", "_label")
    found = fits.mapInArrow(equations, "row int, sums binary").repartition(16, "row").mapInArrow(added, "row int, sums binary").collect()
    matrix = np.array([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.row)])
    left, right = matrix[:, :-1], matrix[:, -1]
    model.weights = np.linalg.solve(left + RIDGE * left[-1, -1] / FOURIER * np.eye(len(left)), right)

    @F.pandas_udf("int")
    def bin_of(batch: pd.Series) -> pd.Series:
        raw = model.ridge(np.array(batch.tolist())) if len(batch) else np.empty(0)
        return pd.Series(np.minimum(BINS - 1, (raw * BINS).astype(int)))

    bins = known.filter("_calibrates").select(bin_of("_stats").alias("_bin"), "_label").groupBy("_bin").agg(F.sum("_label").alias("_sum"), F.count("*").alias("_n")).collect()
    totals, counts = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        totals[r["_bin"]], counts[r["_bin"]] = r["_sum"], r["_n"]
    model.values = isotonic(totals, counts)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, Model]:
    """The statistics of all documents (_id, _held, _stats) and the model learned from labels of documents that aren't held out."""
    held = F.lit(False) if held_out is None else held_out
    stats = cut(measured(docs.select(F.col(id_col).alias("_id"), held.alias("_held"), text_of(text_col).alias("_text"))))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    return stats, fit(stats.filter(~F.col("_held")), known)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of rows for which held_out is true are not learned from."""
    stats, model = quality_model(docs, labels, held_out, id_col, text_col, label_col)

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(batch.tolist())) if len(batch) else np.empty(0))

    scored = stats.withColumn("_score", score("_stats"))
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, measured again in place, so that no text is shuffled."""
    _, model = quality_model(docs, labels, None, id_col, text_col, label_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), bool)
        for k in range(0, len(texts), PIECE_ROWS):
            stats = [statistics(text) for text in texts.slice(k, PIECE_ROWS).to_pylist()]
            out[k : k + PIECE_ROWS] = model.score(np.array(stats)) >= threshold
        return pa.array(out)

    return docs.filter(good(text_of(text_col)))
