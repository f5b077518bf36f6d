"""Language identification by hierarchical discrimination.

The language family is predicted first; within it, one-versus-one linear support vector machines tell the languages
apart. Both levels vote over pairs of classes. A text's features are the frequencies of its hashed character n-grams of
one to three, square-rooted, from the whole text; runs of anything but letters count as one space.

All machines are fitted together: squared hinge loss with both sides of a pair weighing the same, by accelerated
gradient steps whose gradients are summed over the partitions of the sample. The sample has about PER_LANGUAGE labelled
texts of each language, chosen by a hash of the id.

Defined cases: a null text or one without a letter is `und` with a score of 0; rows with a null language aren't learned
from; with one learned language all texts with letters are predicted as that, at a score of 1, and with none as `und`; a
language outside FAMILIES is a family of its own; repeated rows are predicted each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut, pieces

UNKNOWN = "und"
#: Labelled texts of each language that are learned from, in expectation.
PER_LANGUAGE = 3000
FEATURES = 2048
STEPS, RIDGE = 40, 1e-3
SAMPLE_PARTS = 12
#: Steepness of the logistic curve from margins to scores.
STEEP = 3.0

#: Language families by ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Odd multipliers of the n-grams' characters.
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters or marks on letters."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(1 << 16)])
    return _tables["letters"]


@cache
def category(code: int) -> str:
    return unicodedata.category(chr(code))[0]


def features(text: str) -> np.ndarray | None:
    """A vector of length 1; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = letters()
    is_letter = known[np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        is_letter[far] = [category(c) in "LM" for c in codes[far].tolist()]
    # Marks without any letter are no text of a language.
    if not is_letter.any() or not any(category(c) == "L" for c in codes[is_letter].tolist()):
        return None
    codes = np.concatenate([[np.uint32(0)], np.where(is_letter, codes, np.uint32(0)), [np.uint32(0)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    shift = np.uint32(32 - int(np.log2(FEATURES)))
    one = codes * _MIX[0]
    two = one[:-1] + codes[1:] * _MIX[1]
    three = two[:-1] + codes[2:] * _MIX[2]
    counts = np.zeros(FEATURES)
    for grams in (one, two, three):
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(grams >> shift, minlength=FEATURES)
    return np.sqrt(counts / counts.sum())


@dataclass
class Model:
    """pairs: (level, class, class), where level is "" for families, else a family; weights: a row for each pair, the bias last."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    centre: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        margins = (x - self.centre) @ self.weights[:, :-1].T + self.weights[:, -1] if self.pairs else np.zeros((len(x), 0))
        chances = 1 / (1 + np.exp(-STEEP * np.clip(margins, -10, 10)))
        out = []
        for row in chances:
            family, first = self._vote("", sorted(self.families), row)
            language, second = self._vote(family, self.families[family], row)
            out.append((language, float(first * second)))
        return out

    def _vote(self, level: str, classes: list[str], row: np.ndarray) -> tuple[str, float]:
        if len(classes) == 1:
            return classes[0], 1.0
        votes, sums = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
        for (at, a, b), chance in zip(self.pairs, row, strict=True):
            if at == level:
                votes[a if chance >= 0.5 else b] += 1
                sums[a] += chance
                sums[b] += 1 - chance
        best = max(classes, key=lambda c: (votes[c], sums[c]))
        return best, sums[best] / (len(classes) - 1)


def sample(docs: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """_lang, x of about so many texts of each language."""
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit("language"), "_id"), F.lit(1 << 20)) < rates[F.col("_lang")] * (1 << 20)).select("_lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for lang, text in zip(batch["_lang"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                x = features(text)
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([x.astype(np.float16).tobytes()], pa.binary())], ["_lang", "x"])

    return cut(chosen.mapInArrow(run, "_lang string, x binary").repartition(SAMPLE_PARTS))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs: _id, _lang, _text, labelled rows only."""
    learnable = docs.filter("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = {r["_lang"]: r["count"] for r in docs.filter("_lang IS NOT NULL").groupBy("_lang").count().collect()}
    rows = sample(learnable, counts, per_language) if counts else None
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()} if counts else {}
    families: dict[str, list[str]] = {}
    for lang in sorted(sizes):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    pairs = [("", a, b) for a, b in combinations(sorted(families), 2)]
    pairs += [(family, a, b) for family, members in sorted(families.items()) for a, b in combinations(members, 2)]
    centre, weights = np.zeros(FEATURES), np.zeros((len(pairs), FEATURES + 1))
    if not pairs:
        return Model(families, pairs, centre, weights)

    # For each language its sign and weight in each pair; both sides of a pair weigh one half.
    signs = {lang: np.zeros(len(pairs)) for lang in sizes}
    shares = {lang: np.zeros(len(pairs)) for lang in sizes}
    for k, (level, *sides) in enumerate(pairs):
        for sign, side in zip((1, -1), sides, strict=True):
            members = [side] if level else families[side]
            for lang in members:
                signs[lang][k] = sign
                shares[lang][k] = 0.5 / (len(members) * sizes[lang])

    def over_parts(of_part) -> list[np.ndarray]:
        """Sums over the partitions of what of_part(languages, x) returns: a matrix of FEATURES + 1 columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in pieces(batches):
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
                    total = total + of_part(batch["_lang"].to_pylist(), x)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["sums"])

        found = rows.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r.sums, np.float32).reshape(-1, FEATURES + 1).astype(np.float64) for r in found)

    def means(langs: list[str], x: np.ndarray) -> np.ndarray:
        each = np.array([1 / sizes[lang] for lang in langs])
        return np.append(each @ x, each.sum())[None, :] / len(sizes)

    centre = over_parts(means)[0, :-1]

    def gradient(w: np.ndarray) -> np.ndarray:
        def of_part(langs: list[str], x: np.ndarray) -> np.ndarray:
            x = np.append(x - centre, np.ones((len(x), 1)), axis=1)
            y, c = np.array([signs[lang] for lang in langs]), np.array([shares[lang] for lang in langs])
            short = np.maximum(0, 1 - y * (x @ w.T))
            return -2 * (c * y * short).T @ x

        ridge = w * RIDGE
        ridge[:, -1] = 0
        return over_parts(of_part) + ridge

    # Accelerated steps. The centred features' squared length is below 1, but for the bias.
    ahead, before, step = weights, weights, 1 / (2 * 2 + RIDGE)
    for k in range(STEPS):
        weights = ahead - step * gradient(ahead)
        ahead, before = weights + k / (k + 3) * (weights - before), weights
    return Model(families, pairs, centre, weights)


def predictions(rows: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to rows that have _text; their other columns stay."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(text) if text else None for text in batch["_text"].to_pylist()]
            known = [i for i, x in enumerate(found) if x is not None]
            out = [(UNKNOWN, 0.0)] * batch.num_rows
            if known:
                for i, pair in zip(known, model.predict(np.array([found[i] for i in known])), strict=True):
                    out[i] = pair
            columns = [batch[f.name] for f in kept] + [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: id, held_out, lang_pred, score. Rows for which held_out is true are not learned from."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), held_out.alias("_held"))
    model = fit(rows.filter(~F.col("_held")).drop("_held"), per_language)
    out = predictions(rows.select("_id", "_held", "_text"), model)
    return out.withColumnsRenamed({"_id": id_col, "_held": "held_out"})
