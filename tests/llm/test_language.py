import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import language

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ung ein ich der keit ge ver ß ö", "fr": "eau tion ou é è que oi aux le ch", "es": "ción ar os ñ ez ll ue í do qu"}
DOCS = "doc_id long, text string, lang string"


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n)).capitalize()


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    langs = [rng.choice([*SYLLABLES, "en"]) for _ in range(n)]
    return [(i, words(rng, lang, rng.randrange(6, 80)) + rng.choice(["", "!! 123", " #$%"]), lang) for i, lang in enumerate(langs)]


def run(docs, modulus=3):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 1
    return {r.doc_id: r for r in language.language_id(docs, held).collect()}


def test_held_out_accuracy(spark):
    rows = corpus()
    found = run(spark.createDataFrame(rows, DOCS).repartition(5))
    assert len(found) == len(rows)
    held = [(lang, found[i]) for i, _, lang in rows if found[i].held_out]
    assert 60 < len(held) < 220
    assert sum(r.lang_pred == lang for lang, r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_predictions_take_only_the_text(spark):
    """Other labels and ids of held-out rows change nothing."""
    rows = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    found = run(docs)
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "en").otherwise(F.col("lang")))
    again = run(swapped)
    assert {i: r.lang_pred for i, r in found.items()} == {i: r.lang_pred for i, r in again.items()}


def test_the_end_of_a_long_text_counts():
    start, end = "the and " * 10, "ñ ción " * 5000
    both, first = language.features(start + end), language.features(start)
    assert not np.allclose(both, first)
    assert abs(np.linalg.norm(both) - 1) < 1e-9


def test_other_scripts_and_signs_have_letters_or_not():
    assert language.features("123 !? --") is None
    assert language.features("") is None
    assert language.features("日本語") is not None
    assert language.features("\U00020000") is not None


@pytest.mark.parametrize("langs,expected", [([None, None, None], "und"), (["fr", "fr", None], "fr")])
def test_few_learned_languages(spark, langs, expected):
    rows = [(i, "le texte", lang) for i, lang in enumerate(langs)] + [(10, None, "fr"), (11, "12!", "de"), (None, "le mot", None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = language.language_id(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == {(0, expected), (1, expected), (2, expected), (10, "und"), (11, "und"), (None, expected)}


def test_empty_table_repeats_and_clashing_columns(spark):
    assert language.language_id(spark.createDataFrame([], DOCS), F.lit(False)).collect() == []
    rows = [(*r, 1, "x") for r in [*corpus(60), *corpus(60)]]
    docs = spark.createDataFrame(rows, DOCS + ", _id int, lang_pred string")
    found = language.language_id(docs, F.lit(False)).collect()
    assert len(found) == 120
    assert len({(r.doc_id, r.lang_pred) for r in found}) == 60


def test_a_language_outside_the_table_is_a_family():
    assert "xx" not in language.FAMILY_OF
    model = language.Model({"xx": ["xx"], "romance": ["es", "fr"]}, [("", "romance", "xx"), ("romance", "es", "fr")], np.zeros(2), np.array([[-9.0, 0, 0], [0, 9.0, 0]]))
    (lang, score), (other, _) = model.predict(np.array([[1.0, 0.0], [-1.0, 1.0]]))
    assert (lang, other) == ("xx", "es")
    assert score > 0.9


def test_symbols_and_marks_alone_are_no_letters():
    from terrace.llm.language import features

    assert features("\U0001f600 \U0001f680") is None and features("́ ̂") is None
    assert features("\U00010330\U00010331") is not None and features("é \U0001f600") is not None


def test_predictions_against_a_fit_in_one_place(spark):
    """All machines once more over all rows at once, with the same steps."""
    import random

    rng = random.Random(12)
    alphabets = {"de": "abcdeäöüßsch", "nl": "abcdeijoou", "es": "abcdeñaoll", "fr": "abcdeéèçou", "fi": "aäkiontyö", "xx": "qwxzvkj"}
    text = lambda lang: " ".join("".join(rng.choices(alphabets[lang], k=rng.randrange(2, 8))) for _ in range(rng.randrange(5, 40)))
    rows = [(i, lang, text(lang)) for i in range(360) for lang in [rng.choice(list(alphabets))]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(docs, F.col("doc_id") % 3 == 1).collect()}

    x = np.array([language.features(t).astype(np.float16).astype(np.float64) for _, _, t in rows])
    langs, learn = np.array([lang for _, lang, _ in rows]), np.array([i % 3 != 1 for i, _, _ in rows])
    family = {lang: language.FAMILY_OF.get(lang, lang) for lang in alphabets}
    names = sorted(set(family.values()))
    machines = [("", a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    for f in names:
        own = sorted(lang for lang in alphabets if family[lang] == f)
        machines += [(f, a, b) for k, a in enumerate(own) for b in own[k + 1 :]]
    size = {lang: (langs[learn] == lang).sum() for lang in alphabets}
    centre = np.mean([x[learn & (langs == lang)].mean(axis=0) for lang in alphabets], axis=0)
    z = np.append(x - centre, np.ones((len(x), 1)), axis=1)
    weights = []
    for level, a, b in machines:
        side = {lang: 1 if (lang if level else family[lang]) == a else -1 if (lang if level else family[lang]) == b else 0 for lang in alphabets}
        share = {lang: 0.5 / (size[lang] * sum(side[o] == side[lang] for o in alphabets)) if side[lang] else 0 for lang in alphabets}
        y, c = np.array([side[lang] for lang in langs[learn]]), np.array([share[lang] for lang in langs[learn]])
        w = ahead = before = np.zeros(z.shape[1])
        for k in range(language.STEPS):
            ridge = ahead * language.RIDGE
            ridge[-1] = 0
            slope = -2 * (c * y * np.maximum(0, 1 - y * (z[learn] @ ahead))) @ z[learn] + ridge
            w = ahead - slope / (4 + language.RIDGE)
            ahead, before = w + k / (k + 3) * (w - before), w
        weights.append(w)
    margins = np.clip(z @ np.array(weights).T, -10, 10)
    chance = 1 / (1 + np.exp(-language.STEEP * margins))

    def vote(level, classes, row):
        if len(classes) == 1:
            return classes[0], 1.0
        total = {c: [0, 0.0] for c in classes}
        for (at, a, b), p in zip(machines, row, strict=True):
            if at == level:
                total[a if p >= 0.5 else b][0] += 1
                total[a][1] += p
                total[b][1] += 1 - p
        best = max(classes, key=lambda c: tuple(total[c]))
        return best, total[best][1] / (len(classes) - 1)

    wrong = 0
    for (i, _, _), row in zip(rows, chance, strict=True):
        f, first = vote("", names, row)
        lang, second = vote(f, sorted(o for o in alphabets if family[o] == f), row)
        wrong += found[i][0] != lang or abs(found[i][1] - first * second) > 2e-3
    assert wrong <= 2, "sums in single precision may turn a tie"
