import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import quality

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def text_of(rng, good):
    words = ["".join(rng.choices("abcdefghiklmnoprstuw", k=rng.randrange(1, 9))) for _ in range(rng.randrange(20, 200))]
    if good:
        return " ".join(w.capitalize() + "." if k % 9 == 0 else w for k, w in enumerate(words))
    kind = rng.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " ".join(w + "$$$" for w in words) if kind == 1 else " ".join(w for w in words[:9] for _ in range(20))


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    good = [rng.random() < 0.8 for _ in range(n)]
    return [(i, text_of(rng, g)) for i, g in enumerate(good)], [(i, int(g), 0) for i, g in enumerate(good)]


def held(modulus=4, rest=2):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = corpus()
    found = quality.quality_scores(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(labels, LABELS), held()).collect()
    assert len(found) == len(docs)
    truth = {i: q for i, q, _ in labels}
    unseen = [r for r in found if r.held_out]
    assert len(unseen) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert abs(np.mean([r.score for r in unseen]) - np.mean([truth[r.doc_id] for r in unseen])) < 0.08


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(labels, LABELS)
    turned = frame.withColumn("quality", F.when(held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in quality.quality_scores(spark.createDataFrame(docs, DOCS), x, held()).collect()} for x in (frame, turned)]
    assert scores[0] == scores[1]


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs, labels = corpus(300)
    known = spark.createDataFrame(labels, LABELS)
    models = [quality.quality_model(spark.createDataFrame(docs, DOCS).repartition(n), known)[1] for n in (1, 7)]
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-6)
    x = np.array([quality.statistics(t) for _, t in docs])
    m = models[0]
    y, fits = np.array([q for _, q, _ in labels], float), np.ones(len(docs), bool)
    marks = {r.doc_id: r.c for r in spark.createDataFrame(docs, DOCS).select("doc_id", (F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(quality.CALIBRATES)) == 0).alias("c")).collect()}
    fits = np.array([not marks[i] for i, _ in docs])
    z = m.fourier(x[fits])
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * fits.sum() / quality.FOURIER * np.eye(z.shape[1]), z.T @ y[fits])
    assert np.allclose(m.weights, direct, atol=1e-6)


def test_fourier_features_approximate_the_gaussian_kernel():
    n = len(quality.STATISTICS)
    model = quality.Model(mean=np.zeros(n), scale=np.ones(n))
    x = np.random.default_rng(1).normal(size=(40, n)) * 0.5
    z = model.fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * n))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_isotonic_against_brute_force():
    """Least squares under order equals the max of min means; between the middles of blocks values are interpolated."""
    rng = np.random.default_rng(2)
    counts = rng.integers(200, 900, 30).astype(float)
    counts[[3, 4, 11]] = 0
    sums = np.round(counts * np.clip(np.linspace(0, 1, 30) + rng.normal(size=30) * 0.02, 0, 1))
    mean = lambda i, j: sums[i : j + 1].sum() / counts[i : j + 1].sum()
    at = np.flatnonzero(counts)
    plain = np.array([max(min(mean(i, j) for j in at[at >= k]) for i in at[at <= k]) for k in at])
    got = quality.isotonic(sums, counts)
    assert (np.diff(got) >= 0).all()
    alone = [k for k, v in enumerate(plain) if (plain == v).sum() == 1]
    assert len(alone) > 10
    assert np.abs(got[at] - plain)[alone].max() < 0.01
    assert np.abs(got[at] - plain).max() < 0.05
    assert got[3] < got[4] < got[5]


def test_statistics_of_odd_texts():
    for text in ("", " ", "\n\n", "!", "a", "é" * 10, "\ud800 x", "word " * 50_000):
        values = quality.statistics(text)
        assert len(values) == len(quality.STATISTICS)
        assert np.isfinite(values).all()
    assert quality.statistics("a a a b")[quality.STATISTICS.index("repeats")] == 0.5
    assert quality.statistics("x!! y!! z")[quality.STATISTICS.index("marked_words")] == pytest.approx(2 / 3)
    assert quality.statistics("x | y")[quality.STATISTICS.index("sign_words")] == pytest.approx(1 / 3)
    long = "clean words here " * 20_000
    assert quality.statistics(long) != quality.statistics(long + "BAD!! " * 20_000)


@pytest.mark.parametrize("labels,score", [([], 1.0), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0), (7, 1, 0), (None, 1, 1), (3, None, 0)], 1 / 3)])
def test_nothing_to_learn(spark, labels, score):
    docs = [(1, "some text"), (2, None), (3, ""), (None, "text"), (3, "")]
    found = quality.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 5
    assert all(r.score == pytest.approx(score) for r in found)


def test_empty_clashing_and_filter(spark):
    docs, labels = corpus(300)
    known = spark.createDataFrame([*labels, *labels[:50]], LABELS)
    assert quality.quality_scores(spark.createDataFrame([], DOCS), known).collect() == []
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in [*docs, (None, None), docs[0], docs[0]]], DOCS + ", _stats int, predicted string")
    scores = quality.quality_scores(frame, known).collect()
    assert len(scores) == 303
    kept = quality.good_documents(frame, known)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scores if r.predicted)


def test_scores_against_a_fit_in_one_place(spark):
    """The whole classifier once more over all rows at once: standardised statistics, features, ridge, pooled bins."""
    docs, labels = corpus(500, seed=11)
    found = {r.doc_id: r.score for r in quality.quality_scores(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS), held()).collect()}
    marks = spark.createDataFrame(docs, DOCS).select("doc_id", held().alias("held"), (F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(quality.CALIBRATES)) == 0).alias("c"))
    mark = {r.doc_id: (r.held, r.c) for r in marks.collect()}
    x = np.array([quality.statistics(t) for _, t in docs])
    learn = np.array([not mark[i][0] for i, _ in docs])
    calibrates = np.array([mark[i][1] for i, _ in docs])
    y = np.array([q for _, q, _ in labels], float)
    draw = np.random.default_rng(quality.SEED)
    directions, phases = draw.normal(size=(x.shape[1], quality.FOURIER)) / np.sqrt(x.shape[1]), draw.uniform(0, 2 * np.pi, quality.FOURIER)
    mean, scale = x[learn].mean(axis=0), np.maximum(x[learn].std(axis=0), 1e-6)
    z = np.sqrt(2 / quality.FOURIER) * np.cos(np.clip((x - mean) / scale, -4, 4) @ directions + phases)
    z = np.append(z, np.ones((len(z), 1)), axis=1)
    fits = learn & ~calibrates
    ridge = quality.RIDGE * fits.sum() / quality.FOURIER
    stacked = np.vstack([z[fits], np.sqrt(ridge) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(stacked, np.append(y[fits], np.zeros(z.shape[1])), rcond=None)[0]
    raw = np.clip(z @ weights, 0, 1)
    bins = np.minimum(quality.BINS - 1, (raw * quality.BINS).astype(int))
    chosen = learn & calibrates
    # Isotonic means by the greatest of all least means that a bin's blocks allow.
    used = sorted(set(bins[chosen]))
    sums, counts = [y[chosen & (bins == b)].sum() for b in used], [int((chosen & (bins == b)).sum()) for b in used]
    level = [max(min(sum(sums[i : k + 1]) / sum(counts[i : k + 1]) for k in range(j, len(used))) for i in range(j + 1)) for j in range(len(used))]
    places, values = [], []
    for v in sorted(set(np.round(level, 12))):
        own = [j for j, w in enumerate(level) if abs(w - v) < 1e-9]
        n, s = sum(counts[j] for j in own), sum(sums[j] for j in own)
        places.append(sum(used[j] * counts[j] for j in own) / n)
        values.append((s + y[chosen].mean()) / (n + 1))
    table = np.interp(np.arange(quality.BINS), places, np.maximum.accumulate(values))
    want = 0.999 * np.interp(raw, (np.arange(quality.BINS) + 0.5) / quality.BINS, table) + 0.001 * raw
    assert np.allclose([found[i] for i, _ in docs], want, atol=1e-5)
