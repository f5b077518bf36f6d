import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrace.llm import periodic_runs as pr


def plain_runs(words):
    """Every run, by trying every period and every place."""
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def runs(words):
    return pr.periodic_runs(pr.interned(words))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=9), st.integers(1, 60)), max_size=6), st.text(alphabet="abc", max_size=20))
def test_random_repetitions(parts, noise):
    words = [c.encode() for s, k in parts for c in (s * k)[:150]] + [c.encode() for c in noise]
    assert runs(words) == plain_runs(words)


@pytest.mark.parametrize("seed", range(12))
def test_nested_and_long_repetitions(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(8):
        base = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 40))]
        inner = base * rng.randint(1, 30)
        words += [*inner, *([b"x"] * rng.randint(0, 40))] * rng.randint(1, 5)
        words += [b"%d" % rng.randint(0, 500) for _ in range(rng.randint(0, 100))]
    assert runs(words) == plain_runs(words)


def test_bounds_of_length_and_exponent():
    for n in (23, 24, 25):
        assert (len(runs([b"a"] * n)) == 1) == (n >= 24)
    for q in (8, 9, 50):
        base = [b"w%d" % i for i in range(q)]
        for extra in (-1, 0, 1):
            words = (base * 4)[: 3 * q + extra]
            assert runs(words) == plain_runs(words) and (len(runs(words)) == 1) == (extra >= 0)


def test_strongest_run_by_exact_ratio():
    assert pr.strongest([(0, 30, 10), (50, 24, 8), (90, 301, 100)]) == (90, 301, 100)
    assert pr.strongest([(0, 30, 10), (50, 24, 8)]) == (0, 30, 10) and pr.strongest([]) is None


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_report_over_awkward_rows(spark):
    docs = [(i, " ".join(str((i * k) % 7) for k in range(i * 3)), "x") for i in range(60)]
    docs += [(None, "a " * 30, "x"), (3, None, "x"), (4, "", "y"), (5, " \t\n", "y"), (6, "é b " * 40, "y"), (7, "a\x0bb\x0cc\r\n" * 30, "y"), (8, "w " * 100_000, None), (8, "w " * 100_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, runs string")
    got = pr.run_report(df.select("doc_id", pr.with_planted_runs(df).alias("text")))
    quick = [d for d in docs if len(d[1] or "") < 100_000]
    assert order(got.filter("doc_id <> 8 OR doc_id IS NULL").collect()) == order([expected(i, t) for i, t, _ in quick if i != 8])
    long = [tuple(r) for r in got.filter("doc_id = 8").collect()]
    assert len(long) == 3 and sorted(r[2:5] for r in long if r[3] == 100_000) == [(0, 100_000, 1)] * 2
    assert pr.run_report(df.filter("doc_id > 100")).collect() == []


def test_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([("k", "start " + "a b c " * 10 + "end")], "key string, body string")
    row = pr.run_report(df, "key", "body", texts=True).collect()[0]
    assert row.collapsed == "start a b c end" and [tuple(r) for r in row.runs] == [(1, 30, 3)]


def test_registered_query(spark):
    from terrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert order(QUERIES["op12_periodic_runs"](spark, folder).collect()) == order([expected(r.doc_id, r.text) for r in docs])


def test_z_functions():
    rng = random.Random(3)
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
    for _ in range(200):
        s, t = ([rng.randint(0, 1) for _ in range(rng.randint(1, 20))] for _ in range(2))
        z = pr.z_function(s, len(s))
        assert z == [lcp(s[i:], s) for i in range(len(s))]
        assert pr.common(s, z, t, min(len(s), len(t))) == [lcp(t[i:], s) for i in range(min(len(s), len(t)))]
    assert pr.stretches(np.arange(100)) == []
