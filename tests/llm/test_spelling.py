import random
import re
import zlib
from collections import Counter

import pytest

from terrace.llm import spelling as sp

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs, least_length, least_count, deleting):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if deleting and h % deleting == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def edits(word):
    """What a word gives by one deletion, and where something was replaced."""
    return {("deleted", word[:i] + word[i + 1 :]) for i in range(len(word))}, {("replaced", i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def plain_variants(counts, ratio):
    """Near words by all pairs."""
    parts = {w: edits(w) for w in counts}

    def near(u, v):
        return u != v and (bool(parts[u][1] & parts[v][1]) or ("deleted", u) in parts[v][0] or ("deleted", v) in parts[u][0])

    forms, out = {}, []
    for w in counts:
        found = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        forms[w] = (len(found), found[0] if found and counts[found[0]] >= ratio * counts[w] else None)
    for w, (n_near, form) in forms.items():
        root = w
        while forms[root][1] is not None:
            root = forms[root][1]
        out.append((w, form, root, counts[w], n_near, None if form is None else counts[form]))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("limit", [2, 5, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, limit):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 7))): rng.choice([5, 6, 30, 200, 1000]) for _ in range(220)}
    words |= {"x" * n: n for n in (1, 2, 3, 40, 41)} | {"y" + "z" * 39: 5, "": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert key(sp.spelling_variants(df, 5, limit).collect()) == key(plain_variants(words, 5))


def test_chains_of_forms_end_at_the_last(spark):
    words = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in sp.spelling_variants(df).collect()}
    assert {r.root for r in got.values()} == {"abbbbb"} and got["abbbbb"].form is None and got["aaaabb"].n_near == 2


def test_ties_take_the_first_word(spark):
    df = spark.createDataFrame([("testés", 5), ("testéz", 50), ("testéa", 50), ("testÉs", 50)], "word string, n long")
    got = {r.word: r.form for r in sp.spelling_variants(df).collect()}
    assert got["testés"] == "testÉs"


@pytest.mark.parametrize("deleting", [None, 3, 199])
def test_counts_of_words(spark, deleting):
    rng = random.Random(4)
    pool = ["Réunion", "naïveté", "ABCDEF", "abcdefg", "short", "x", "straße", "ÀÉÎõüx", "a×b÷cdef"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(None, "ABCDEF"), (7, None), (8, ""), (9, "1,2;3")] + [(5, "abcdefg " * 5000)] * 2
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = {r.word: r.n for r in sp.word_counts(df, deleting=deleting).collect()}
    assert got == plain_counts(docs, 6, 5, deleting)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sp.spelling_variants(sp.word_counts(df)).collect() == []
    assert sp.spelling_variants(spark.createDataFrame([("lonely", 7)], "word string, n long")).collect() == [("lonely", None, "lonely", 7, 0, None)]


def test_each_pair_is_in_one_block(spark):
    words = ["aaaaaaaa", "aaaaaaa", "aaaabaaa", "abaaaaaa", "aaaaaaab", "aaaaaaaaa"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for limit in (2, 3, 64):
        got = {r.word: r.n_near for r in sp.spelling_variants(df, 5, limit).collect()}
        assert got == {w: n for w, _, _, _, n, _ in plain_variants(dict.fromkeys(words, 5), 5)}


def test_registered_query(spark):
    from terrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert key(QUERIES["op11_spelling"](spark, folder).collect()) == key(plain_variants(plain_counts(docs, 6, 5, 199), 5))
