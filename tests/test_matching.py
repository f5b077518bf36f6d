"""Greedy matching and folding against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import entities, hierarchy, matching, near_sets, ranking


def test_claims_are_taken_in_turn(spark):
    rng = random.Random(1)
    rows = [(n, n, c, rng.choice([700, 650]), c) for n in range(40) for c in rng.sample(range(30), 6)]
    got = {r.node: r.child for r in matching.claimed(spark.createDataFrame(rows, "node long, turn long, child long, score int, place long")).collect()}
    taken, want = set(), {}
    for n in range(40):
        for _, _, c, _, _ in sorted((r for r in rows if r[0] == n), key=lambda r: (-r[3], r[4])):
            if c not in taken:
                taken.add(c)
                want[n] = c
                break
    assert got == want


def test_descent(spark):
    stored = [(1, None, "Asia"), (2, 1, "Kyrgyzstan"), (3, 2, "Osh (city)"), (4, 2, "Osh"), (5, 1, "Russia"), (6, 5, "Ural"), (7, 6, "Perm Krai"), (8, 5, "Far East")]
    imported = [(11, None, "Asia"), (12, 11, "Kyrgyzstan"), (13, 12, "Osh"), (14, 12, "Osh (city)"), (15, 11, "The north"), (16, 15, "Russia"), (17, 16, "Perm Krai"), (18, 16, "Nowhere"), (19, 4_000, "Lost")]
    schema = "id long, parent_id long, name string"
    tree = spark.createDataFrame(stored, schema)
    got = {r.node: (r.division, r.status) for r in matching.descended(spark.createDataFrame(imported, schema), tree, hierarchy.closure(tree)).collect()}
    assert got == {
        11: (1, "auto_matched"), 12: (2, "auto_matched"), 13: (4, "auto_matched"), 14: (3, "auto_matched"), 15: (None, "needs_review"),
        16: (5, "auto_matched"), 17: (7, "auto_matched"), 18: (None, "needs_review"),
    }


@pytest.mark.parametrize("a,b,same", [("ingush", "ingushetia", True), ("bav", "bava", False), ("kabardino-balkaria", "kabardin-balkar", True), ("abcd-x", "abcd", True), ("north-one", "north", False), ("ab-cd", "ab-ce", False)])
def test_prefixes(spark, a, b, same):
    r = spark.range(1).select(text.is_prefix_match(F.lit(a), F.lit(b)).alias("x"), text.is_prefix_match(F.lit(b), F.lit(a)).alias("y")).first()
    assert (r.x, r.y) == (same, same)


def test_similar_names(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(2, 9)))
    names = [(i, " ".join(word() for _ in range(rng.randrange(1, 3))), i % 2) for i in range(80)]
    nodes = spark.createDataFrame([(i, n[: 1 + i % 9] + word(), s) for i, n, s in names], "node long, name string, scope int")
    stored = spark.createDataFrame(names, "id long, name string, scope int")
    got = {(r.node, r.id): r.score for r in matching.similar(nodes, stored).collect()}
    both = nodes.join(stored.select("id", F.col("name").alias("other"), "scope"), "scope")
    grams = lambda c: text.trigrams(text.normalised(F.col(c)))
    want = both.withColumn("score", text.similarity(grams("name"), grams("other"))).filter("score > 0.3")
    assert got == {(r.node, r.id): r.score for r in want.collect()}
    assert len(got) > 30


def test_most_similar_names(spark):
    """The best of all pairs, with equal scores and copies, out of sets rather than pairs of copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(2, 8)))
    names = [f"customer {word()}" for _ in range(40)] + [word() for _ in range(40)] + ["", "-"]
    stored = spark.createDataFrame([(i, names[i * 7 % len(names)], i % 2) for i in range(300)], "id long, name string, scope int")
    nodes = spark.createDataFrame([(i, names[i % len(names)] + ("" if i % 3 else word()), i % 2) for i in range(200)] + [(900, None, 1)], "node long, name string, scope int")
    want = ranking.first_per(matching.similar(nodes, stored), ["node"], [F.desc("score"), F.asc("id")], 5)
    want = {(r.node, r.id): r.score for r in want.collect()}
    got = {(r.node, r.id): r.score for r in matching.most_similar(nodes, stored, 5).collect()}
    assert got == want and len(want) > 500


def test_folds_against_brute_force(spark):
    rng = random.Random(7)
    venues = [(i, rng.choice([0, 1, 2]) * 0.01 + rng.randrange(4) * 0.0002, 50 + rng.randrange(3) * 0.0002, rng.randrange(3), rng.randrange(4)) for i in range(60)]
    parents = [(i, rng.randrange(60)) for i in range(0, 60, 4)]
    schema = "id long, lon double, lat double, works int, links int"
    got = {r.id: r.into for r in entities.folds(spark.createDataFrame(venues, schema), spark.createDataFrame(parents, "id long, parent long")).collect()}

    def metres(a, b):
        return math.hypot((a[1] - b[1]) * math.cos(math.radians(a[2])) * 111_320, (a[2] - b[2]) * 110_540)

    strength = lambda v: (v[3], v[4], v[0])
    by_id, want = {v[0]: v for v in venues}, {}
    for i, p in parents:
        if i != p and metres(by_id[i], by_id[p]) <= 250:
            want[i] = p
    rest = sorted((v for v in venues if v[0] not in want), key=strength, reverse=True)
    for k, v in enumerate(rest):
        near = [o for o in rest[:k] if o[0] not in want and metres(v, o) < 40]
        if near:
            want[v[0]] = max(near, key=strength)[0]
    for start in list(want):
        walked, at = [], start
        while at in want and at not in walked:
            walked.append(at)
            at = want[at]
        if at in walked:
            cycle = walked[walked.index(at) :]
            del want[max(cycle, key=lambda i: strength(by_id[i]))]
    assert got == want
    ends = {r.id: r.survivor for r in entities.survivors(spark.createDataFrame(sorted(want.items()), "id long, into long")).collect()}
    for i, end in ends.items():
        while i in want:
            i = want[i]
        assert i == end


def test_folds_of_crowded_spots(spark):
    """A weak venue folds into the strongest one that stays, though a weaker one near it is known to stay rounds before; many at one spot make no pairs."""
    at = lambda k, x, links: (k, x * 20 / 111_320, 0.0, 0, links)  # noqa: E731 - steps of 20 m along the equator
    row = [at(1, 0, 50), at(2, 1.5, 40), at(3, 3, 30), at(4, 5.5, 20), at(5, 4.5, 10)]
    crowd = [at(k, 1000, 0) for k in range(100, 400)]
    got = {r.id: r.into for r in entities.same_spot(spark.createDataFrame(row + crowd, "id long, lon double, lat double, works int, links int")).collect()}
    assert got == {2: 1, 5: 3, **dict.fromkeys(range(100, 399), 399)}


def test_pairs_by_beginnings_against_all_pairs(spark):
    """Every pair that the rules accept meets on a key, whatever the hyphens and empty parts."""
    import random

    from pyspark.sql import functions as F

    from terrace.functions import text
    from terrace.operators import matching

    rng = random.Random(6)
    names = ["-".join("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", " State"]) for _ in range(120)] + ["----", "a--b", "é é é é"]
    nodes = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "node long, anchor long, name string")
    children = spark.createDataFrame([(i, i % 2, n, i) for i, n in enumerate(reversed(names))], "child long, anchor long, name string, place long")
    got = {(r.node, r.child): r.score for r in matching.child_pairs(nodes, children).collect()}
    every = nodes.select("node", "anchor", text.variants(F.col("name")).alias("w")).join(children.select("child", "anchor", text.normalised(F.col("name")).alias("n"), text.variants(F.col("name")).alias("v")), "anchor")
    want = {(r.node, r.child): r.s for r in every.select("node", "child", text.child_score(F.col("w"), F.col("n"), F.col("v")).alias("s")).filter("s IS NOT NULL").collect()}
    assert got == want and len(want) > 200


def test_best_children_and_candidates_of_repeated_names(spark):
    """Copies of a name are matched once: the same rows as from all pairs, out of no more pairs than distinct names make."""
    names = ["Anna", "Annabel", "Berg State", "Berg", "x (note)"]
    nodes = spark.createDataFrame([(i, i // 50, names[i % 5]) for i in range(100)], "node long, anchor long, name string")
    children = spark.createDataFrame([(i, i // 50, names[i % 4], 1000 - i) for i in range(100)], "child long, anchor long, name string, place long")
    assert matching.name_pairs(nodes, children).count() == 2 * 6
    pairs = matching.child_pairs(nodes, children)
    want = {(r.node, r.child, r.score) for r in matching.best_child(pairs).collect()}
    assert {tuple(r) for r in matching.best_children(nodes, children).collect()} == want and len(want) == 80
    counts = {r.node: (r.n, r.best) for r in pairs.groupBy("node").agg(F.count("*").alias("n"), F.max("score").alias("best")).collect()}
    assert {r.node: (r.n, r.best) for r in matching.candidates(nodes, children).collect()} == {i: counts.get(i, (0, None)) for i in range(100)}


def test_names_are_not_broadcast(spark):
    """A name makes dozens of keys, which the size of a file doesn't show."""
    nodes = spark.createDataFrame([(1, 1, "Anna")], "node long, anchor long, name string")
    children = spark.createDataFrame([(1, 1, "Anna", 1)], "child long, anchor long, name string, place long")
    for df in (matching.best_children(nodes, children), matching.candidates(nodes, children), matching.child_pairs(nodes, children)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_most_similar_names_keep_no_pairs_but_the_best(spark, monkeypatch):
    """Names alike by the hundred: what is kept on the way has no more rows than names, not those of pairs that are good but not best."""
    kept, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: kept.append(df.count()) or cut(df))
    stored = spark.createDataFrame([(i, f"customer {i:06d}", i % 2) for i in range(0, 1200, 2)], "id long, name string, scope int")
    nodes = spark.createDataFrame([(i, f"customer {i:06d} province", i % 2) for i in range(0, 1200, 3)], "node long, name string, scope int")
    got = matching.most_similar(nodes, stored, 5)
    assert got.count() == 200 * 5 and max(kept) <= 600


def test_most_similar_names_in_blocks(spark, monkeypatch):
    """Blocks of one scope, of both sides, give together what one block gives; names without a scope have no like."""
    rng = random.Random(9)
    name = lambda: " ".join("".join(rng.choices("ab1é", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))
    stored = spark.createDataFrame([(i, name(), "x" if i % 9 else None) for i in range(250)], "id long, name string, scope string")
    nodes = spark.createDataFrame([(i, name(), "x" if i % 7 else None) for i in range(90)], "node long, name string, scope string")
    want = ranking.first_per(matching.similar(nodes, stored), ["node"], [F.desc("score"), F.asc("id")], 3)
    want = {(r.node, r.id, r.score) for r in want.collect()}
    for asked, held in ((1000, 1000), (20, 30)):
        monkeypatch.setattr(matching, "ASKED", asked)
        monkeypatch.setattr(matching, "HELD", held)
        assert {(r.node, r.id, r.score) for r in matching.most_similar(nodes, stored, 3).collect()} == want
    assert len(want) > 150


@pytest.mark.parametrize("step,batch,words", [(3, 16, 1), (1 << 18, 512, 4)])
def test_nearest_sets_against_brute_force(monkeypatch, step, batch, words):
    """Whatever the sizes of steps, batches and signatures; with characters beyond 16 bits and ids in any order."""
    for name, value in (("STEP", step), ("BATCH", batch), ("WORDS", words)):
        monkeypatch.setattr(near_sets, name, value)
    rng = random.Random(step)
    grams = lambda name: {f"  {w} "[k : k + 3] for w in name.split(" ") for k in range(len(w) + 1)}
    for letters in ("ab", "0123456789", "aé漢𝄞"):
        name = lambda: " ".join(sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 3))} | ({"customer"} if rng.random() < 0.6 else set())))  # noqa: B023, E731
        asked, held = [name() for _ in range(60)], [name() for _ in range(120)]
        ids_of = np.repeat(np.arange(len(held)), [rng.randrange(1, 4) for _ in held])
        rank, want = np.array(rng.sample(range(len(ids_of)), len(ids_of))), set()
        for i, mine in enumerate(map(grams, asked)):
            scores = [len(mine & theirs) / len(mine | theirs) for theirs in map(grams, held)]
            ids = sorted((-scores[h], rank[j], j) for j, h in enumerate(ids_of) if scores[h] > 0.3)
            want |= {(i, j, -s) for s, _, j in ids[:5]}
        got = list(zip(*(c.tolist() for c in near_sets.nearest(asked, held, ids_of, rank, 5, 0.3)), strict=True))
        assert set(got) == want and len(got) == len(want)
    assert [len(c) for c in near_sets.nearest([], ["a"], np.array([0]), np.array([0]), 5, 0.3)] == [0, 0, 0]
