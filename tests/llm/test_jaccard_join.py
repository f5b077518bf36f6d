import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from terrace.llm import jaccard_join as jj


def brute(rows):
    """rows: id to text; id to (n, component)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0 and find(a) != find(b):
                part[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in rows}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed, docs=400):
    """Copies with few to many edits, chains, a passage on most documents, short and empty texts."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    passage = [f"p{k}" for k in range(40)]
    texts, chain = {}, bases[0] * 3
    for i in rng.sample(range(10_000), docs):
        words = edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3]))
        if rng.random() < 0.6:
            words = words + passage
        if rng.random() < 0.1:
            chain = edited(rng, chain, 2)
            words = chain
        text = rng.choice([" ", "\n", " \x0b"]).join(words)
        texts[i] = rng.choice([text, text.upper(), text, None if rng.random() < 0.1 else text, "É x" if rng.random() < 0.1 else text])
    texts[20_000], texts[20_001] = "", " \n"
    return texts


@pytest.mark.parametrize("seed,part,hot", [(1, 1024, 2048), (2, 7, 5)])
def test_components_against_brute_force(spark, monkeypatch, seed, part, hot):
    """Also with blocks dealt into parts of a few documents and shingles split over salts."""
    monkeypatch.setattr(jj, "PART_DOCS", part)
    monkeypatch.setattr(jj, "HOT", hot)
    texts = corpus(seed)
    rows = [(i, t, "x", 5) for i, t in texts.items()] + [(i, t, "again", 0) for i, t in list(texts.items())[:20]]
    rows += [(None, next(t for t in texts.values() if t and len(t) > 99), None, None), (None, "quite alone here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, n long")
    got = jj.jaccard_components(df).collect()
    want = brute(texts)
    assert len(got) == len(rows)
    assert {(r.doc_id, (r.n_shingles, r.component_id)) for r in got if r.doc_id is not None} == set(want.items())
    assert len({c for _, c in want.values()}) < len(want) - 50
    nulls = [r.component_id for r in got if r.doc_id is None]
    assert None in nulls and any(x is not None for x in nulls)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(df).collect() == []


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    base = [rng.choice(2**40, n, replace=False).astype(np.uint64) for n in (1, 2, 9, 50, 300, 5000)]
    sets = []
    for _ in range(150):
        x = base[rng.integers(len(base))].copy()
        hit = rng.random(len(x)) < rng.choice([0, 0.02, 0.1, 0.2])
        x[hit] = rng.choice(2**40, hit.sum()).astype(np.uint64)
        sets.append(np.unique(x))

    def groups(links):
        root = list(range(len(sets)))
        for a, b in links:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return sorted(tuple(i for i in range(len(sets)) if root[i] == r) for r in set(root))

    every = groups([(a, b) for a in range(len(sets)) for b in range(a) if jj.linked(sets[a], sets[b])])
    assert 6 < len(every) < 150
    assert groups(jj.tree_links(sets, None, list(range(len(sets))))) == every
    root = list(range(len(sets)))
    half = jj.tree_links(sets[:70], sets[70:], root)
    whole = half + jj.tree_links(sets[:70], None, list(range(70))) + [(a + 70, b + 70) for a, b in jj.tree_links(sets[70:], None, list(range(80)))]
    assert groups(whole) == every


def test_pruning_never_drops_a_link_and_drops_most_other_pairs():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.choice(2**50, 200).astype(np.uint64)) for _ in range(64)]
    tree = jj.Tree(sets, 2048)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(64), np.arange(64)))
    keep = jj.possible(tree.levels[0], i, tree.levels[0], j)
    assert keep[i == j].all() and not keep[i != j].any()


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1001), (1001, 1002), (1000, 1002), (5000, 1002)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in jj.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(401)} | {k: 1000 for k in (1000, 1001, 1002, 5000)}


def test_components_of_long_chains_over_many_partitions(spark):
    """Sorted and shuffled chains, stars and a ring, in more partitions than edges share."""
    rng = random.Random(9)
    names = rng.sample(range(-(10**6), 10**6), 900)
    chain = sorted(names[:300])
    edges = list(zip(chain, chain[1:])) + list(zip(names[300:600], names[301:600])) + [(names[600], x) for x in names[601:800]]
    edges += list(zip(names[800:], [*names[801:], names[800]]))
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        found = {r.node: r.component for r in jj.components(spark.createDataFrame(edges, "a long, b long").repartition(40)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for part in (chain, names[300:600], names[600:800], names[800:]):
        assert {found[x] for x in part} == {min(part)}


def test_large_blocks_in_parts(spark, monkeypatch):
    """Blocks of near copies and of texts that only share passages, in parts of a few documents."""
    monkeypatch.setattr(jj, "PART_DOCS", 6)
    rng = random.Random(21)
    base, other = ([f"{c}{k}" for k in range(150)] for c in "xy")
    texts = {i: " ".join(edited(rng, base, rng.randrange(6))) for i in range(70)}
    texts |= {100 + i: " ".join(edited(rng, other, rng.choice([1, 14, 15, 30]))) for i in range(70)}
    texts |= {200 + i: " ".join(base[i : i + 40] + other[i : i + 45]) for i in range(0, 90, 2)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_rows_without_an_id_tie_others_together(spark):
    words = [f"w{k}" for k in range(60)]
    change = lambda at: [*words[:at], "new", *words[at + 1 :]]
    left, middle, right = change(3), words, change(40)
    rows = [(7, " ".join(left)), (None, " ".join(middle)), (None, " ".join(middle)), (3, " ".join(right)), (9, "far away from these"), (None, "also alone but of enough words")]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (7, 3), (9, 9)]
    assert sorted((str(r.component_id) for r in got if r.doc_id is None)) == ["3", "3", "None"]


def test_tables_with_columns_of_the_same_names(spark):
    rows = [(1, "a b c d e f g", 5, "x"), (2, "a b c d e f g", 6, "y"), (2, "a b c d e f g", 7, "z"), (None, "q", 8, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own long, _key string")
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r._own) for r in kept.collect()) == [(0, 8), (1, 5)]


@pytest.mark.parametrize("size,kind", [(1 << 18, pa.string()), (50, pa.large_string())])
def test_sets_of_many_texts_at_once(monkeypatch, size, kind):
    """Also in slices of a column, of few bytes at a time, with long words, and texts without words between others."""
    monkeypatch.setattr(jj, "BYTES", size)
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "É", "é", "x\x1cy", "\u00a0", "q" * 70 + "r", "q" * 70 + "s", "r" + "q" * 70, "q" * 200, "q" * 199]
    texts = ["", " \n", "one", "ONE", "one two three four", "one two three four five"] + [rng.choice([" ", "\t", "\x0b \r"]).join(rng.choices(words, k=rng.randrange(30))) for _ in range(300)]
    texts += [x.upper() if x.isascii() else x for x in texts] + ["", " "]
    got = list(jj.shingle_sets(pa.array(["cut", "off", *texts, "end"], kind).slice(2, len(texts))))
    want = []
    for text in texts:
        w = text.encode().lower().split()
        want.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all((x[1:] > x[:-1]).all() for x in got)
    # One hash for each shingle: every pair of texts has as many in common as their words say.
    for k in range(0, len(texts), 7):
        assert [len(np.intersect1d(got[k], x)) for x in got] == [len(want[k] & x) for x in want]
    assert len(set(np.concatenate(got).tolist())) == len(set().union(*want))
    assert list(jj.shingle_sets(pa.array([], kind))) == [] and [len(x) for x in jj.shingle_sets(pa.array(["", ""], kind))] == [0, 0]


def test_sets_take_less_time_than_a_look_at_each_word():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1000)]
    column = pa.array(texts)

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    def by_word():
        known = {}
        for text in texts:
            for w in text.encode().lower().split():
                if w not in known:
                    known[w] = jj.xxhash.xxh3_64_intdigest(w)

    assert min(seconds(lambda: list(jj.shingle_sets(column))) for _ in range(3)) < min(seconds(by_word) for _ in range(3))


def test_blocks_are_cut_without_a_row_for_each_shingle(spark, monkeypatch):
    """Blocks by the order of their own counts, in small buckets, as brute force has them; no plan explodes or joins shingles."""
    monkeypatch.setattr(jj, "BUCKET_SHINGLES", 40)
    rng = random.Random(31)
    whole = [rng.randrange(-(2**63), 2**63) for _ in range(900)]
    rows = []
    for node in range(160):
        low = rng.randrange(0, 800, 60)
        rows.append((node, node % 3, sorted(rng.sample(whole[low : low + 100], rng.randrange(1, 60)), key=lambda x: x % 2**64)))
    want = {}
    for block in range(3):
        sets = {node: values for node, b, values in rows if b == block}
        often = {}
        for values in sets.values():
            for x in values:
                often[x] = often.get(x, 0) + 1
        held = {}
        for node, values in sets.items():
            prefix = sorted(values, key=lambda x: (often[x], x))[: len(values) - -(-80 * len(values) // 100) + 1]
            for x in prefix:
                held.setdefault(x, []).append(node)
        root = {node: node for node in sets}
        for nodes in held.values():
            for a in nodes[1:]:
                old, new = sorted((root[a], root[nodes[0]]), reverse=True)
                root = {k: new if r == old else r for k, r in root.items()}
        want |= {k: r for k, r in root.items() if sum(x == r for x in root.values()) > 1}
    plans, joined = [], jj.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return joined(edges)

    monkeypatch.setattr(jj, "components", seen)
    df = spark.createDataFrame([(node, len(values), block, values) for node, block, values in rows], "node long, n long, block long, values array<long>")
    large = jj.cut(jj.sized(df).repartition(5))
    got = {r.node: r.block for r in jj.sharper(large).collect()}
    assert got == want and len(set(want.values())) > 3
    assert plans and not any("Generate" in x or "Join" in x for x in plans)


def test_few_edges_take_few_jobs_and_many_take_rounds(spark, monkeypatch):
    rng = random.Random(17)
    names = rng.sample(range(-(10**6), 10**6), 500)
    edges = list(zip(names[:300], names[1:300])) + [(names[300], x) for x in names[301:]]
    want = {x: min(names[:300]) for x in names[:300]} | {x: min(names[300:]) for x in names[300:]}
    df = jj.cut(spark.createDataFrame(edges, "a long, b long").repartition(20))
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for most in (500_000, 0):
        monkeypatch.setattr(jj, "FEW_EDGES", most)
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        try:
            found = jj.components(df)
            jobs[most] = len(tracker.getJobIdsForGroup(f"components-{most}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r.node: r.component for r in found.collect()} == want
    assert jobs[500_000] <= 4 < jobs[0]
