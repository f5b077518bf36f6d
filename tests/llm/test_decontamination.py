import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
QUESTION = "A farmer named Alice sells 12 baskets of pears for 3 euros each, then walks 5 km home to Bristol with Alice singing about the 12 baskets"


def run(spark, docs, items, **options):
    found = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()
    return {r.doc_id: (r.item_ids, r.n_windows) for r in found}


def test_verbatim_reparameterised_and_inconsistent(spark):
    other = QUESTION.replace("Alice", "Robert").replace("12", "1,450").replace("3 euros", "8.5 dollars").replace("5 km", "30 miles").replace("Bristol", "Leeds")
    broken = "so it was that " + QUESTION.replace("12", "7", 1).replace("Alice", "Zoe", 1)
    docs = [
        (1, f"It began so. {QUESTION}. The end."), (2, QUESTION.upper().replace(" ", "\n")), (3, f"Try this: {other}, he said."), (4, broken),
        (5, "Nothing of that kind is here, only pears and baskets sold for some euros by a farmer"), (6, None), (7, ""),
    ]
    found = run(spark, docs, [(10, QUESTION)])
    assert found.keys() == {1, 2, 3, 4}
    assert found[1][0] == found[2][0] == found[3][0] == [10]


def test_upper_case_text_without_names(spark):
    item = "the long road winds past seven quiet mills and over the old stone bridge into town"
    assert run(spark, [(1, item.upper()), (2, item.capitalize().replace(" ", ", ")), (3, item[::-1])], [(5, item)]).keys() == {1, 2}


def brute(docs, items, least):
    """For texts without names and numbers: windows of eight words in common."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = words(text)
        for i, question in items:
            q = words(question)
            n = min(8, len(q))
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            hits = sum(tuple(q[k : k + n]) in own for k in range(len(q) - n + 1)) if n else 0
            if hits and hits >= min(least, len(q) - n + 1):
                ids, total = out.get(d, ([], 0))
                out[d] = (sorted([*ids, i]), total + hits)
    return out


@pytest.mark.parametrize("seed,block", [(1, 10**6), (2, 40)])
def test_against_brute_force(spark, seed, block):
    """Also with the benchmark in blocks."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(["of", "the", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou")], k=n))
    items = [(i, say(rng.choice([3, 4, 6, 8, 9, 20, 40]))) for i in range(30)]
    items += [(40, items[0][1]), (41, items[5][1]), (42, None), (43, "")]
    docs = []
    for d in range(150):
        parts = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items[:30])[1].split() if rng.random() < 0.7 else []
            at = rng.randrange(4) * rng.randrange(2)
            parts += [" ".join(w[at:]), say(rng.randrange(10))]
        docs.append((d, " ".join(parts)))
    least = 6
    found = run(spark, docs, items, block=block, least=least)
    assert found == brute(docs, items, least)
    assert len(found) > 20


def test_two_variants_in_one_document_are_each_consistent(spark):
    a = "the machine makes 4 small wheels in 9 minutes and then 4 more wheels before it must rest"
    text = a.replace("4", "6").replace("9", "20") + ". Then " + a.replace("4", "5").replace("9", "11")
    assert run(spark, [(1, text), (2, a.replace("4", "6", 1))], [(3, a)]).keys() == {1, 2}


def test_a_window_of_many_items_brings_nothing_together(spark):
    """Items that begin alike, in documents that begin so too: only those are named whose own words are there."""
    head = "read the following short passage with care and then answer question below "
    own = lambda i: " ".join(f"{a}{i}x{b}" for a in "bcdfg" for b in "aeiou")
    items = [(i, head + own(i)) for i in range(40)]
    docs = [(d, head + (own(d) if d % 3 == 0 else f"about quite another matter {d}")) for d in range(60)]
    assert {k: v[0] for k, v in run(spark, docs, items).items()} == {d: [d] for d in range(0, 40, 3)}


def test_nulls_repeats_empties_and_clashes(spark):
    item = "one common sentence that no other text in this table would ever hold by chance"
    docs = [(1, item), (1, item), (None, item), (2, "x " * 20_000 + item), (3, " ".join(item.split()[:7]))]
    found = run(spark, docs, [(5, item), (None, item), (6, None)])
    assert found.keys() == {1, None, 2}
    assert found[2][0] == [5]
    assert run(spark, [], [(5, item)]) == {} == run(spark, docs, [])
    frame = spark.createDataFrame([(*d, 0, "y") for d in docs], DOCS + ", _hash int, item_ids string")
    bench = spark.createDataFrame([(5, item, 1)], ITEMS + ", _at int")
    assert dc.contaminated(frame, bench).count() == 3
    kept = dc.decontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert [r.doc_id for r in kept.collect()] == [3]
    assert dc.decontaminated(frame, bench.limit(0)).count() == 5


def test_templates_and_values_agree(spark):
    texts = ["Of 3 kg, Mr. Brown took 1,5 km/h; £5 and 12% of Åse's 7days 3D x2", "", " 7 ", "ANNA and Bob met Carl. Dora left", "\ue001 5\ue002x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dc.template(F.col("t")).alias("a"), F.transform(dc.valued(F.col("t")), dc.bare).alias("b"), dc.valued(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r.a == r.b
    assert rows[2].v == ["\ue0017", "\ue003"]


def test_items_without_a_template_window_are_found_verbatim(spark):
    items = [(1, "Compute 12 + 35 * 7 = ?"), (2, "3 kg, 4 kg, 5 kg, 6 kg and 7 kg"), (3, "quick zebras"), (4, "? ?")]
    docs = [(1, "Now compute 12 + 35 * 7 = ? at once"), (2, "Now compute 12 + 36 * 7 = ?"), (3, "it weighed 3 kg, 4 kg, 5 kg, 6 kg and 7 kg."), (4, "so Quick\nzebras ran"), (5, "quick brown zebras?")]
    assert run(spark, docs, items) == {1: ([1], 1), 3: ([2], 4), 4: ([3], 1)}


def test_one_edit_does_not_hide_a_copy(spark):
    a = "the machine makes 4 small wheels in 9 minutes and then 4 more wheels before it must rest"
    long = " ".join(f"on day number the machine made 4 {x} wheels and they were sold" for x in ("small", "large", "round", "heavy"))
    other = long.replace("4", "5").replace("5 round", "6 round")
    docs = [(1, a.replace("4", "6", 1)), (2, other), (3, "so it was that " + QUESTION.replace("12", "7", 1).replace("Alice", "Zoe", 1))]
    found = run(spark, docs, [(3, a), (4, long), (5, QUESTION)])
    assert {k: v[0] for k, v in found.items()} == {1: [3], 2: [4], 3: [5]}
    assert run(spark, [(1, "one 3 of the 4 or 5 of my 6 is")], [(2, "one 1 of the 1 or 1 of my 1 is")]) == {}


def test_copies_are_found_whatever_their_case_breaks_and_place(spark):
    river = "Which river flows through the old capital of the northern kingdom"
    dense = "Anna Bell met Carl Dahl near Old York while Emma Ford drove Gus Hart from Lake Irving to Port James with Kate Lund"
    docs = [(1, f"and he then asked {river} once"), (2, dense.lower()), (3, QUESTION.title()), (4, QUESTION.replace(" ", "\n")), (5, "he then asked which river it was")]
    found = run(spark, docs, [(1, river), (2, dense), (3, QUESTION)])
    assert {k: v[0] for k, v in found.items()} == {1: [1], 2: [2], 3: [3], 4: [3]}


def test_recall_of_reparameterised_items(spark):
    """Items with names, numbers and units; copies with all of these changed alike are found, others with the pattern of one sentence are not."""
    rng = random.Random(31)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "ld")]
    names, units = ["Alice", "Robert", "Ingrid", "Pavel", "Yusuf", "Maria", "Chen", "Tomas"], ["km", "kg", "hours", "euros", "litres"]

    def item():
        who, n = rng.sample(names, 2), [rng.randrange(2, 900) for _ in range(3)]
        words = []
        for k in range(rng.randrange(24, 45)):
            words.append(rng.choice(plain))
            if k % 9 == 4:
                words.append(rng.choice([who[0], who[1]]))
            elif k % 9 == 8:
                words += [str(rng.choice(n)), rng.choice(units)]
        return "The " + " ".join(words)

    def changed(text):
        """Each value by another, the same for the same."""
        new_names = dict(zip(names, rng.sample(["Oskar", "Lucia", "Henrik", "Amara", "Bruno", "Greta", "Felix", "Nadia"], 8), strict=True))
        new_units = dict(zip(units, rng.sample(["miles", "grams", "days", "dollars", "pounds"], 5), strict=True))
        numbers = {}
        fresh = iter(rng.sample(range(1000, 9999), 60))
        out = [numbers.setdefault(w, str(next(fresh))) if w.isdigit() else new_names.get(w, new_units.get(w, w)) for w in text.split()]
        return " ".join(out)

    items = [(i, item()) for i in range(60)]
    copies = [(i, f"{' '.join(rng.choices(plain, k=20))} now {changed(t)} so {' '.join(rng.choices(plain, k=20))}") for i, t in items]
    clean = [(1000 + i, item()) for i in range(60)]
    found = run(spark, copies + clean, items)
    assert sum(found.get(i, ([], 0))[0] == [i] for i, _ in items) / len(items) >= 0.9
    assert not [i for i, _ in clean if i in found]
