import random

import pytest
import regex

from terrace.llm import license_scan as ls


def scan(text, notices=ls.NOTICES):
    scanner = ls.scanner(notices, ls.BASE, ls.CHARS_PER_EDIT)
    return scanner.spans(b" ".join(ls.words_of(text)).decode())


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def plain_base(text):
    words = plain_words(text)
    places = []
    for phrase, label in ls.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def edited(text, k, rng):
    for _ in range(k):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("xyzé") + text[at:], text[:at] + rng.choice("xyzé") + text[at + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(6))
def test_notices_against_the_whole_text(seed):
    """A notice is found where the library finds it in the whole text, without seeds and windows."""
    rng = random.Random(seed)
    known = [n for n in (ls.Notice.of(*x) for x in ls.NOTICES)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(known)
            parts += [" ".join(rng.choice(["the", "license", "under", "version", "2", "25", "public", "permission"]) for _ in range(rng.randint(0, 6))), edited(notice.name, rng.randint(0, notice.edits + 1), rng)]
        text = " ".join(" ".join(parts).split())
        found = scan(text)
        line = b" ".join(ls.words_of(text)).decode()
        for notice in known:
            best = notice.pattern.search(line)
            there = best is not None and sum(best.fuzzy_counts) <= notice.edits
            mine = [s for s in found if s.notice == notice.name]
            assert bool(mine) == there, (notice.name, text)
            if there:
                assert min(s.edits for s in mine) == sum(best.fuzzy_counts)
            for s in mine:
                assert sum(notice.pattern.fullmatch(line[s.start : s.end]).fuzzy_counts) <= notice.edits


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under teh MIT License.", {"mit"}),
        ("released under the bit license", set()),
        ("Licensed under the Apache Licence, Version 2.0", {"apache-2"}),
        ("Licensed under the Apache License, Version 1.1", set()),
        ("the GNU Genral Public Licence, version 3", {"gpl-3"}),
        ("GNU General Public License version 25", set()),
        ("undr the mit lisense and unther the bsd license", {"mit", "bsd"}),
        ("nothing of the kind", set()),
    ],
)
def test_examples(text, labels):
    assert {s.label for s in scan(text)} == labels


def test_pieces_cover_a_notice():
    for text, label in ls.NOTICES:
        notice = ls.Notice.of(text, label)
        assert "".join(x for x, _ in notice.seeds()) == notice.name and len(notice.seeds()) == notice.edits + 1
        assert notice.pattern.fullmatch(notice.name).fuzzy_counts == (0, 0, 0)


def test_many_notices_in_one_text():
    text = "under the mit license " * 500 + "undr the mit license " * 500
    assert len(scan(text)) == 1000


def test_table(spark):
    texts = ["Under the MIT License", "x under the mit license cc-by-nc under the mit license", "cc by nc by nc", None, "", "...", "Apache License, Version 2.0", "é" * 50_000, "UNDER the mit license", "undr the mit license", "cc_by\nnc", "all rights reserved", "K under the Kelvin"]
    docs = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "cc by nc", "s"), (1, texts[1], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, labels string")
    got = ls.license_scan(df).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in docs:
        n, places = plain_base(t)
        r = by_id[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places) and (r.score > 0) == bool(r.labels)
    assert by_id[9].labels == "mit" and by_id[9].base_labels == "" and 0.9 < by_id[9].score < 1
    assert [(s.notice, s.first_word, s.last_word, s.edits) for s in by_id[9].spans] == [("under the mit license", 0, 3, 1)]
    assert ls.license_scan(df.filter("doc_id > 100")).collect() == []


def test_registered_query(spark):
    from terrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_licenses"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        n, places = plain_base(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for _, x in places})))
