from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrace.llm import exact_dedup as ed


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(i, ["Hot", "hOT", None, "", f"own {i}", "É", "é", "É!", "x" * 50_000][i % 9 if i % 4 else 0], "clash", i) for i in range(2000)]
ROWS += [(5, "Hot", None, None), (None, "HOT", None, None), (None, "no id", None, None)]


def brute():
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(lower(text), []).append(i)
    return Counter((i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)])) for i, t, *_ in ROWS)


@pytest.mark.parametrize("digest", [ed.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))])
@pytest.mark.parametrize("hot_share", [1000, 3, 1])
def test_against_brute_force(spark, digest, hot_share):
    """Also under a digest with two values, where full contents must tell texts apart, and with or without salted digests."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _text string, kept long")
    got = ed.exact_groups(docs, digest=digest, hot_share=hot_share, salts=5).collect()
    assert Counter((r["_id"], r["_keep"], r["_size"]) for r in got) == brute()


def test_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _text string, kept long")
    rows = ed.exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows}) - 1  # "no id" has nothing that stays
    assert ed.exact_dedup(docs.filter("doc_id < 0")).collect() == []
