import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrace.llm import mixing


def waterfill(sizes, weights, cap=3.0):
    """Reshares the excess of sources over their caps until none is above."""
    total, done = float(sum(sizes.values())), {}
    while True:
        left = total - sum(done.values())
        open_ = [s for s in sizes if s not in done]
        weight = sum(weights[s] for s in open_)
        new = {s: left * weights[s] / weight for s in open_}
        over = {s: cap * sizes[s] for s in open_ if new[s] > cap * sizes[s]}
        if not over:
            return done | new
        done |= over


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, position int")


def test_targets_and_taken_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 50)), [f"s{i % 7}", "big", "big", None, "é", "z"][i % 6 if i % 50 else 0], "clash", 1) for i in range(3000)]
    rows += [(None, None, "only null", None, None), (5000, "a\x0bb\x1cc", "tiny", None, None), (5000, "a\x0bb\x1cc", "tiny", None, None)]
    got = mixing.mix_plan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, source_of = defaultdict(int), {}
    for i, text, source, *_ in rows:
        source_of[i] = source
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = waterfill(sizes, {s: k % 3 + 1 for k, s in enumerate(ranked)})
    taken = defaultdict(int)
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 50
    position = [r.position for r in got]
    cut = position.index(None)
    assert position[:cut] == sorted(position[:cut]) and not any(x is not None for x in position[cut:])
    assert got == mixing.mix_plan(documents(spark, rows[::-1])).collect()


def test_demand_follows_the_schedule(spark):
    """Over any stretch of training time a source's share of the words follows its integrated weights."""
    rows = [(i, "w " * 5, f"s{i % 2}", None, None) for i in range(4000)]
    got = mixing.planned(documents(spark, rows), F.lit(5), F.col("source"), [F.col("doc_id")])
    early = got.select("_source", F.explode("_positions").alias("p")).filter("p < 0.25").groupBy("_source").count().collect()
    counts = {r["_source"]: r["count"] for r in early}
    # s0 has weight 1 rising from 0.5, s1 weight 2 falling from 3; the total is 4000 documents.
    area = lambda w0, w1, t: w0 * t + (w1 - w0) * t * t / 2
    for source, (w0, w1) in {"s0": (0.5, 1.5), "s1": (3.0, 1.0)}.items():
        assert counts[source] == pytest.approx(4000 / 3 * area(w0, w1, 0.25), rel=0.02)


def test_mixed_documents_keep_columns_and_order(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}", "x", i) for i in range(500)] + [(7, "repeat me", "s1", "x", 7)] * 3
    docs = documents(spark, rows)
    mixed, plan = mixing.mixed_documents(docs), mixing.mix_plan(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(docs.filter("doc_id < 0")).collect() == mixing.mix_plan(docs.filter("doc_id < 0")).collect() == []
