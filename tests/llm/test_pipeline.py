import glob
import random
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import Row as spark_row
from tokenizers import Tokenizer

import corpus_pipeline
from terrace.llm.mixing import mix_plan
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_quality import text_of
from tests.llm import test_decontamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, seed=4):
    rng = random.Random(seed)
    docs, labels, items = [], [], []
    for i in range(20):
        items.append((i, " ".join(f"q{rng.randrange(500)}x" for _ in range(rng.randrange(15, 40)))))
    for d in range(400):
        good = rng.random() < 0.75
        text = text_of(rng, good)
        if good and rng.random() < 0.15:
            text += " " + rng.choice(items)[1]
        docs.append((d, text, "en", f"s{rng.randrange(4)}"))
        labels.append((d, int(good), 0))
    docs += [(1000 + k, d[1], "en", "s1") for k, d in enumerate(docs[:60])]
    docs += [(2000, None, None, None), (2001, "", "en", "s1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = tables(spark, tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        folder = f"{tmp_path}/{len(kept)}"
        stage(spark, frame, str(tmp_path)).write.parquet(folder)
        frame = spark.read.parquet(folder)
        kept.append(frame.collect())
        assert frame.columns == columns or stage is corpus_pipeline.STAGES[-1][1], name
    good, single, clean, mixed, tokens = kept

    truth = {i: q for i, q, _ in labels}
    ids = {r.doc_id for r in good}
    assert sum(truth[i] == (i in ids) for i in truth) / len(truth) > 0.97
    assert sum(i in ids for i in truth if truth[i]) / sum(truth.values()) > 0.98

    component = components({r.doc_id: r.text for r in good})
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in component.items() if i == c)
    leaked = test_decontamination.brute([(r.doc_id, r.text) for r in single], items, 6)
    assert leaked
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if r.doc_id not in leaked)

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert abs(sum(size[r.doc_id] for r in mixed) - sum(size.values())) < 0.05 * sum(size.values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    # The shards are in the order of the mix, which stands in the files.
    files = sorted(glob.glob(f"{tmp_path}/3/part-*.parquet"))
    written = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert sorted(r["doc_id"] for r in written) == sorted(r.doc_id for r in mixed)
    positions = {r.doc_id: r.position for r in mix_plan(spark.read.parquet(f"{tmp_path}/2")).collect()}
    firsts = list(dict.fromkeys(r["doc_id"] for r in written))
    assert firsts == sorted(firsts, key=positions.get)
    for r in (spark_row(**r) for r in written):
        found = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, corpus_pipeline.END_ID]
        expected.append((r.doc_id, start, len(found), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in found))))
        start += len(found)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens), key=lambda r: r[1]) == expected


def test_run_returns_the_last_stage(spark, tmp_path):
    tables(spark, tmp_path, seed=6)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "start"]
