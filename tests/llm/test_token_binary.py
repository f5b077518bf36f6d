import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrace.llm import token_binary as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab é'×\n\t\x1c\u2003  .!1<|endoftext|>", max_size=40), max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    ids, counts = tb.encoder(PATH).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)] == [WHOLE.encode(x, add_special_tokens=False).ids for x in texts]


def test_forgotten_parts_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tb, "WORDS", 5)
    encoder = tb.Encoder(PATH)
    for k in range(30):
        text = " ".join(f"word{(k * 7 + i) % 40}." for i in range(6))
        assert encoder.encode(pa.array([text]))[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) + len(encoder.older) < 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_blocks_round_trip(values):
    ids = np.array(values, "<u4")
    blocks = tb.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert tb.decode_blocks(b"".join(blocks), starts).tolist() == values


def test_outliers_are_exceptions():
    ids = np.full(512, 7, "<u4")
    ids[3] = 4_000_000_000
    (block,) = tb.encode_blocks(ids)
    assert len(block) == tb.HEAD.size + 6


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(tb, "FLUSH", 2 * tb.BLOCK)
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [(None if i == 4 else i, rng.integers(0, 50000, n).astype("<u4")) for i, n in enumerate([0, 1, 5000, 3, 1, 0, 700])]
    writer = tb.ShardWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    file = io.BytesIO(out.getvalue())
    file.size = lambda: len(out.getvalue())
    assert [(i, x.tolist()) for i, x in tb.read_documents(file)] == [(i, x.tolist()) for i, x in docs]


def test_files_of_the_table_against_plain_encoding(spark, tmp_path):
    long = "word " * 50_000
    rows = [(3, "b a", 1), (1, None, 2), (2, "", 3), (None, "x  y\n", 4), (3, "b a", 5), (9, long, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tb.token_binary(docs, PATH, 2, f"file://{tmp_path}").collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tb.token_binary(docs.filter("doc_id < 0"), PATH, 2).collect() == []


def test_a_file_with_other_rules_is_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Some  Words, and signs!", "", "it's\nMORE", "naïve\ttext 12"]
    encoder = tb.Encoder(path)
    ids, counts = encoder.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.parts and counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert tb.Encoder(public_tokenizers.path("byte_bpe_50k.json")).parts


def test_pieces_asked_for_before_are_not_cut_again(monkeypatch):
    encoder, cut, parts = tb.Encoder(PATH, 50), [], tb.Encoder._parts
    monkeypatch.setattr(tb.Encoder, "_parts", staticmethod(lambda x: cut.append(x) or parts(x)))
    text = "Some words, <|endoftext|> and\nlines (of) text " + "x" * 200
    for k in range(3):
        assert encoder.encode(pa.array([text]))[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids
        assert cut.count("words,") == 1 and cut.count("x" * 200) == k + 1  # long ones aren't kept
    for k in range(0, 400, 10):
        text = " ".join(f"{i}!" for i in range(k, k + 10))
        assert encoder.encode(pa.array([text]))[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids
        assert len(encoder.sizes) == len(encoder.pieces) <= 50
