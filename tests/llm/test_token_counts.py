import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from terrace.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    """The library's Unigram model over the same pieces; it is the judge of every tie."""
    vocabulary = [("<unk>", 0.0), *pieces]
    if byte_fallback:
        vocabulary += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def whole():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    # The library takes the least score over its whole list, so byte pieces stand at the end with a score of 0.
    return library([(model.id_to_piece(i), model.get_score(i)) for i in ids], True)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b", "▁a ▁", "tab\tnew\nline", "naïve Ñandú 漢字 \U0001f600 end", "x" * 3000, "word " * 3000])
def test_against_the_library(whole, text):
    assert tc.counter(PATH).count(text) == whole(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdthe ▁\néü漢\U0001f600.", max_size=40))
def test_random_texts_against_the_library(whole, text):
    assert tc.counter(PATH).count(text) == whole(text)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab▁", min_size=1, max_size=3), st.integers(-5, 0), min_size=1, max_size=8), st.booleans(), st.text(alphabet="abc é", max_size=12))
def test_ties_of_small_vocabularies_against_the_library(vocabulary, byte_fallback, text):
    pieces = [(p, float(s)) for p, s in vocabulary.items() if "▁" not in p[1:]]
    if pieces:
        low = min(0.0, *(s for _, s in pieces))
        counter = tc.Counter(pieces, byte_fallback)
        counter.unknown = low - tc.UNKNOWN_PENALTY
        assert counter.count(text) == library(pieces, byte_fallback)(text)


def test_table(spark):
    rows = [(1, "the cat", "x"), (2, None, None), (3, "", None), (None, "the cat", None), (1, "the cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    got = {(r.doc_id, r.n_tokens, r.n_chars) for r in tc.token_counts(df, PATH).collect()}
    n = tc.counter(PATH).count("the cat")
    assert got == {(1, n, 7), (2, 0, 0), (3, 0, 0), (None, n, 7)}
    assert tc.token_counts(df, PATH).count() == 5 and tc.token_counts(df.filter("doc_id > 5"), PATH).collect() == []
