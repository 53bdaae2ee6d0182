import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.tokens import Encoder, Vocabulary, encode_corpus

PATH = os.path.join(os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdetns  '\n\t0123456789.,-ABCéß漢字😀", max_size=120)))
def test_same_as_reference_and_round_trip(encoder, reference, s):
    s = s.encode("utf-8", "ignore").decode()
    ids = encoder.encode(s)
    assert ids == reference(s)
    assert encoder.decode(ids) == s


@pytest.mark.parametrize("s", ["", " ", "\n\n", "<|endoftext|>", "a" * 5000, "ab" * 3000, "　 x", "don't we'LL", "​­", " " * 300 + "x"])
def test_odd_texts(encoder, reference, s):
    assert encoder.encode(s) == reference(s)


def test_corpus(spark, reference):
    rows = [(1, "Hello  world\r\n", "x"), (2, None, "x"), (3, "", "x"), (4, "   ", "x"), (None, "Hello", "x"), (5, "Hello  world\r\n", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, PATH).collect()}
    assert got == {k: reference(t) if t else [] for k, t, _ in rows}
    assert encode_corpus(df.limit(0), PATH).count() == 0


def test_linear_on_one_long_piece(encoder):
    assert len(encoder.encode("x" * 300_000)) > 0
