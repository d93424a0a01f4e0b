import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinweave.llm import encode

if not os.path.exists(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.tiktoken"):
    pytest.skip("vocabulary files are not here", allow_module_level=True)


@pytest.fixture(scope="module")
def enc():
    return encode.encoder(encode.TOKENIZERS, encode.VOCABULARY)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


HARD = ["a" * 9000, " " * 3000 + "x", "<|endoftext|> hi", "\x00\ufeff", "日本語テキスト" * 9, "👩‍👩‍👧", "don't we'll I'M", "=-" * 400, "\r\n\t \r\n  x", "\u0301a" * 9, "\u2003x ½²"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(enc, public, text):
    assert enc.encode(text) == public(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = test_any_text.__dict__.setdefault("t", Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.json"))
    t.encode_special_tokens = True
    assert encode.encoder(encode.TOKENIZERS, encode.VOCABULARY).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_pre_tokens_against_merging(enc):
    rng = random.Random(0)
    for _ in range(1500):
        data = "".join(rng.choice("abetionrshé") for _ in range(rng.randrange(1, 50))).encode()
        assert enc.pre_token(data) == enc.merged(data)


def test_linear_time(enc):
    import time

    t = time.time()
    ids = enc.encode("x" + "ab" * 150_000)
    assert time.time() - t < 20 and b"".join(enc.bytes_of[i] for i in ids).decode() == "x" + "ab" * 150_000


def test_table(spark, enc):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (None, "x", None), (1, "Hello world", "a")], "doc_id bigint, text string, ids string")
    got = encode.encode_texts(df, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == [(0, enc.encode("x")), (1, enc.encode("Hello world")), (1, enc.encode("Hello world")), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in encode.count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 2, 2]
    assert encode.encode_texts(df.limit(0), ["doc_id"]).count() == 0
