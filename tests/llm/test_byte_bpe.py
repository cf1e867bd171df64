import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from planiscope.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(library, texts):
    for text, ids in zip(texts, byte_bpe.codec(PATH).encode_many(texts), strict=True):
        assert library.encode_ordinary(text) == np.frombuffer(ids, "<u4").tolist(), text
        assert byte_bpe.codec(PATH).decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_contractions_spaces_and_classes_against_the_library(library):
    rnd = random.Random(3)
    alphabet = "ab'sstmdlvre  \n\t.,!12é 中'\"''　  ll²_x́😀\x1c "
    for _ in range(60):
        same(library, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(30)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_against_the_library(texts):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    same(tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), texts)


def test_long_pieces(library):
    same(library, ["a" * 3000, "na" * 500 + " " * 700 + "x", "", "'" * 99 + "s" * 200])


def test_scan_of_many_blocks_equals_one_by_one():
    text = "it's we'll 'x  y\n\n z'" * 500
    cut = byte_bpe.boundaries(text, np.array([0]))
    parts = [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)], strict=True)]
    import regex

    assert parts == regex.findall(public_tokenizers.PATTERN, text)


def test_rows_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, "it's  a test", "z"), (1, "it's  a test", "z"), (None, None, None), (3, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = byte_bpe.round_trip(docs, PATH).collect()
    assert len(out) == 4
    for r in out:
        text = "it's  a test" if r.doc_id == 1 else ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_tokens == 0) == (text == "")
    ids = byte_bpe.encode(docs, PATH)
    back = byte_bpe.decode(ids, PATH)
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"it's  a test", b"it's  a test"]
    assert byte_bpe.round_trip(docs.filter("false"), PATH).collect() == []
