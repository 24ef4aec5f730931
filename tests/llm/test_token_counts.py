"""Spliced chunks against whole encodings by the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import token_counts

from .conftest import frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return token_counts.counter(PATH).tokenizer


def whole(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_whole_table(docs, path):
    tok = token_counts.counter(public_tokenizers.path(path)).tokenizer
    for r in docs.collect():
        assert token_counts.spliced_ids(tok, r.text, 400, 60, 16) == whole(tok, r.text)


ODD = [
    "x" * 3000, "word" * 500 + " " + "é" * 900, "a <|endoftext|> b " * 80, "<|endoftext|>" * 60, "é" * 700, "1234567890" * 100,
    "'s't're" * 150, "!?.,;" * 200, " \n\t" * 400, "Σας ΟΔΟΣ İI " * 100, "́ ́" * 200, "梦벨🔴 " * 150, "<|startoftext|" * 70, "",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(tok, text):
    for chunk, overlap in ((300, 80), (257, 40), (1000, 150)):
        assert token_counts.spliced_ids(tok, text, chunk, overlap, 16) == whole(tok, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "'s", "<|endoftext|>", "é", "é", "12", "!!", "\n", "Σ", "abcdefgh", "<|"]), max_size=300))
def test_random_texts(tok, parts):
    text = "".join(parts)
    assert token_counts.spliced_ids(tok, text, 120, 50, 16) == whole(tok, text)


def test_words_between_spaces(docs, tok):
    texts = [r.text for r in docs.collect()] + ODD + ["a\x1c!\x1f! \u0301 b\u00a0c", " e \u0301", "!\n!  !\r\n!"]
    assert token_counts.Counter(PATH).counts(texts, 10**6) == [len(whole(tok, t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_words(tok, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert token_counts.counter(PATH).counts(texts) == [len(whole(tok, t)) for t in texts]


def test_columns(spark, tok, clash):
    texts = [None, "", "two words", "two words", "a long text " * 4000]
    rows = token_counts.count_tokens(clash(frame(spark, texts, [0, 1, 2, 2, None])), PATH).collect()
    want = [(0, 0), (0, 0), (9, 2), (9, 2), (48000, len(whole(tok, texts[4])))]
    assert [(r.n_bytes, r.n_tokens) for r in rows] == want
    assert [r.over_limit for r in rows] == [False] * 4 + [True]
    assert token_counts.count_tokens(frame(spark, []), PATH).collect() == []
