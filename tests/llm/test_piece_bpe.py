"""Merge rounds against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import piece_bpe

from .conftest import frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "   a", "a    b  c   ", " " * 40 + "x", "\n\n\t\x00", "▁", "a▁b ▁▁ c", "<s> </s> <unk> <0x0A>",
    "naïve ﬁ ｄ 梦 벨 🔴 🧿 �", "aaaaaaaaaaaaaaaaaaaa bbbbbbb abababababab", "=" * 70, "é " * 9, "x" * 5000, " " * 5000 + "y" * 9,
    "internationalization" * 300, "1234567890" * 7,
]


@pytest.fixture(scope="module")
def enc():
    return piece_bpe.Encoder(PATH)


def library(enc, texts):
    return [ids + [enc.model.end] for ids in enc.model.processor.encode(texts, num_threads=1)]


def test_odd_texts(enc):
    assert enc.encode(ODD) == library(enc, ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁\nabeinorst<>0x1éß梦🔴=-"), max_size=60), max_size=5))
def test_random_texts(enc, texts):
    assert enc.encode(texts) == library(enc, texts)


def test_whole_texts(enc, docs):
    texts = [r.text for r in docs.collect()]
    assert enc.encode(texts) == library(enc, texts)
    assert [enc.shown_ids(w) for w in enc.words(texts)] == [" ".join(map(str, ids)) for ids in library(enc, texts)]


def test_rounds_equal_queue(enc):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinst▁"), rng.integers(1, 60))) for _ in range(200)]
    m = enc.model
    assert m.encode_words(words) == [tuple(m._queue([m.id_of[c] for c in w])) for w in words]


def test_columns(spark, docs, clash):
    df = clash(frame(spark, ["two words", None, "", "two words"], [4, 5, None, 4]))
    rows = piece_bpe.decode_documents(piece_bpe.encode_documents(df, PATH), PATH).collect()
    assert [(r.doc_id, r.decoded, len(r.ids)) for r in rows] == [(4, "two words", 3), (5, "", 1), (None, "", 1), (4, "two words", 3)]
    got = piece_bpe.piece_digests(df, PATH).collect()
    assert got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].ids_sha256 == hashlib.sha256(" ".join(map(str, rows[0].ids)).encode()).hexdigest()
    assert piece_bpe.piece_digests(frame(spark, []), PATH).collect() == []
