"""Ids against the tokenizers library; plans against exhaustive search; places are gapless and whole."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import packing

from .conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", " ", "a <|endoftext|> b<|endoftext|>", "é😀\x00\n\n  x", "x" * 5000, "   \n" * 300, "１２3 ½ ²", "<|endof", "don't we'll"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert packing.encode_ids(PATH, t).tolist() == e.ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encode_ids(PATH, text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 3), max_size=5), st.integers(0, 25))
def test_fullest_combination(counts, room):
    used = packing.fullest(counts, room)
    assert all(0 < k <= counts[n] for n, k in used.items())
    sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])}
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = {rng.randint(1, 2048): rng.randint(1, 5000) for _ in range(900)} | {2048: 100000}
    plan = packing.packing_plan(counts)
    used = Counter()
    for times, combination in plan:
        assert sum(n * k for n, k in combination.items()) <= 2048
        for n, k in combination.items():
            used[n] += times * k
    assert used == Counter(counts)
    # No packing needs less than the sum of lengths, or than the pieces of more than half a sequence.
    least = max(sum(n * c for n, c in counts.items()) / 2048, sum(c for n, c in counts.items() if n > 1024))
    assert sum(t for t, _ in plan) <= 1.02 * least + 1


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    n = gapless(rows, 2048)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 3
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    for d in docs.collect():
        ids = np.array(library.encode(d.text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(parts[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.length == 2048 or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_rows(spark, clash):
    df = clash(frame(spark, [None, "", "same text", "same text", "long " * 9000], [1, 1, 2, 2, None]))
    rows = packing.pack_documents(df, PATH, 64).collect()
    gapless(rows, 64)
    assert Counter(r.doc_id for r in rows if r.doc_id) == {1: 2, 2: 2}
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


def test_common_length_is_spread(spark):
    pieces = spark.range(60000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 700, 1 + id % 97) AS length")
    rows = packing.pack(pieces).collect()
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows}) == 60000
    gapless(rows, 2048)
