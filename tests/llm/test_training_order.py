"""Slots are a permutation; shards hold every sequence at its slot."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import packing, training_order
from tabloom.llm.common import Scratch
from tabloom.session import scratch_path

from .conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**70))
def test_slots_are_a_permutation(total, key):
    got = training_order.slots(np.arange(total), total, key)
    assert sorted(got.tolist()) == list(range(total))
    assert training_order.slots(np.array([total - 1]), total, key)[0] == got[-1]


def slow_slot(i, total, key):
    half = max((max(total - 1, 1).bit_length() + 1) // 2, 1)
    m = (1 << 64) - 1

    def mixed(x, salt):
        x = x + salt & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    while True:
        left, right = i >> half, i & (1 << half) - 1
        for r in range(training_order.FEISTEL_ROUNDS):
            salt = (key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & m
            left, right = right, left ^ (mixed(right, salt) & (1 << half) - 1)
        i = left << half | right
        if i < total:
            return i


def test_slots_by_plain_integers():
    for total in (1, 2, 3, 17, 1000, 4097):
        assert training_order.slots(np.arange(total), total, 5).tolist() == [slow_slot(i, total, 5) for i in range(total)]
    far = training_order.slots(np.arange(0, 10**12, 10**9), 10**12, 5)
    assert far.tolist() == [slow_slot(i, 10**12, 5) for i in range(0, 10**12, 10**9)]
    one, two = (training_order.slots(np.arange(1000), 1000, k) for k in (1, 2))
    assert (one != two).mean() > 0.9 and abs(np.corrcoef(one, np.arange(1000))[0, 1]) < 0.1


def brute(rows, length, total_key):
    """Sequences of rows in order, as one task writes them."""
    ids, spans = [], []
    for d, text in rows:
        own = packing.encode_ids(PATH, text or "").tolist() + [0]
        spans.append((d, len(ids), len(ids) + len(own)))
        ids += own
    out = []
    n = -(-len(ids) // length)
    for k in range(n):
        piece = ids[k * length : (k + 1) * length]
        docs = [(d, a) for d, a, b in spans if a < k * length + len(piece) and b > k * length]
        full = np.array(piece + [0] * (length - len(piece)), "<u2").tobytes()
        out.append((slow_slot(k, n, total_key), len(piece), [d for d, _ in docs], k * length - docs[0][1], zlib.crc32(full)))
    return sorted(out)


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = training_order.training_order(docs, PATH, 256, 99, 50).collect()
    assert sorted((r.slot, r.n_tokens, r.doc_ids, r.start, r.ids_crc32) for r in got) == brute(rows, 256, 99)
    assert all((r.shard, r.byte_offset) == (r.slot // 50, r.slot % 50 * 512) for r in got)


def test_many_tasks_lose_nothing(spark, clash):
    texts = [None, "", "two words", "two words", "long text " * 3000] + [f"text {i} " * (i % 50) for i in range(300)]
    df = clash(frame(spark, texts, [0, 1, 2, 2, None, *range(5, 305)])).repartition(5)
    got = training_order.training_order(df, PATH, 64, 7, 16).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(packing.encode_ids(PATH, t or "")) + 1 for t in texts)
    assert {d for r in got for d in r.doc_ids} == {0, 1, 2, None, *range(5, 305)}
    assert training_order.training_order(frame(spark, []), PATH).collect() == []


def test_reading_resumes_at_any_slot(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scratch, folder, place = Scratch(spark), scratch_path(spark, "t"), scratch_path(spark, "s")
    training_order.sequences(docs, PATH, 128).write.parquet(place)
    manifest = training_order.write_shards(spark.read.parquet(place), folder, scratch, 128, 3, 40)
    whole = {r.slot: bytes(r.ids) for r in training_order.read_shards(manifest, folder, 128).collect()}
    for start in (0, 1, 39, 40, 77, len(whole) - 1, len(whole)):
        part = {r.slot: bytes(r.ids) for r in training_order.read_shards(manifest, folder, 128, start).collect()}
        assert part == {k: v for k, v in whole.items() if k >= start}
    for r in manifest.collect():
        data = b"".join(whole[s] for s in range(r.first_slot, r.first_slot + r.n_sequences))
        assert zlib.crc32(data) == r.crc32
