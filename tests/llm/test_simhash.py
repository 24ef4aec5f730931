"""Fingerprints and components against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import simhash
from .conftest import frame


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    """{id: smallest id reachable}, from (id, fingerprint) pairs."""
    label = list(range(len(prints)))
    order = sorted(range(len(prints)), key=lambda i: prints[i][0])
    root = {}
    for i in order:
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            j = todo.pop()
            for k in label:
                if k not in root and (prints[j][1] ^ prints[k][1]).bit_count() <= bits:
                    root[k] = i
                    todo.append(k)
    return {prints[i][0]: prints[root[i]][0] for i in label}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table(docs):
    got = result(simhash.simhash_components(docs))
    rows = docs.collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    parts = brute_components(prints)
    assert got == {i: (f"{fp:016x}", parts[i]) for i, fp in prints}


def test_words_split_at_ascii_space_only():
    for text in ("a b c\x1cd e", "É a B", "one two", "x", " \t\x0b\x0c\r\n", "", "a a a a a a", "\x85   z"):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_links_within_two_bits_and_chains(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(6):  # chains of one to three flipped bits
            prints.add(fp)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                fp ^= 1 << b
    ball = rng.getrandbits(64)
    prints |= {ball ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint").repartition(4)
    from tabloom.llm.graph import connected_components

    links = simhash.fingerprint_links(df)
    parts = {r.id: r.component for r in connected_components(links, "fp_a", "fp_b").collect()}
    want = brute_components(list(zip(signed, prints)))
    assert {s: parts.get(s, s) for s in signed} == want


def test_odd_rows(spark, clash):
    texts = [None, "", " \n", "the same text here now", "the same text here now", "THE same Text here now", "lone words of another kind", "x" * 300000]
    got = result(simhash.simhash_components(clash(frame(spark, texts))))
    assert [got[i][1] for i in range(8)] == [0, 0, 0, 3, 3, 3, 6, 7]
    assert got[0][0] == "0" * 16
    twice = frame(spark, ["a b c", "a b c", None, "q"], [5, 5, 5, None])
    rows = simhash.simhash_components(twice).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in rows) == [(False, 5, 5)] * 3 + [(True, None, None)]
    assert simhash.simhash_components(frame(spark, [])).collect() == []


def test_keep_one(spark, clash):
    texts = ["a b c d", "a b c d", "other words stand here", None, ""]
    kept = simhash.keep_one(clash(frame(spark, texts)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == clash(frame(spark, [])).columns
    assert simhash.keep_one(frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [simhash.BROADCAST_ROWS, 0])
def test_keep_one_row_of_each_component(spark, monkeypatch, limit):
    """Shared and null ids, copies, and rows that differ in columns beside the text only."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    texts = ["a b c", "a b c", "wholly other words", "z", "z", "q", "q", "a b c", "Q"]
    ids = [7, 7, 7, None, 9, None, None, 3, None]
    df = frame(spark, texts, ids).withColumn("more", F.create_map(F.lit("k"), F.monotonically_increasing_id()))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.keep_one(df.repartition(3)).collect())
    assert [g for g in got if g[0] >= 0] == [(3, "a b c"), (7, "wholly other words"), (9, "z")]
    assert [t.lower() for i, t in got if i < 0] == ["q"]


def test_keep_one_against_components(docs):
    parts = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(parts)


def test_many_copies_are_one_class(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one text of a very common kind', concat('text ', id)) AS text")
    got = result(simhash.simhash_components(df))
    assert {got[i][1] for i in range(0, 3000, 3)} == {0}
