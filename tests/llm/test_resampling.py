"""Weights, scores and ranks against a slow version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import resampling
from tabloom.llm.common import word_lists
from .conftest import frame


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(rows, target):
    """{position: (n_features, weight, score, rank)} of (doc_id, text) rows."""
    s = Counter(bucket(f) for _, t in rows for f in brute_features(t)[1])
    t = Counter(bucket(f) for text in target for f in brute_features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out, fit = {}, []
    for i, (doc_id, text) in enumerate(rows):
        n, features = brute_features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, features)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(features), weight, score)
        if n >= 20:
            fit.append((-score, math.inf if doc_id is None else doc_id, len(features), i))
    rank = {i: r for r, (*_, i) in enumerate(sorted(fit)[: 25 * len(fit) // 100], 1)}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def expected(rows, target):
    return sorted(((rows[i][0], *v) for i, v in brute(rows, target).items()), key=str)


def test_whole_table(spark, docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resampling.resampling_report(docs, target)
    assert rows_of(got) == expected(rows, [r.text for r in target.collect()])
    assert [r["rank"] for r in got.where("rank IS NOT NULL").orderBy("rank").collect()] == list(range(1, got.where("rank IS NOT NULL").count() + 1))


def test_ties_repeats_and_odd_rows(spark, clash):
    rng = random.Random(3)
    long = " ".join(rng.choice(["Über", "alpha", "x9", "ß" * 60, "y" * 70, "z" * 46, "z" * 47, "z" * 48]) for _ in range(300))
    texts = [long] * 40 + [None, "", "one two", "A a A a " * 30] + ["common words stand here again " * 10] * 60
    ids = [5] * 40 + [1, 2, None, None] + [9] * 30 + list(range(30))
    df = clash(frame(spark, texts, ids)).repartition(5)
    target = spark.createDataFrame([("alpha alpha über",), (None,)], "text string")
    assert rows_of(resampling.resampling_report(df, target)) == expected(list(zip(ids, texts)), ["alpha alpha über", None])
    drawn = resampling.resample(df, target)
    assert drawn.columns == df.columns
    want = [v for v in brute(list(zip(ids, texts)), ["alpha alpha über", None]).values() if v[3]]
    assert drawn.count() == len(want)


def test_extreme_ids_and_empty_tables(spark):
    texts = [f"word{i} " * 25 for i in range(16)]
    ids = [2**63 - 1, -(2**63), -1, 0, *range(12)]
    target = spark.createDataFrame([], "text string")
    assert rows_of(resampling.resampling_report(frame(spark, texts, ids), target)) == expected(list(zip(ids, texts)), [])
    assert resampling.resampling_report(frame(spark, []), target).collect() == []
    assert rows_of(resampling.resampling_report(frame(spark, ["few words"]), target)) == expected([(0, "few words")], [])


def test_threshold_is_exact(spark):
    rng = random.Random(8)
    values = [rng.choice([-5, 0, 3, 10**12, -(10**12), 7]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for wanted in (1, 2, 100, 250, 499, 500):
        at = sorted(values)[wanted - 1]
        assert resampling.lowest_reaching(rows, F.col("v"), wanted) == (at, sum(v < at for v in values))


def test_huge_texts_are_cut_between_words():
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "B", "é", " ", ".", "7"]) for _ in range(40000)) + "q" * 9000 + " end"
    want = brute_features(text)
    for most in (1, 7, 4096, 1 << 20):
        words, last, found = [], [], Counter()
        hashes = resampling._Hashes()
        for part in word_lists(text.encode(), resampling._PLAIN, most):
            words += part
            for b in resampling._buckets(last + part, not last, hashes):
                found.update(b.tolist())
            last = part[-1:]
            if most == 1 and len(words) > 3000:
                break
        if most > 1:
            assert [w.decode() for w in words] == want[1][: want[0]]
            assert found == Counter(map(bucket, want[1]))


def test_moved_checksums():
    rng = np.random.default_rng(1)
    for n in (1, 5, 47):
        a, b = rng.bytes(9), rng.bytes(n)
        x, moved = zlib.crc32(a), zlib.crc32(b)
        for k in range(4):
            moved ^= int(resampling._MOVED[n, k, x >> 8 * k & 255])
        assert moved == zlib.crc32(a + b)
