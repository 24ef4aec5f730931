"""The randomness battery against plain Python, its p-values under randomness, and texts with very many matches."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from tabloom.llm import secrets

from .conftest import frame
from .test_secrets import check

ALPHABETS = {name: alphabet for name, _, alphabet in secrets.ENCODINGS}


def tail(z):
    z = max(-8.0, min(8.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def both(z):
    return min(2 * tail(abs(z)), 1.0)


def uniform(codes, k):
    n = len(codes)
    cells = max(min(n // 5, k), 2)
    x2 = 0.0
    for i in range(cells):
        inside = [c for c in range(k) if c * cells >= i * k and c * cells < (i + 1) * k]
        expected = n * len(inside) / k
        x2 += (sum(c in inside for c in codes) - expected) ** 2 / expected
    step = 2 / (9 * (cells - 1))
    return tail(((x2 / (cells - 1)) ** (1 / 3) - (1 - step)) / math.sqrt(step))


def runs(codes, k):
    n, upper = len(codes), [2 * c >= k for c in codes]
    h = sum(upper)
    twice = 2 * h * (n - h)
    var = twice * (twice - n) / (n * n * (n - 1))
    seen = 1 + sum(a != b for a, b in zip(upper, upper[1:]))
    return both((seen - twice / n - 1) / math.sqrt(var)) if var > 0 else 0.0


def serial(codes, k):
    mid = (k - 1) / 2
    total = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:]))
    return both(total / ((k * k - 1) / 12 * math.sqrt(len(codes) - 1)))


def fisher(ps):
    h = -sum(math.log(max(p, 1e-12)) for p in ps)
    return math.exp(-h) * (1 + h + h * h / 2)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(21)
    rows = []
    for name, alphabet in ALPHABETS.items():
        for n in (20, 21, 32, 40, 64, 200, 1000):
            rows += [(name, "".join(rng.choices(alphabet, k=n)), True) for _ in range(40 if n < 100 else 5)]
        rows += [(name, alphabet[i] * 25 + alphabet[-1], False) for i in (0, 5)] + [(name, alphabet * 3, False), (name, (alphabet[0] + alphabet[-1]) * 20, False)]
    table = spark.createDataFrame([(t, ALPHABETS[a], r) for a, t, r in rows], "token string, alphabet string, random boolean")
    token, k = F.col("token"), F.length("alphabet")
    codes = F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c) - 1)
    n = F.size(codes)
    return table.select(
        "*", secrets._uniform(codes, n, k).alias("uniform"), secrets._runs(codes, n, k).alias("runs"), secrets._serial(codes, n, k).alias("serial"),
        secrets._battery(token, F.col("alphabet")).alias("all"), secrets._judged(token).alias("judged"),
    ).collect()


def test_p_values_by_plain_python(judged):
    for r in judged:
        codes, k = [r.alphabet.index(c) for c in r.token], len(r.alphabet)
        want = [uniform(codes, k), runs(codes, k), serial(codes, k)]
        assert [r.uniform, r.runs, r.serial] == pytest.approx(want, rel=1e-9, abs=1e-12), r.token
        assert r["all"] == pytest.approx(fisher(want), rel=1e-8, abs=1e-15)


def test_normal_tail(spark):
    rows = spark.range(-600, 601).select((F.col("id") / 100).alias("z")).select("z", secrets._tail(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - math.erfc(r.z / math.sqrt(2)) / 2) for r in rows) < 2e-4


def test_p_values_under_randomness(judged):
    made = [r for r in judged if r.random]
    for name in ("uniform", "runs", "serial", "all"):
        for edge in (0.05, 0.2, 0.5):
            share = sum(r[name] <= edge for r in made) / len(made)
            assert abs(share - edge) < 4 * math.sqrt(edge * (1 - edge) / len(made)) + 0.03, (name, edge, share)
    assert all(r["all"] < 1e-4 for r in judged if not r.random)


def test_bins_of_p_values(judged):
    by = {name: set(alphabet) for name, alphabet in ALPHABETS.items()}
    for r in judged:
        fit = next(name for name, marks in by.items() if set(r.token) <= marks)
        if ALPHABETS[fit] == r.alphabet:
            want = min(math.floor(-math.log10(max(r["all"], 1e-19)) * secrets.STEPS), secrets.BINS - 1)
            assert abs(r.judged.bin - want) <= (1 if abs(-math.log10(max(r["all"], 1e-19)) * 20 % 1) < 1e-6 else 0)
            assert r.judged.band == int(math.log2(len(r.token)))


def test_very_many_matches(spark):
    rng = random.Random(5)
    b64 = string.ascii_letters + string.digits
    parts = [rng.choice(["é", "😀x", "", "\n"]) + rng.choice(["token=" + "".join(rng.choices(b64, k=30)), "".join(rng.choices("0123456789abcdef", k=32)), "".join(rng.choices(b64, k=40))]) for _ in range(150)]
    texts = [" ".join(parts), "x" * 10000 + " token=abcdef1 " + "é" * 10000, "token=abcdef1" + "😀" * 4096 + "token=abcdef1", "é pass password=abcdef " * 2000]
    found = spark.createDataFrame(secrets.find_secrets(frame(spark, texts)).collect())
    check(secrets.secret_report(frame(spark, texts)).collect(), texts)
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, texts)).collect()}
    for r in found.collect():
        spans = [(s.start, s.end) for s in r._spans]
        base = [(s.start, s.end) for s in r._base]
        out, at = "", -1
        for start, end in spans:
            if start > at:
                out += r.text[max(at, 0) : start] + secrets.MARK
            at = max(at, end)
        assert clean[r.doc_id] == out + r.text[at:]
        held, far = set(base), -1
        for start, end in sorted(spans, key=lambda s: (s[0], s not in held)):
            if (start, end) in held:
                far = max(far, end)
            else:
                assert end > far
