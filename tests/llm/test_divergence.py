"""Perfect hashes, exact counts and shares against a slow version, in one and in many groups of shards."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import divergence
from .conftest import DOCS


def brute(rows, least=30, top=50):
    """Rows of the report from (lang, source, text) rows."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        n[lang].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, c in df[lang].items() if c >= least}
        total = {k: sum(n[k][t] for t in kept) for k in [lang, *[(lang, s) for s in sources]]}
        p = {k: {t: 1 + 1_000_000_000 * (n[k][t] + 5) // (total[k] + 5 * len(kept)) for t in kept} for k in total}
        for s in sources:
            far = [(-sum(abs(p[lang, s][t] - p[lang, o][t]) for t in kept), o.encode()) for o in sources - {s}]
            own = [(p[lang][t] - p[lang, s][t], t.encode()) for t in kept if n[lang, s][t] and p[lang, s][t] > p[lang][t]]
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(far), 1)}
            out |= {(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(sorted(own)[:top], 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "straße", "DON'T", "x1y"]
    rows = [(rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 5)}", " ".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(700)]
    return rows + [("en", "lonely", "zzz"), ("fr", "a", "rare words"), ("fr", "b", None), (None, None, ""), (None, "x", "q"), ("en", None, "waa WAA"), ("de", "s1", "waa")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None) for i, (lang, s, t) in enumerate(rows)], DOCS)


def test_whole_table(docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert result(divergence.divergence_report(docs, least_docs=5)) == brute(rows, 5)


def test_odd_rows(spark, clash, mixed):
    df = clash(table(spark, mixed).repartition(4)).withColumnRenamed("n", "p0")
    assert result(divergence.divergence_report(df)) == brute(mixed)
    assert divergence.divergence_report(table(spark, [])).collect() == []
    assert result(divergence.divergence_report(table(spark, [(None, None, None)]))) == set()


def test_many_shards_groups_and_tiles(spark, mixed, monkeypatch):
    for name, value in {"SHARD_TERMS": 16, "BROADCAST": 6000, "GATHER": 50, "SLOTS": 300, "BLOCK": 32, "TILE": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    groups = []
    made = divergence.Vocabulary.__init__
    monkeypatch.setattr(divergence.Vocabulary, "__init__", lambda self, rows: (groups.append(len(rows)), made(self, rows))[1])
    assert result(divergence.divergence_report(table(spark, mixed).repartition(3))) == brute(mixed)
    assert len(groups) > 2


def test_perfect_hash(monkeypatch):
    terms = [f"term{i}".encode() for i in range(5000)]
    made = divergence.PerfectHash(terms)
    found = made.slots(terms, divergence.hashes_of(terms))
    assert sorted(found.tolist()) == list(range(5000))
    assert [made.terms[i].as_py() for i in found.tolist()] == terms
    others = [f"other{i}".encode() for i in range(5000)]
    assert set(made.slots(others, divergence.hashes_of(others)).tolist()) == {-1}
    # Terms of one hash end in the list; others of that hash are told apart.
    monkeypatch.setattr(divergence, "hashes_of", lambda t: np.full(len(t), 7, np.uint64))
    same = divergence.PerfectHash([b"a", b"b", b"c"])
    assert same.slots([b"c", b"a", b"x", b"b"], np.full(4, 7, np.uint64)).tolist() == [2, 0, -1, 1]


def test_hash_is_that_of_the_table(spark):
    rows = spark.sql("SELECT t, xxhash64(CAST(t AS BINARY)) AS h FROM VALUES ('a'), ('straße'), ('a longer term of more than thirty-two bytes') AS v(t)").collect()
    assert divergence.hashes_of([r.t.encode() for r in rows]).view(np.int64).tolist() == [r.h for r in rows]


def test_shares_are_exact_for_huge_counts(spark):
    df = spark.sql("SELECT 9000000000000L AS n, 90000000000001L AS all_n, 7L AS terms")
    got = df.select(divergence._share("n", "all_n", "terms")).first()[0]
    assert got == 1 + 1_000_000_000 * (9000000000000 + 5) // (90000000000001 + 35)
