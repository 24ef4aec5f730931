"""Base places and notices against a slow version; only built-in functions run."""

import math
import random
import re

import pytest

from tabloom.llm import licenses
from .conftest import frame


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, phrases=licenses.PHRASES, notices=licenses.NOTICES, containment=licenses.CONTAINMENT):
    words = words_of(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base, more, share, found = {label for _, label in places}, set(), 0.0, 0
    for label, notice in notices:
        own, size = set(notice.split()), 16
        while size < 2 * len(notice.split()):
            size *= 2
        blocks = [words[i : i + size] for i in range(0, max(len(words) - size // 2, 1), size // 2)]
        best = max(len(own & set(b)) for b in blocks)
        if best >= math.ceil(round(containment * len(own), 9)):
            more.add(label)
            found += 1
            share = max(share, best / len(own))
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | more)), 1.0 if places else share, found,
    )


def result(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_whole_table(docs):
    rows = docs.collect()
    assert result(licenses.license_report(docs)) == {r.doc_id: brute(r.text) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    tokens = sorted({t for _, n in licenses.NOTICES for t in n.split()})
    out = []
    for _, notice in licenses.NOTICES:
        for lost in (0, 1, 2, 5):  # some words dropped, others put between, in other orders
            words = notice.split()
            for _ in range(lost):
                words[rng.randrange(len(words))] = rng.choice(["foo", "bar", ""])
            filler = [rng.choice(tokens) for _ in range(rng.randrange(80))]
            out.append(" ".join([*filler, *words, *filler[::-1]]))
            rng.shuffle(words)
            out.append(", ".join([*["pad"] * rng.randrange(40), *words]).upper())
    out += [" ".join(rng.choices(tokens, k=400)) for _ in range(20)]
    return out


def test_notices(spark, texts):
    got = result(licenses.license_report(frame(spark, texts).repartition(3)))
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len({r[5] for r in got.values()}) > 8


def test_places(spark, clash):
    texts = [
        "The MIT License. mit-license; MIT\nLICENSE MIT", "GNU general (public) LICENSE gnu General Public Licence", "cc by CC-BY cc cc by", None, "", "...",
        "apache apache license", "mit license mit éc by cc éby", "Kind cc BY İx", "gnu general public", "mit license " * 3000,
    ]
    df = clash(frame(spark, texts))
    assert result(licenses.license_report(df)) == {i: brute(t) for i, t in enumerate(texts)}
    twice = frame(spark, ["cc by", "cc by", "x"], [4, 4, None])
    assert sorted(r.n_base for r in licenses.license_report(twice).collect()) == [0, 1, 1]
    assert licenses.license_report(frame(spark, [])).collect() == []


def test_own_phrases_and_notices(spark):
    texts = ["one two three", "two three two three", "alpha beta gamma delta", "alpha gamma"]
    phrases, notices = {"two three": "a", "two": "b"}, (("c", "alpha beta gamma delta"), ("d", "alpha gamma"))
    got = result(licenses.license_report(frame(spark, texts), phrases=phrases, notices=notices))
    assert got == {i: brute(t, phrases, notices) for i, t in enumerate(texts)}
    bare = result(licenses.license_report(frame(spark, texts), notices=()))
    assert bare == {i: brute(t, notices=()) for i, t in enumerate(texts)}


def test_built_in_functions_only(spark, docs):
    plan = licenses.license_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "ExistingRDD"))


def test_kelvin_sign_is_no_plain_letter(spark):
    texts = ["Keep this token", "keep this token", "KEEP THIS TOKEN"]
    got = result(licenses.license_report(frame(spark, texts), notices=(("a", "keep this token"),)))
    assert [got[i][5] for i in range(3)] == ["", "a", "a"]
