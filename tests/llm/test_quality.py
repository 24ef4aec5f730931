"""Base counts and the language model against slow versions; bands on planted texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import quality

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1cé #*😀"), max_size=80))
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == brute_counts(text)


def test_base_counts_of_table(docs):
    for r in docs.collect():
        assert quality.base_counts(r.text.encode()) == brute_counts(r.text)


def symbol(c):
    """The symbol of one character: ASCII as it is, others from 128 up."""
    b = [x if i == 0 else x & 63 for i, x in enumerate(c.encode())] + [0, 0]
    if len(c.encode()) == 1:
        return b[0]
    if len(c.encode()) == 2:
        return 128 | (b[0] & 1) << 6 | b[1]
    return 128 | (b[1] * 45 + b[2] * (3 if len(c.encode()) == 4 else 1) + (b[3] if len(c.encode()) == 4 else 0)) % 256 & 127


def test_symbols():
    text = "aZ 09\n~éßñÉжЖяωعשक中文字\U0001f600\U00010348"
    raw = np.frombuffer(text.encode(), np.uint8)
    found, first = quality.symbols_of(raw, np.array([0]))
    assert found.tolist() == [symbol(c) for c in text] and first.sum() == len(text)
    # The letters of an alphabet are told apart.
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "àâçéèêëîïôûùüÿñäöß"):
        assert len({symbol(c) for c in alphabet}) == len(alphabet)


def ways(texts):
    """{n-gram of symbols: number of different ways it is preceded}, one symbol at a time."""
    found = set()
    for t in texts:
        s = [0] * (quality.SPAN - 1) + [symbol(c) for c in t]
        found |= {tuple(s[i : i + quality.SPAN]) for i in range(len(s) - quality.SPAN + 1)}
    return Counter(w[-quality.ORDER :] for w in found)


def packed(gram):
    return sum(c << quality.BITS * i for i, c in enumerate(reversed(gram)))


def test_counts_are_whole_and_copies_add_nothing(spark, monkeypatch):
    texts = ["The cat, the hat.", "a mat & 12 rats", "The cat, the hat.", "é", "", None, "The cat", "кот и 中文", "x😀y"]
    for block in (1 << 20, 5):
        monkeypatch.setattr(quality, "BLOCK", block)
        held = [g for _, g in quality._blocks([t.encode() for t in texts if t], quality.SPAN)]
        mine = Counter(int(w) & (1 << quality.BITS * quality.ORDER) - 1 for w in np.unique(np.concatenate(held)))
        assert mine == {packed(g): n for g, n in ways([t for t in texts if t]).items()}
    rows = quality.continuation_counts(frame(spark, texts).repartition(3)).collect()
    assert {r.gram: r.n for r in rows} == {packed(g): n for g, n in ways([t for t in texts if t]).items()}


def brute_model(counts):
    """Modified Kneser-Ney by recursion over dictionaries."""
    levels = {quality.ORDER: counts}
    for k in range(quality.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, level in levels.items():
        of = Counter(level.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        discount[k] = [0] + [
            min(max(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)
        ]
    total, held = defaultdict(Counter), {}
    for k, level in levels.items():
        for g, n in level.items():
            total[k][g[:-1]] += n
            held.setdefault((k, g[:-1]), []).append(n)

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        context = gram[:-1]
        if context not in total[k]:
            return prob(gram[1:])
        d = discount[k]
        back = sum(d[min(n, 3)] for n in held[k, context]) / total[k][context]
        n = levels[k].get(gram, 0)
        return (n - d[min(n, 3)] if n else 0) / total[k][context] + back * prob(gram[1:])

    return prob


def test_model_against_recursion():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd e") for _ in range(60)) for _ in range(30)]
    counts = ways(texts)
    model = quality.LanguageModel(np.array([packed(g) for g in counts]), np.array(list(counts.values())))
    prob = brute_model(counts)
    some = [tuple(rng.choice([0, 32, 97, 98, 99, 100, 101, 200]) for _ in range(quality.ORDER)) for _ in range(400)] + list(counts)[:200]
    got = model.score(np.array([packed(g) for g in some], np.uint64))
    assert np.allclose(got, [math.log(prob(g)) for g in some], atol=1e-5)
    whole = model.score(np.array([packed((101, 32, 97, 98, c)) for c in range(256)], np.uint64))
    assert math.isclose(np.exp(whole).sum(), 1, abs_tol=1e-4)


def test_hash_array():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 5000):
        keys = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        held = quality.HashArray(keys)
        place = held.find(keys)
        assert sorted(place.tolist()) == list(range(len(keys))) and (keys[held.order][place] == keys).all()
        assert (held.find(keys + np.uint64(1 << 41)) == -1).all()


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def clean(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."

    texts = [clean(rng.randint(60, 400)) for _ in range(300)]
    texts += [texts[0]] * 200  # a large group of copies
    noise = [" ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(100)) for _ in range(4)]
    easy = [" ".join(f"{i}" for i in range(a, a + 200)) for a in (10**9, 2 * 10**9)]
    rows = quality.quality_report(frame(spark, texts + noise + easy + ["few words", None, "", "so on " * 100])).collect()
    return len(texts), {r.doc_id: r for r in rows}


def test_bands(planted):
    n, rows = planted
    assert all(rows[i].kept for i in range(n))
    # Noise is scored by texts that do not hold its n-grams, and leaves the band on the upper side.
    assert not any(rows[n + i].kept for i in range(4)) and all(rows[n + i].deviations > quality.UPPER for i in range(4))
    assert not any(rows[n + i].kept for i in range(4, 10))
    assert [rows[n + i].base_failed for i in range(4, 10)] == [False, False, True, True, True, True]
    assert (rows[n + 7].n_words, rows[n + 7].log_perplexity) == (0, None)


def test_odd_tables(spark, clash):
    assert quality.quality_report(frame(spark, [])).collect() == []
    assert quality.keep_good(frame(spark, [])).collect() == []
    few = clash(frame(spark, ["one two three " * 9 + str(i) + " x y z" * 30 for i in range(3)] + [" ".join(map(str, range(80))), None]))
    few = few.withColumn("lang", few.lang.substr(9, 1)).unionByName(few.replace("en", None, "lang"))
    assert [r.doc_id for r in quality.keep_good(few).collect()] == [3, 3]
    assert quality.keep_good(few).columns == few.columns
