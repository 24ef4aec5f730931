"""The folded kernel against enumeration; held-out accuracy; gapped and spelt-out insults."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from tabloom.llm import toxicity

from .conftest import frame

SF = "/root/testdata/sf0.1"


def slow_vector(word):
    """Weights of all subsequences of three symbols, at most two skipped, of a word and its two marks."""
    s = [toxicity.BOUNDARY, *[int(toxicity.CLASSES[b]) for b in word], toxicity.BOUNDARY]
    out = {}
    for i, j, k in combinations(range(len(s)), 3):
        if k - i <= 4:
            key = s[i] << 12 | s[j] << 6 | s[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    return out


def test_features_by_enumeration():
    words = [b"idiot", b"a", b"b", "réeuxment".encode(), b"i-d-i-o-t", b"xx", b"aaaa1!"]
    word, gram, value = toxicity.features(words)
    for i, w in enumerate(words):
        got = dict(zip(gram[word == i].tolist(), value[word == i].tolist()))
        want = slow_vector(w)
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_unit_scores_equal_folded_kernels():
    marks = toxicity.Landmarks([b"idiot", b"stupid", b"nation", b"the", b"reading"])
    w = np.arange(marks.root.shape[1]) - 1.5
    table = marks.fold(w)
    text = "An idi*ot  read\nthe i d i o t nation, é!".encode().lower()
    u = toxicity.units(text)
    assert [bytes(text[s - 1 : e]) for s, e in zip(u.starts, u.ends)] == [
        b"an", b"idi*ot", b"read", b"the", b"i d i o t", b"nation,", "é!".encode()
    ]
    got = toxicity.unit_scores(u, table)
    for i, name in enumerate([b"an", b"idi*ot", b"read", b"the", b"i d i o t", b"nation,", "é!".encode()]):
        slow = sum(v * table[k] for k, v in slow_vector(name).items())
        assert np.isclose(got[i], slow, atol=1e-6)
    feats = marks.map([b"idiot", b"read"]) @ w
    assert np.allclose(feats, toxicity.unit_scores(toxicity.units(b"idiot read"), table), atol=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hit = model.scores([r.text for r in rows]) >= 0.5
    toxic = np.array([r.toxic for r in rows]) == 1
    assert hit[toxic].mean() >= 0.88
    assert hit[~toxic].mean() <= 0.015


def test_gaps(spark, model):
    clean = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 500 AND 900").collect() if model.scores([r.text])[0] < 0.1)
    plain = model.scores([clean])[0]
    for insults in ("idiot stupid moron", "id-iot stupi.d mo*ron", "i d i o t s t u p i d m o r o n", "IDIOT STUPID MORON", "idxiot stu7pid idiiot moroon"):
        assert model.scores([clean + " " + insults])[0] > max(0.5, plain)


@pytest.fixture(scope="module")
def harmless(spark, model):
    """English documents that are labelled harmless and predicted so."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 300 AND 6000").join(labels, "doc_id", "left_semi")
    texts = [r.text for r in rows.orderBy("doc_id").limit(1200).collect()]
    return [t for t, s in zip(texts, model.scores(texts)) if s < 0.5]


def test_length_alone_is_not_toxic(model, harmless):
    """Harmless documents one after the other stay harmless, up to megabytes."""
    rng = np.random.default_rng(3)
    for size in (25_000, 240_000, 1_200_000):
        flagged = []
        for _ in range(40):
            text, n = [], 0
            while n < size:
                text.append(harmless[rng.integers(len(harmless))])
                n += len(text[-1])
            flagged.append(model.scores(["\n".join(text)])[0] >= 0.5)
        assert np.mean(flagged) <= 0.01, size


def test_one_form_of_insults_at_a_time(model, harmless):
    """Three learnt insults in a harmless document, all plain, with marks, with a letter put in, or spelt with spaces."""
    ways = {
        "plain": lambda w: w, "marks": lambda w: ".".join(w), "inserted": lambda w: w[:3] + "x" + w[3:],
        "spaces": lambda w: " ".join(w), "capitals": str.upper,
    }
    caught = {}
    for name, change in ways.items():
        texts = []
        for t in harmless[:200]:
            words = t.split(" ")
            for k, insult in enumerate(["idiot", "worthless", "pathetic"]):
                words.insert((k + 1) * len(words) // 4, change(insult))
            texts.append(" ".join(words))
        caught[name] = float((model.scores(texts) >= 0.5).mean())
    assert all(caught[name] >= 0.9 for name in ("plain", "marks", "spaces", "capitals")) and caught["inserted"] >= 0.4, caught


def test_spelt_out_words_are_joined():
    for text, want in {
        "you i d i o t now": b"you idiot now", "a b": b"a b", "a b c": b"abc", "é è ê": "éèê".encode(), "x y zz": b"x y zz",
        "aa b c d": b"aa bcd", "a\nb\nc": b"a\nb\nc", "": b"",
    }.items():
        assert toxicity.normal(text) == want


def test_long_text_in_blocks(model, monkeypatch):
    text = toxicity.normal("the nation of stupid words " * 500)
    whole = model.word_scores(text)
    monkeypatch.setattr(toxicity, "BLOCK", 997)
    assert np.allclose(np.sort(model.word_scores(text)), np.sort(whole))


def test_odd_rows(spark, clash):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (4, None), (99, 1)], "doc_id bigint, toxic int")
    texts = ["plain words stand here" + " foul idiot" * (i % 2) for i in range(60)] + [None, "", "x" * 10**6, "foul idiot"]
    ids = [*range(60), 70, 71, None, 3]
    rows = toxicity.toxicity_report(clash(frame(spark, texts, ids)), labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 64 and by[70].score == by[71].score < 0.5
    assert [by[i].predicted for i in range(60)] == [i % 2 for i in range(60)]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = toxicity.drop_toxic(clash(frame(spark, texts, ids)), labels)
    assert kept.columns == clash(frame(spark, [])).columns and kept.where("doc_id < 60 AND doc_id % 2 = 1").count() == 0
    assert toxicity.toxicity_report(frame(spark, []), labels).collect() == []
    assert {r.predicted for r in toxicity.toxicity_report(frame(spark, texts, ids), labels.limit(0)).collect()} == {0}
