"""Texts are scored by what other texts hold: noise is improbable at any count."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.llm import quality

from .conftest import frame

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def noise(rng):
    return " ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(100))


@pytest.mark.parametrize("count", [1, 10, 20, 100, 200])
def test_noise_leaves_above(spark, count):
    """200 of 600 are a third of all rows."""
    rng = random.Random(count)
    clean = [prose(rng, rng.randint(60, 400)) for _ in range(400)]
    rows = quality.quality_report(frame(spark, clean + [noise(rng) for _ in range(count)])).collect()
    assert all(r.kept for r in rows if r.doc_id < len(clean))
    junk = [r for r in rows if r.doc_id >= len(clean)]
    assert len(junk) == count and not any(r.kept or r.base_failed for r in junk)
    assert all(r.deviations > quality.UPPER for r in junk)


def test_counts_without_a_fold(spark):
    rng = random.Random(3)
    texts = [prose(rng, 5) for _ in range(40)] * 2
    docs = frame(spark, texts)
    folds = [r.f for r in docs.select(quality._fold(docs.text).alias("f")).collect()]
    assert set(folds) == set(range(quality.FOLDS)) and folds[:40] == folds[40:]
    rows = quality.continuation_counts(docs.repartition(3)).collect()
    for fold in range(quality.FOLDS):
        others = frame(spark, [t for t, f in zip(texts, folds) if f != fold])
        want = {r.gram: r.n for r in quality.continuation_counts(others).collect()}
        assert {r.gram: r.n - r[f"alone{fold}"] for r in rows if r.n > r[f"alone{fold}"]} == want


def test_junk_does_not_widen_the_band(spark):
    rng = random.Random(6)
    scores = [rng.gauss(2, 0.05) for _ in range(400)] + [2.5 + 0.001 * i for i in range(10)]
    junk = [4.2 + 0.001 * i for i in range(200)]

    def kept(values):
        rows = [(i, "en", 2000, 100, 0, v) for i, v in enumerate(values)]
        table = spark.createDataFrame(rows, "i int, _lang string, _bytes bigint, _n_words bigint, _n_repeat_words bigint, _log_perplexity double")
        return {r.i: r.deviations for r in quality.judged(table).select("i", F.col("_deviations").alias("deviations")).collect()}

    alone, beside = kept(scores), kept(scores + junk)
    assert all(abs(alone[i] - beside[i]) < 1e-9 for i in alone)


def languages(spark, texts):
    return frame(spark, [t for _, t in texts]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(texts)], "doc_id bigint, lang string"), "doc_id"
    )


def test_no_count_is_dropped(spark, monkeypatch):
    rng = random.Random(5)
    docs = languages(spark, [("big", prose(rng, 100)) for _ in range(60)] + [("few", noise(rng)) for _ in range(6)])
    want = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert len(want) == 66 and all(r.log_perplexity is not None for r in want.values())
    for entries in (1, 5000):
        monkeypatch.setattr(quality, "MAX_ENTRIES", entries)
        assert {r.doc_id: r for r in quality.quality_report(docs).collect()} == want


def test_small_languages_share_a_band(spark):
    rng = random.Random(7)
    texts = [(lang, prose(rng, 200)) for lang in ("aa", "bb", "cc") for _ in range(20)]
    rows = {r.doc_id: r for r in quality.quality_report(languages(spark, [*texts, ("aa", noise(rng))])).collect()}
    assert all(rows[i].kept for i in range(60))
    assert rows[60].deviations > quality.UPPER and not rows[60].kept


@pytest.mark.parametrize("count", [1, 20, 200])
def test_random_letters_of_any_script_leave_above(spark, count):
    """Letters in a random order, in Latin and in Cyrillic, beside prose of the same letters and length of words."""
    rng = random.Random(count)
    latin, cyrillic = SYLLABLES, "ст но то на ен ов ни ра во ко пр ер ос ро ли по ал ан ет ре ка ва та".split()

    def prose_of(syllables):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(80, 300)))

    def salad_of(syllables):
        letters = sorted(set("".join(syllables)))
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(150))

    clean = [prose_of(s) for s in (latin, cyrillic) for _ in range(200)]
    junk = [salad_of(s) for s in (latin, cyrillic) for _ in range(max(count // 2, 1))]
    docs = frame(spark, clean + junk).withColumn("lang", F.when(F.col("text").rlike("[a-z]"), "en").otherwise("ru"))
    rows = quality.quality_report(docs).collect()
    assert all(r.kept for r in rows if r.doc_id < len(clean))
    assert not any(r.kept or r.base_failed for r in rows if r.doc_id >= len(clean))
