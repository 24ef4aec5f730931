import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabloom.functions import privacy as V
from tabloom.operators import privacy as P


def counts(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return {r.label: r.n for r in P.entity_counts(df, "id", "t").collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b@mail.example.com or x@y.org", {"EMAIL": 2}),
        ("host 10.0.0.255, not 10.0.0.256", {"IP_ADDRESS": 1}),
        ("card 4111 1111 1111 1111 and 4111111111111112", {"CREDIT_CARD": 2}),
        ("ssn 123-45-6789", {"SSN": 1}),
        ("call +1 555-010-1234", {"PHONE_NUMBER": 1}),
        ("nothing here", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_patterns(spark, text, want):
    assert counts(spark, text) == want


def test_a_match_counts_for_one_label_only(spark):
    assert counts(spark, "4111 1111 1111 1111") == {"CREDIT_CARD": 1}
    assert counts(spark, "192.168.10.100") == {"IP_ADDRESS": 1}


def test_hints_never_hide_a_match():
    samples = ["x@y.org", "1.2.3.4", "4111111111111111", "123-45-6789", "(020) 1234 5678", "12 345 678", "99.1234.5678"]
    for label, pattern in V.ENTITY_PATTERNS.items():
        for s in samples:
            if re.search(pattern, s):
                assert re.search(V.ENTITY_HINTS[label], s), (label, s)


def test_ratio_exactly_at_the_threshold(spark):
    values = ["a@b.org", "b@b.org", "c@b.org"] + ["x"] * 17
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    r = P.pii_columns_full(df, ["v"]).first()
    assert (r.n_entities, r.n_sampled, r.is_pii) == (3, 20, True)
    assert not P.pii_columns_full(df.where("id > 0"), ["v"]).first().is_pii


def test_blank_cells_count_and_nulls_do_not(spark):
    df = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "  "), (3, None)], "id int, v string")
    r = P.pii_columns(df, ["id"]).first()
    assert (r.n_entities, r.n_sampled, r.ratio) == (2, 2, 1.0)


def test_sample_size_and_repeatability(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("a"), F.when(F.col("id") < 4, "z").alias("b"))
    first = sorted(tuple(r) for r in P.sample_cells(df, ["id"]).collect())
    again = sorted(tuple(r) for r in P.sample_cells(df.repartition(9), ["id"]).collect())
    assert first == again
    assert sum(r[0] == "a" for r in first) == 10 and sum(r[0] == "b" for r in first) == 4


def test_sample_ranks_the_lowest_hashes_only(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("a"), F.when(F.col("id") < 4, "z").alias("b"))
    sample = P.sample_cells(df, ["id"])

    def lowest(column, ids):
        ordered = sorted(ids, key=lambda i: hashlib.md5(f"{column}|{i}".encode()).hexdigest())[:10]
        return {(column, i, rank) for rank, i in enumerate(ordered, start=1)}

    assert {(r.column_name, r.id, r["rank"]) for r in sample.collect()} == lowest("a", range(3000)) | lowest("b", range(4))
    assert "_zeros" in sample._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table_flags_nothing(spark):
    assert P.pii_columns(spark.createDataFrame([], "id int, v string"), ["id"]).collect() == []


@pytest.mark.parametrize("limit", [200_000, 1])
def test_names_of_several_words(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_NAMES", limit)
    df = spark.createDataFrame([(1, "From «New York City», to york; Middle East.")], "id int, t string")
    names = spark.createDataFrame(
        [("new york city", "GPE"), ("york", "PERSON"), ("middle east", "LOC"), ("absent", "LOC")], "name string, label string"
    )
    got = {r.label: r.n for r in P.gazetteer_counts(df, ["id"], "t", names, longest=3).collect()}
    assert got == {"GPE": 1, "PERSON": 2, "LOC": 1}


def test_outcomes_round_trip(spark):
    df = spark.createDataFrame(
        [("Success", ["a", "b"]), ("Analysis complete: No PII columns detected", []), ("Download failed", None), ("odd one", [])],
        "m string, f array<string>",
    )
    stored = df.select(V.outcome_code("m", "f").alias("s"))
    assert [r.s for r in stored.collect()] == ['["a","b"]', "no_pii_found", "processing_error", "odd"]
    decoded = stored.select(V.decoded_size("s"), V.decoded_message("s", F.lit("pii_detection")))
    assert [r[0] for r in decoded.collect()] == [2, 0, 0, None]
    assert decoded.first()[1] == "Retrieved 2 PII column(s) from cache"
    assert decoded.collect()[3][1] == "Error: Cached data is corrupt"


def test_eye_region_at_the_image_edge(spark):
    def truth(x, y, w, h, width, height):
        left, right = x + int(w * 0.15), x + int(w * 0.85)
        top, bottom = y + int(h * 0.30), y + int(h * 0.45)
        px, py = int((right - left) * 0.15), int((bottom - top) * 0.20)
        return max(0, left - px), max(0, top - py), min(width, right + px), min(height, bottom + py)

    faces = [(0, 0, 33, 47, 20, 15), (5, 7, 101, 99, 640, 480), (600, 470, 80, 80, 640, 480)]
    df = spark.createDataFrame(faces, "x int, y int, w int, h int, iw int, ih int")
    box = V.eye_region("x", "y", "w", "h", "iw", "ih")
    assert [tuple(r) for r in df.select(*box.values()).collect()] == [truth(*f) for f in faces]


def test_eye_boxes_skip_faces_without_eye_points(spark):
    points = spark.createDataFrame([(1, 1, 36, 10, 20), (1, 1, 47, 50, 33), (1, 2, 5, 1, 1)], "image_id int, face_id int, point int, x int, y int")
    images = spark.createDataFrame([(1, 52, 100)], "image_id int, width int, height int")
    assert [tuple(r) for r in P.eye_boxes(points, images).collect()] == [(1, 1, 4, 19, 52, 34)]


def test_fallback_and_summary(spark):
    primary = spark.createDataFrame([(1, "p"), (1, "p")], "image_id int, d string")
    fallback = spark.createDataFrame([(1, "f"), (2, "f")], "image_id int, d string")
    both = P.with_fallback(primary, fallback)
    assert sorted(tuple(r) for r in both.collect()) == [(1, "p"), (1, "p"), (2, "f")]
    summary = P.detection_summary(spark.range(1, 4).withColumnRenamed("id", "image_id"), both)
    assert sorted(tuple(r)[1] for r in summary.collect()) == [0, 1, 2]
    assert P.outcome_totals(summary).count() == 3


def test_file_category(spark):
    df = spark.createDataFrame([("HEIC",), ("sav",), ("exe",), (None,)], "t string")
    assert [r[0] for r in df.select(V.file_category("t")).collect()] == ["image", "data", "unknown", "unknown"]
