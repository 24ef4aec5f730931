import math
import random
import statistics
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile as P

quantile_module = sys.modules["tabloom.operators.profile.quantiles"]
frequencies = sys.modules["tabloom.operators.profile.frequencies"]


def by_variable(df):
    return {r["variable"]: r for r in df.collect()}


def distributions():
    rng = random.Random(7)
    n = 3000
    return pd.DataFrame(
        {
            "even": [float(i) for i in range(n)],
            "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(n)],
            "constant": [4.5] * n,
            "wild": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
            "hot": [0.0 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)],
            "infinite": [math.inf if i % 7 == 0 else -math.inf if i % 11 == 0 else float(i) for i in range(n)],
        }
    )


@pytest.mark.parametrize("accuracy, fetch", [(10_000, 1000), (20, 5), (20, 0), (5, 0), (200, 0)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, fetch):
    """A coarse sketch and small fetches force many narrowing passes."""
    monkeypatch.setattr(quantile_module, "ACCURACY", accuracy)
    monkeypatch.setattr(quantile_module, "FETCH_ROWS", fetch)
    rows = distributions()
    got = by_variable(P.quantiles(spark.createDataFrame(rows).repartition(5)))
    for c in rows.columns:
        ordered = sorted(rows[c])
        for p, name in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")):
            h = (len(ordered) - 1) * p
            low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
            want = low if low == high else low + (high - low) * (h - math.floor(h))
            assert got[c][name] == pytest.approx(want, rel=1e-12), (c, name)


def test_mad(spark):
    rows = distributions()[["even", "ties", "constant", "hot"]]
    got = by_variable(P.median_absolute_deviation(spark.createDataFrame(rows)))
    for c in rows.columns:
        m = statistics.median(rows[c])
        assert got[c]["median"] == m
        assert got[c]["mad"] == pytest.approx(statistics.median(abs(x - m) for x in rows[c]))


def test_quantiles_of_missing_and_single_values(spark):
    df = spark.sql("select double(null) a, double('NaN') b, 3 c, bigint(null) d")
    got = by_variable(P.quantiles(df))
    assert got["a"]["q50"] is None and got["b"]["q50"] is None and got["d"]["iqr"] is None
    assert got["c"]["q05"] == got["c"]["q95"] == 3.0
    mads = by_variable(P.median_absolute_deviation(df))
    assert mads["a"]["mad"] is None and mads["c"]["mad"] == 0.0


def test_quantiles_of_an_empty_table(spark):
    got = P.quantiles(spark.createDataFrame([], "a double")).collect()
    assert [tuple(r) for r in got] == [("a", None, None, None, None, None, None)]


def test_numeric_matches_pandas(spark):
    rows = distributions()[["even", "ties", "hot"]]
    rows.loc[::10, "ties"] = np.nan
    got = by_variable(P.numeric_profile(spark.createDataFrame(rows)))
    for c in rows.columns:
        s = rows[c]
        r = got[c]
        assert r["n"] == len(s) and r["n_missing"] == s.isna().sum()
        for name, want in (
            ("mean", s.mean()), ("std", s.std()), ("variance", s.var()), ("skewness", s.skew()), ("kurtosis", s.kurt()),
            ("min", s.min()), ("max", s.max()), ("sum", s.sum()), ("cv", s.std() / s.mean()),
        ):
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-12), (c, name)
        assert r["n_zeros"] == (s == 0).sum() and r["n_negative"] == (s < 0).sum()


def test_numeric_of_few_rows(spark):
    for n in range(5):
        df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(2).alias("k"))
        got = by_variable(P.numeric_profile(df))
        s = pd.Series([float(i * i) for i in range(n)])
        assert got["x"]["n"] == n
        for name, want in (("std", s.std()), ("skewness", s.skew()), ("kurtosis", s.kurt())):
            value = got["x"][name]
            assert (value is None and math.isnan(want)) or value == pytest.approx(want), (n, name)
        assert got["k"]["skewness"] == (0.0 if n > 2 else None)


def test_infinite_values_are_counted_and_left_out_of_bins(spark):
    df = spark.createDataFrame(distributions()[["infinite"]])
    r = P.numeric_profile(df).first()
    assert r["n_infinite"] == sum(math.isinf(x) for x in distributions()["infinite"])
    assert r["max"] == math.inf
    bins = P.histogram(df).collect()
    assert len(bins) == 50 and sum(b["count"] for b in bins) == 3000 - r["n_infinite"]


def test_histogram_equals_numpy(spark):
    rows = distributions()[["even", "hot", "constant"]]
    got = P.histogram(spark.createDataFrame(rows), bins=20).collect()
    for c in rows.columns:
        want, edges = np.histogram(rows[c], bins=20)
        mine = sorted((r["bin"], r["count"], r["lower"]) for r in got if r["variable"] == c)
        assert [m[1] for m in mine] == list(want)
        assert [m[2] for m in mine] == pytest.approx(list(edges[:-1]))


def test_distinct_counts_edge_cases(spark):
    df = spark.sql(
        "select * from values ('a', 1, cast(null as string), array(1)), ('a', 2, null, array(1)), "
        "(null, 3, null, array(2)) t(text, whole, nothing, list)"
    )
    got = by_variable(P.distinct_counts(df))
    assert (got["text"]["n_missing"], got["text"]["n_distinct"], got["text"]["n_unique"]) == (1, 1, 0)
    assert got["whole"]["is_unique"] and got["whole"]["p_distinct"] == 1.0
    assert (got["nothing"]["n_missing"], got["nothing"]["n_distinct"], got["nothing"]["is_unique"]) == (3, 0, False)
    assert got["list"]["n_distinct"] == 2
    empty = by_variable(P.distinct_counts(df.limit(0)))
    assert set(empty) == set(got) and all(r["n"] == 0 and r["p_missing"] == 0.0 for r in empty.values())


def test_top_values_break_ties_by_value(spark):
    df = spark.sql("select explode(array('b', 'b', 'a', 'a', 'c', null)) x")
    got = [(r["rank"], r["value"], r["count"]) for r in P.top_values(df, n=2).orderBy("rank").collect()]
    assert got == [(1, "a", 2), (2, "b", 2)]


def test_alerts(spark):
    df = spark.range(500).selectExpr(
        "id",
        "'x' as constant",
        "if(id < 100, null, id) as missing",
        "if(id % 2 = 0, 0, 1) as zeros",
        "concat('v', id) as wide",
        "if(id = 0, 'rare', 'usual') as uneven",
        "if(id = 0, 1e12, 1.0) as skewed",
    )
    got = {(r["variable"], r["alert"]) for r in P.alerts(df).collect()}
    assert got == {
        ("id", "UNIQUE"),
        ("constant", "CONSTANT"),
        ("missing", "MISSING"),
        ("missing", "UNIQUE"),
        ("zeros", "ZEROS"),
        ("wide", "HIGH_CARDINALITY"),
        ("wide", "UNIQUE"),
        ("uneven", "IMBALANCE"),
        ("skewed", "SKEWED"),
    }


def test_monotonic(spark):
    df = spark.range(1000).repartition(7).selectExpr(
        "id as k", "id * 2 as up", "-id as down", "id div 10 as flat", "if(id = 500, -1, id) as broken",
        "if(id % 3 = 0, null, double(id)) as gaps",
    )
    got = {r[0]: tuple(r)[1:] for r in P.monotonic_profile(df, "k", ["up", "down", "flat", "broken", "gaps"]).collect()}
    assert got["up"] == (True, False, True, False)
    assert got["down"] == (False, True, False, True)
    assert got["flat"] == (True, False, False, False)
    assert got["broken"] == (False, False, False, False)
    assert got["gaps"] == (True, False, True, False)


def test_monotonic_with_tied_order(spark):
    df = spark.sql("select * from values (1, 5), (1, 3), (2, 5), (3, 9) t(k, v)")
    assert tuple(P.monotonic_profile(df, "k", ["v"]).first())[1:] == (True, False, False, False)


def test_grouped_profile_equals_profile_of_each_group(spark):
    df = spark.range(500).selectExpr("if(id % 3 = 0, 'hot', string(id % 5)) as g", "id * 1.5 as x")
    for r in P.grouped_profile(df, ["g"]).collect():
        alone = P.numeric_profile(df.where(F.col("g") == r["g"]), ["x"]).first()
        for name in ("n", "mean", "std", "min", "max", "skewness"):
            assert r[name] == pytest.approx(alone[name])


def test_wide_table_is_profiled_in_passes(spark):
    df = spark.range(50).selectExpr(*[f"id * {i} as c{i}" for i in range(70)])
    got = by_variable(P.numeric_profile(df))
    assert len(got) == 70 and got["c69"]["max"] == 49 * 69
    assert len(P.quantiles(df).collect()) == 70


def test_report_policies(spark):
    df = spark.sql("select * from values (1, 'a'), (null, 'b'), (3, null) t(x, y)")
    def metric(report, variable, name):
        wanted = (F.col("section") == "metric") & (F.col("variable") == variable) & (F.col("name") == name)
        return report.where(wanted).first()["value"]

    assert metric(P.profile_report(df, "keep"), "x", "n_missing") == 1
    assert metric(P.profile_report(df, "fill"), "x", "n_zeros") == 1
    assert metric(P.profile_report(df, "drop"), "x", "n") == 1
    with pytest.raises(ValueError):
        P.profile_report(df, "guess")
    # One document for each variable, and one for the table.
    assert P.profile_json(P.profile_report(df)).count() == 3


def test_report_sections(spark):
    df = spark.sql("select id, id % 2 = 0 as even, if(id < 9, 'a', 'b') as t from range(10)")
    report = P.profile_report(df).collect()
    assert {r.section for r in report} == {"table", "metric", "top", "flag", "alert", "bin"}
    assert sorted((r.text, r.value) for r in report if r.section == "flag") == [("false", 5.0), ("true", 5.0)]
    assert [(r.rank, r.text, r.value) for r in report if r.section == "top" and r.variable == "t"] == [(1, "a", 9.0), (2, "b", 1.0)]
    assert ("id", "UNIQUE") in {(r.variable, r.name) for r in report if r.section == "alert"}
    assert sum(r.value for r in report if r.section == "bin" and r.name == "count") == 10


def test_report_reads_its_rows_a_bounded_number_of_times(spark, tmp_path):
    """Filtered rows are written once; every later scan reads single columns of the written rows."""
    from tabloom.session import Scratch

    path = str(tmp_path / "wide.parquet")
    spark.range(200).selectExpr("id AS a", "id * 2 AS b", "id % 7 AS c", "string(id % 3) AS t", "if(id > 5, id, null) AS n").write.parquet(path)
    with Scratch(spark) as scratch:
        report = P.profile_report(spark.read.parquet(path), "drop", scratch)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert path not in plan
        assert plan.count("FileScan parquet") <= 24
        assert {r.value for r in report.where("section = 'table' AND name = 'n_rows'").collect()} == {194.0}


def test_grouped_quantiles_with_a_hot_group_and_null_key(spark):
    rows = distributions()[["ties", "hot", "infinite"]]
    rows["g"] = ["hot" if i % 3 else None if i % 5 == 0 else f"g{i % 7}" for i in range(len(rows))]
    df = spark.createDataFrame(rows)
    got = {(r["g"], r["variable"]): r for r in P.grouped_quantiles(df, ["g"]).collect()}
    groups = set(rows["g"])
    assert len(got) == 3 * len(groups)
    for g in groups:
        part = rows[rows["g"].isna()] if g is None else rows[rows["g"] == g]
        for c in ("ties", "hot", "infinite"):
            ordered = sorted(part[c])
            for p, name in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")):
                h = (len(ordered) - 1) * p
                low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
                want = low if low == high else low + (high - low) * (h - math.floor(h))
                assert got[(g, c)][name] == pytest.approx(want), (g, c, name)


def test_long_texts_are_told_apart_by_digest(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "a",), (long + "b",), ("x" * 64,), ("x" * 65,)], "t string")
    r = P.distinct_counts(df).first()
    assert (r["n_distinct"], r["n_unique"]) == (4, 3)
    top = P.top_values(df, n=1).first()
    assert (top["value"], top["count"]) == (long + "a", 2)


def test_frequent_values_are_proven_or_counted_in_full(spark, monkeypatch):
    df = spark.sql(
        "SELECT IF(id % 3 = 0, 'hot', IF(id % 5 = 0, 'warm', string(id))) AS a, id AS key, id % 7 AS few, double(id % 40) / 3 AS d,"
        " CAST(NULL AS STRING) AS nothing, date_add(date'2020-01-01', int(id % 9)) AS day FROM range(6000)"
    )
    asked = []
    full = frequencies.top_values
    monkeypatch.setattr(frequencies, "top_values", lambda df, columns, *a, **k: (asked.append(columns), full(df, columns, *a, **k))[1])
    for n in (2, 10):
        asked.clear()
        got = sorted(map(tuple, frequencies.frequent_values(df, n=n).collect()))
        assert got == sorted(map(tuple, full(df, n=n).collect()))
        rest = {c for columns in asked for c in columns}
        # Forty values of equal frequency are more than the candidates for two.
        assert "key" in rest and not rest & {"few", "day"} and ("a" in rest, "d" in rest) == (n == 10, n == 2)


def test_approximate_counts(spark):
    df = spark.range(50_000).selectExpr("id", "id % 1000 AS m", "IF(id % 2 = 0, NULL, string(id % 77)) AS s", "CAST(NULL AS INT) AS z", "double(id) AS d")
    want = {r.variable: r for r in frequencies.frequency_summary(df).collect()}
    for r in frequencies.approximate_summary(df).collect():
        whole = want[r.variable]
        assert (r.n, r.n_missing) == (whole.n, whole.n_missing)
        assert abs(r.n_distinct - whole.n_distinct) <= 0.04 * whole.n_distinct
    plan = frequencies.approximate_summary(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan") == 1
    report = P.profile_report(df, approximate=True)
    rows = {(r.section, r.variable, r.name): r.value for r in report.collect()}
    assert abs(rows["metric", "m", "n_distinct"] - 1000) < 40 and ("metric", "m", "n_unique") not in rows
    assert rows["metric", "m", "mean"] == 499.5
