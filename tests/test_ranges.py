"""Lookups and pages of stored tables open the files that can hold them, and no others."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import features as X
from tabloom.session import scratch_path, scratch_table
from tabloom.sources import delimited as D, ranges as R
from tabloom.sources.tables import append_rows


@pytest.fixture
def table(spark):
    name = scratch_table("sorted")
    df = spark.range(5000).selectExpr("id * 3 AS k", "concat('v', id) AS v", "'x' AS fg_date")
    R.save_sorted_table(df, name, scratch_path(spark, name), "k", 10)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_ranges_and_lookups(spark, table):
    ranges = R.file_ranges(spark, table, "k")
    found = sorted((r.least, r.most, r.n) for r in ranges.collect())
    assert len(found) == 10 and sum(n for *_, n in found) == 5000
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    hit = R.lookup(spark, table, ranges, "k", 3000)
    assert [r.v for r in hit.collect()] == ["v1000"] and len(hit.inputFiles()) == 1
    assert R.lookup(spark, table, ranges, "k", 3001).collect() == []
    assert R.lookup(spark, table, ranges, "k", -7).collect() == []


def test_pages(spark, table):
    ranges = R.file_ranges(spark, table, "k")
    seen, after, opened = [], None, []
    while True:
        page = R.keyset_page(spark, table, ranges, "k", after, 700)
        opened.append(len(R.page_files(ranges, after, 700)))
        rows = [r.k for r in page.collect()]
        if not rows:
            break
        seen += rows
        after = rows[-1]
    assert seen == [3 * i for i in range(5000)] and max(opened) <= 4 and opened[0] == 2
    assert R.keyset_page(spark, table, ranges, "k", 14990, 100).count() == 3


def test_overlapping_files_and_files_not_noted(spark, table):
    ranges = R.file_ranges(spark, table, "k")
    noted = spark.createDataFrame(ranges.collect(), ranges.schema)
    append_rows(spark, spark.range(0, 15000, 1000).selectExpr("id + 1 AS k", "'new' AS v").union(spark.sql("SELECT NULL, 'none'")), table)
    for call in (lambda: R.lookup(spark, table, noted, "k", 3), lambda: R.keyset_page(spark, table, noted, "k")):
        with pytest.raises(ValueError, match="not in its ranges"):
            call()
    again = R.file_ranges(spark, table, "k")
    want = sorted([3 * i for i in range(5000)] + [1000 * i + 1 for i in range(15)])
    for after in (None, 2000, 14000):
        got = [r.k for r in R.keyset_page(spark, table, again, "k", after, 400).collect()]
        assert got == [k for k in want if after is None or k > after][:400]
    assert [r.v for r in R.lookup(spark, table, again, "k", 4001).collect()] == ["new"]


def test_rejected_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n1,2,3\n"a,b",c\n"a,b",c,d,e\n7\n')
    (tmp_path / "b.csv").write_text("y\n5\n6,7\n")
    path = str(tmp_path)
    got = sorted((r.file.rsplit("/", 1)[1], r.row, r.n_fields, r.n_columns) for r in D.rejected_rows(spark, path).collect())
    assert got == [("a.csv", '"a,b",c,d,e', 4, 2), ("a.csv", "1,2,3", 3, 2), ("b.csv", "6,7", 2, 1)]
    assert D.read_csv(spark, path, long_rows="drop").count() + len(got) == 7
    clean = tmp_path / "clean.csv"
    clean.write_text("a,b\n1,2\n")
    assert D.rejected_rows(spark, str(clean)).collect() == []


def test_too_many_categories(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_CATEGORIES", 3)
    df = spark.range(4).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="over 3 values"):
        X.one_hot(df, "v")
    assert len(X.one_hot(df.where("v < 3"), "v").columns) == 4
