"""Files whose records span lines are read in splits, with the rows of the whole-file parser."""

import csv
import random

import pytest

from tabloom.sources import delimited as D


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "1", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(seed, n, end="\n"):
    rng = random.Random(seed)
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", "é", "", " ", "x" * 20, '","', '"\n"', "1.5"]
    return [["k", "text", "more"]] + [[str(i), "".join(rng.choices(pieces, k=rng.randint(0, 7))) or "z", rng.choice(["m", 'q"q', "1\n2", "end"])] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_in_many_splits(spark, tmp_path, small_splits, end):
    want = []
    for f in range(3):
        made = table(f, 200)
        want += made[1:]
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator=end).writerows(made)
    df = D.read_csv(spark, str(tmp_path))
    assert rows(df) == sorted(map(tuple, want), key=repr)
    records = D._records(spark, str(tmp_path), ",")
    assert records is not None and records.select("file").distinct().count() == 3
    splits = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    assert splits > 20


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, of a field" for i in range(200))
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["a", "b"], ["1", long], ["2", "x"], ["3", long]])
    assert rows(D.read_csv(spark, str(tmp_path))) == [("1", long), ("2", "x"), ("3", long)]


def test_long_and_short_rows_and_blank_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n\n2\n3,"p\n\nq",extra,"more\n"\n"4",5\n')
    path = str(tmp_path)
    assert rows(D.read_csv(spark, path, long_rows="drop")) == rows(spark.createDataFrame([("1", "x\ny"), ("2", None), ("4", "5")], "a string, b string"))
    assert [(r.row, r.n_fields) for r in D.rejected_rows(spark, path).collect()] == [('3,"p\n\nq",extra,"more\n"', 4)]
    with pytest.raises(Exception, match="more than 2 fields"):
        D.read_csv(spark, path).collect()


def test_files_that_need_the_whole_parser(spark, tmp_path):
    for name, text in {"open": 'a,b\n1,"never\nclosed\n', "junk": 'a,b\n1,"x"y\n2,"p\nq"\n'}.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.csv").write_text(text)
        assert D._records(spark, str(folder), ",") is None
        want = spark.read.options(header=True, escape='"', multiLine=True).csv(str(folder))
        assert rows(D.read_csv(spark, str(folder))) == rows(want)


def test_header_that_spans_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('"a\nb",c\n1,"2\n3"\n')
    df = D.read_csv(spark, str(tmp_path))
    assert df.columns == ["a\nb", "c"] and rows(df) == [("1", "2\n3")]
