"""Files of one folder with any number of headers are read by one plan, with the rows that the csv module gives."""

import csv
import random

import pytest

from tabloom.sources import delimited as D


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fill(folder, files, end="\n"):
    for name, made in files.items():
        with open(folder / name, "w", newline="") as out:
            csv.writer(out, lineterminator=end).writerows(made)


def made(n_files, values, seed=3):
    rng = random.Random(seed)
    files = {}
    for f in range(n_files):
        names = rng.sample([f"k{i}" for i in range(12)], rng.randint(1, 6)) + [f"only{f}"]
        files[f"{f:03}.csv"] = [names] + [[rng.choice(values) for _ in names] for _ in range(rng.randint(1, 5))]
    return files


def wanted(files, columns):
    out = []
    for (head, *body) in files.values():
        for row in body:
            by = dict(zip(head, row))
            out.append(tuple(by.get(c) or None for c in columns))
    return sorted(out, key=repr)


@pytest.mark.parametrize("values", [["1", "x y", "a,b", 'say ""', "é"], ["1", "two\nlines", 'q"q', "z,\n\nz"]], ids=["lines", "spanning"])
def test_rows_of_many_headers(spark, tmp_path, values):
    files = made(25, values)
    fill(tmp_path, files)
    df = D.read_csv(spark, str(tmp_path))
    first = files["000.csv"][0]
    assert df.columns[: len(first)] == first and len(df.columns) == len({n for made in files.values() for n in made[0]})
    assert rows(df) == wanted(files, df.columns)
    narrow = df.select("only7", "k3")
    assert rows(narrow) == wanted(files, ["only7", "k3"])


def test_no_branch_for_a_header(spark, tmp_path):
    fill(tmp_path, made(25, ["1", "a,b"]))
    plan = D.read_csv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count(" csv") == 1


def test_long_and_short_rows_by_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n1,x\n2\n\n3,y,LONG\n4,"p,q"\n5,\n')
    (tmp_path / "2.csv").write_text("c,b,a\n7,8,9\n6,6,6,\n")
    path = str(tmp_path)
    want = [("1", "x", None), ("2", None, None), ("4", "p,q", None), ("5", None, None), ("9", "8", "7")]
    df = D.read_csv(spark, path, long_rows="drop")
    assert df.columns == ["a", "b", "c"] and rows(df) == sorted(want, key=repr)
    assert df.count() == 5
    told = sorted((r.file.rsplit("/", 1)[1], r.row, r.n_fields, r.n_columns) for r in D.rejected_rows(spark, path).collect())
    assert told == [("1.csv", "3,y,LONG", 3, 2), ("2.csv", "6,6,6,", 4, 3)]
    for use in (lambda d: d.collect(), lambda d: d.select("a").count()):
        with pytest.raises(Exception, match="more than [23] fields"):
            use(D.read_csv(spark, path))
    with pytest.raises(ValueError):
        D.read_csv(spark, path, long_rows="cut")


def test_names_that_differ_by_case_and_repeat(spark, tmp_path):
    fill(tmp_path, {"1.csv": [["A", "x"], ["1", "2"]], "2.csv": [["a", "Y"], ["3", "4"]], "3.csv": [["d", "d", ""], ["5", "6", "7"]]})
    df = D.read_csv(spark, str(tmp_path))
    assert df.columns == ["A", "x", "Y", "d0", "d1", "_c2"]
    assert rows(df) == sorted([("1", "2", None, None, None, None), ("3", None, "4", None, None, None), (None, None, None, "5", "6", "7")], key=repr)


def test_whole_parser_for_spanning_files_alone(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n1,"x"y\n2,"p\nq"\n3\n4,5,6\n7,8,9,10\n')
    (tmp_path / "2.csv").write_text("b,c\n5,6\n")
    df = D.read_csv(spark, str(tmp_path), long_rows="drop")
    alone = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "1.csv")).where("a in ('1', '2', '3')")
    assert rows(df) == sorted([(r.a, r.b, None) for r in alone.collect()] + [(None, "5", "6")], key=repr)
    assert [(r.row, r.n_fields) for r in D.rejected_rows(spark, str(tmp_path)).orderBy("n_fields").collect()] == [("4,5,6", 3), ("7,8,9,10", 4)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_said_by_the_caller(spark, tmp_path, multi_line):
    fill(tmp_path, made(4, ["1", "a,b"], seed=5))
    df = D.read_csv(spark, str(tmp_path), multi_line=multi_line)
    assert rows(df) == wanted(made(4, ["1", "a,b"], seed=5), df.columns)


def test_headers_that_differ_in_a_folder_with_an_empty_file(spark, tmp_path):
    fill(tmp_path, {"1.csv": [["a"], ["1"]], "2.csv": [["b"]], "3.csv": []})
    df = D.read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b"] and rows(df) == [("1", None)]
