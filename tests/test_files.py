import os

import pytest
from pyspark.sql import functions as F

from tabloom.functions import names as N
from tabloom.operators import features as X
from tabloom.plans import ingest
from tabloom.plans.training import create_training_set, preview_training_set
from tabloom.session import scratch_path, scratch_table
from tabloom.sources import delimited as D, online, tables as T


def write(tmp_path, text, name="f.csv"):
    path = tmp_path / name
    path.write_text(text, newline="")
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("mark", [";", "\t", "|", ","])
def test_delimiters(spark, tmp_path, mark):
    path = write(tmp_path, f"a{mark}b\n1{mark}x\n2{mark}\n")
    df = D.read_csv(spark, path)
    assert df.dtypes == [("a", "string"), ("b", "string")]
    assert rows(df) == [("1", "x"), ("2", None)]


def test_first_delimiter_in_the_line_counts():
    assert D.delimiter_of("a;b,c") == ";"
    assert D.delimiter_of("alone") == ","


def test_quoted_line_break_and_doubled_quotes(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,"two\nlines, ""quoted"""\n2,"plain ""q"""\n')
    assert [spans for _, spans in D.file_headers(spark, path, ",").values()] == [True]
    assert rows(D.read_csv(spark, path)) == [("1", 'two\nlines, "quoted"'), ("2", 'plain "q"')]


def test_file_without_line_breaks_stays_splittable(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,"x ""y"""\n2,5" pipe\n3,\n')
    assert list(D.file_headers(spark, path, ",").values()) == [("a,b", False)]
    assert rows(D.read_csv(spark, path)) == [("1", 'x "y"'), ("2", '5" pipe'), ("3", None)]


def test_files_with_other_headers_join_by_name(spark, tmp_path):
    folder = tmp_path / "mixed [1] {x}"
    folder.mkdir()
    for name, text in {"1.csv": "a,b\n1,x\n", "2.csv": "b,a\ny,2\n", "3 3.csv": 'a,c\n3,"z\nz"\n', "4.csv": "a,b\n4,w\n", "5.csv": ""}.items():
        write(folder, text, name)
    df = D.read_csv(spark, D._literal(str(folder)))
    assert df.columns == ["a", "b", "c"]
    assert rows(df) == [("1", "x", None), ("2", "y", None), ("3", None, "z\nz"), ("4", "w", None)]


def test_long_rows_fail_or_are_dropped(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,x,EXTRA\n2,"q,q"\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        D.read_csv(spark, path).collect()
    with pytest.raises(Exception, match="more than 2 fields"):
        D.read_csv(spark, path).select("a").count()
    assert rows(D.read_csv(spark, path, long_rows="drop")) == [("2", "q,q")]
    with pytest.raises(ValueError):
        D.read_csv(spark, path, long_rows="cut")


def test_missing_markers(spark, tmp_path):
    path = write(tmp_path, "a,b,c\n1,NA,x\nn/a,2.5,null\n3,-nan,NAN\n")
    df = D.read_lenient(spark, path)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert rows(df) == [(1, None, "x"), (3, None, "NAN"), (None, 2.5, None)]
    assert D.read_lenient(spark, path, markers=()).dtypes[0] == ("a", "string")
    assert rows(D.read_training_set(spark, path, markers=["x"]))[0] == ("1", "NA", None)


def test_lenient_reader(spark, tmp_path):
    path = write(tmp_path, "a,b,c\n1,2.5,true\n2,,\n3\n4,5,false,9\n5,6,false,\n6,1e3,True\n")
    df = D.read_lenient(spark, path)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean")]
    assert rows(df) == [(1, 2.5, True), (2, None, None), (3, None, None), (6, 1000.0, True)]
    # The same rows are kept when only some columns are read.
    assert df.count() == 4 and df.select("a").count() == 4


def test_type_inference(spark):
    df = spark.createDataFrame(
        [("1", "1d", "99999999999999999999", None), ("-2", "2", "1", None)], "a string, b string, c string, d string"
    )
    assert D.infer_column_types(df).dtypes == [("a", "bigint"), ("b", "string"), ("c", "double"), ("d", "string")]


def test_text_table_with_white_space(spark, tmp_path):
    spaced = write(tmp_path, "a  b\n1   x\n\n2   y\n", "g.txt")
    assert rows(D.read_text_table(spark, spaced)) == [("1", "x"), ("2", "y")]
    like_header = write(tmp_path, 'a  b\n1 x\na  b\n  2 "y\n', "i.txt")
    assert rows(D.read_text_table(spark, like_header)) == [("1", "x"), ("2", '"y'), ("a", "b")]
    wide = write(tmp_path, "a b\n1 x y\n2 z\n", "j.txt")
    with pytest.raises(Exception, match="more than 2 fields"):
        D.read_text_table(spark, wide).collect()
    assert rows(D.read_text_table(spark, wide, long_rows="drop")) == [("2", "z")]
    commas = write(tmp_path, "a,b\n1,x\n", "h.txt")
    assert rows(D.read_text_table(spark, commas)) == [("1", "x")]


def test_online_rows(spark):
    df = spark.createDataFrame(
        [("k", "string", '[{"a": 1}, {"a": 2}]'), ("l", "list", '{"a": 3}'), ("h", "hash", '{"a": 4}'), ("e", "string", "[]")],
        "key string, kind string, payload string",
    )
    assert rows(online.json_rows(df, "kind", "payload", "a: bigint", ["key"])) == [("k", 1), ("k", 2), ("l", 3)]
    members = spark.createDataFrame([("a:b:c",), ("plain",)], "m string")
    assert rows(online.set_members(members, "m")) == [("a:b:c", "c"), ("plain", "plain")]
    assert online.payload_schema(df, "kind", "payload") == "a: BIGINT"


def test_online_schema_holds_all_payloads(spark):
    data = [("list", '{"a": 1}'), ("list", '{"a": 2.5, "b c": "x"}'), ("string", '[{"n": {"v": null, "VOID": [1]}}, {"a": null}]'), ("list", "broken"), ("hash", '{"z": 1}'), ("list", None)]
    df = spark.createDataFrame(data, "kind string, payload string")
    got = online.json_rows(df, "kind", "payload")
    assert set(got.columns) == {"a", "b c", "n"}
    values = rows(got.select(got["a"].cast("double"), "`b c`", "n.VOID"))
    assert (1.0, None, None) in values and (2.5, "x", None) in values and (None, None, [1]) in values
    with pytest.raises(ValueError):
        online.payload_schema(df.where("kind = 'hash'"), "kind", "payload")


def test_names(spark):
    assert N.clean_name_text("Total (USD)  x") == "total_usd_x"
    assert N.snake_text("camelCaseName2X") == "camel_case_name2_x"
    df = spark.createDataFrame([(1, 2)], "`a b` int, A_B int")
    with pytest.raises(ValueError):
        N.clean_column_names(df)
    assert N.clean_column_names(df, "suffix").columns == ["a_b", "a_b_2"]
    nested = spark.sql("select named_struct('innerName', 1) as outerName, array(named_struct('aB', 2)) as listOf")
    assert N.snake_case_schema(nested).schema.simpleString() == (
        "struct<outer_name:struct<inner_name:int>,list_of:array<struct<a_b:int>>>"
    )


def test_specs_are_read_as_json(spark):
    spec = '{"tableName": "t", "features": [{"featureId": "1", "name": "it is true", "partitionKey": true}]}'
    assert X.parse_spec(spec)["features"][0] == {"feature_id": "1", "name": "it is true", "partition_key": True}
    df = spark.createDataFrame([(spec,), ('{"features": [{"feature_id": "2", "name": "n"}]}',)], "s string")
    got = X.spec_features(df, "s").select("feature_id", "name", "partition_key")
    assert rows(got) == [("1", "it is true", True), ("2", "n", None)]


def test_preview_needs_a_ready_group(spark):
    df = spark.sql("select 1 as a, 'x' as b, 's' as fg_date")
    spec = {"table_name": "t", "status": "SUCCESS", "features": [{"name": "B"}]}
    assert X.preview_features(df, spec).columns == ["b", "fg_date"]
    with pytest.raises(ValueError):
        X.preview_features(df, {**spec, "status": "EMPTY"})


def test_labels_keep_unknown_codes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "x int, y string")
    labels = spark.createDataFrame([("x", 1, "one"), ("y", 1, "no")], "column string, code int, label string")
    assert rows(X.apply_value_labels(df, labels, ["x"])) == [("2", "b"), ("one", "a"), (None, "c")]


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("B c",), (None,)], "x string")
    got = X.one_hot(df, "x")
    assert got.columns == ["x", "x_b_c", "x_a"]
    assert rows(got) == [("B c", 1, 0), ("a", 0, 1), (None, 0, 0)]
    with pytest.raises(ValueError):
        X.categories(df, "x", at_most=1)
    many = spark.range(1500).selectExpr("string(id) AS x")
    assert len(X.categories(many, "x")) == 1500
    alike = spark.createDataFrame([("a b",), ("a_b",), ("A B",)], "c string")
    assert X.one_hot(alike, "c").columns == ["c", "c_a_b", "c_a_b_2", "c_a_b_3"]


def test_extraction_by_spec(spark):
    df = spark.createDataFrame([("a b a", "x"), ("a", "y"), (None, None)], "t string, k string")
    spec = {"features": [{"name": "t", "extraction_algorithm": "TF-IDF"}, {"name": "k", "extraction_algorithm": "OneHotLong"}]}
    got = X.extract_features(df, spec)
    assert got.columns == ["t", "k", "t_tfidf", "k_categories"]
    found = {r.t: (set(r.t_tfidf or {}), r.k_categories) for r in got.collect()}
    assert found == {"a b a": ({"a", "b"}, ["x"]), "a": ({"a"}, ["y"]), None: (set(), [])}
    keyed = X.extract_features(df, {**spec, "row_key": "K"})
    assert {r.t: set(r.t_tfidf or {}) for r in keyed.collect()} == {k: v for k, (v, _) in found.items()}
    with pytest.raises(ValueError, match="Word2Vec"):
        X.extract_features(df, {"features": [{"name": "t", "extraction_algorithm": "Word2Vec"}]})


def test_jobs_leave_no_scratch(spark, tmp_path):
    from tabloom.session import shared_root

    before = set(os.listdir(shared_root(spark)))
    path = write(tmp_path, "id,words\n1,a b\n2,b\n")
    spec = {"tableName": scratch_table("tf"), "dataType": "csv", "features": [{"name": "id"}, {"name": "words", "extractionAlgorithm": "TF-IDF"}]}
    done = ingest.create_feature_group(spark, spec, path, str(tmp_path / "tf"))
    assert spark.table(done["table_name"]).count() == 2
    assert set(os.listdir(shared_root(spark))) == before


def test_feature_group_life(spark, tmp_path):
    root, table = str(tmp_path / "w"), scratch_table("group")
    path = write(tmp_path, "Cust Id;Full Name;City;Unused\n1;Ann B.;Rome;x\n2;Bo;Oslo;y\n")
    spec = {
        "tableName": table,
        "dataType": "csv",
        "partitionKeys": ["City"],
        "features": [{"name": "Cust Id"}, {"name": "Full Name", "textCleaning": ["remove_punctuation"]}, {"name": "City"}],
    }
    ready = ingest.create_feature_group(spark, spec, path, root, F.lit("2024-05-06 07:08:09.123"))
    stored = spark.table(table)
    assert rows(stored.select("cust_id", "full_name", "city", "fg_date")) == [
        ("1", "Ann B ", "Rome", "2024-05-06T07:08:09.123Z"),
        ("2", "Bo", "Oslo", "2024-05-06T07:08:09.123Z"),
    ]
    assert X.preview_features(stored, ready).columns == ["cust_id", "full_name", "city", "fg_date"]
    assert T.table_format(spark, table) == "orc"
    more = spark.createDataFrame([("3", "Rome")], "cust_id string, city string")
    T.append_rows(spark, more, table)
    assert spark.table(table).where("city = 'Rome'").count() == 2
    assert spark.table(table).where("fg_date is null").count() == 0
    with pytest.raises(ValueError):
        T.append_rows(spark, more.withColumn("surplus", F.lit(1)), table)
    assert T.add_string_columns(spark, table, ["city", "note"]) == ["note"]
    size = T.table_sizes(spark, [table, "missing_table"]).first()
    on_disk = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if not f.startswith((".", "_"))]
    assert (size.n_files, size.total_bytes) == (len(on_disk), sum(map(os.path.getsize, on_disk)))
    where = create_training_set(spark, table, str(tmp_path), "9")
    assert where.endswith("training_dataset_9") and preview_training_set(spark, where).count() == 3
    T.drop_table(spark, table)
    assert not spark.catalog.tableExists(table)
    assert T.table_sizes(spark, [table]).count() == 0


def test_delete_only_below_the_root(spark, tmp_path):
    root = str(tmp_path / "sets")
    inside, outside = T.training_set_path(root, "1"), str(tmp_path / "other")
    for p in (inside, outside):
        spark.range(3).write.csv(p)
    assert not T.delete_training_set(spark, outside, root)
    assert not T.delete_training_set(spark, f"{root}/../other", root)
    assert not T.delete_training_set(spark, root, root)
    assert not T.delete_training_set(spark, None, root)
    assert os.path.exists(outside)
    assert T.delete_training_set(spark, inside, root) and not os.path.exists(inside)


def test_export_keeps_quotes_and_line_breaks(spark):
    df = spark.createDataFrame([(1, 'say "hi"\nthere, you'), (2, "a|b")], "id int, t string")
    for mark in (",", "|"):
        path = scratch_path(spark, "export")
        T.export_csv(df, path, mark)
        assert rows(D.read_csv(spark, path, mark)) == [("1", 'say "hi"\nthere, you'), ("2", "a|b")]


def test_fill_and_drop(spark):
    df = spark.sql("select * from values (1, cast('NaN' as double), 'a', true), (null, 2.0, null, null) t(a, b, c, d)")
    assert rows(X.fill_zero(df)) == [(0, 2.0, "0", False), (1, 0.0, "a", True)]
    assert rows(X.drop_null_rows(df.selectExpr("a", "c"))) == [(1, "a")]
