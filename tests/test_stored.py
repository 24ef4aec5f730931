"""Changes to stored tables and profiles from stored states: what is read, what is written, what comes out."""

import os

import pytest
from pyspark.sql import functions as F

from tabloom.operators import catalog as C, features as X, profile as P, vectors as V
from tabloom.operators.profile import states as T
from tabloom.session import scratch_path, scratch_table
from tabloom.sources import stored as S
from tabloom.sources.tables import append_rows, save_feature_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(spark, path):
    return {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()}


@pytest.fixture
def stored(spark):
    """A table of 100 keys in ten partitions, and its folder."""
    table = scratch_table("catalog")
    path = scratch_path(spark, table)
    df = spark.range(100).selectExpr("id", "1 AS status", "CAST(IF(id < 10, NULL, id % 10) AS INT) AS part")
    df.write.format("parquet").partitionBy("part").option("path", path).saveAsTable(table)
    yield table, path
    spark.sql(f"DROP TABLE {table}")


def test_only_touched_partitions_are_written(spark, stored):
    table, path = stored
    before = files(spark, path)
    updates = spark.createDataFrame([(13, 2), (53, None), (27, 0), (3, 3), (1000, 3)], "id bigint, new_status int")
    assert S.update_status(spark, table, "id", "status", updates) == 3
    after = files(spark, path)
    gone = before - after
    assert {p.split("part=")[1].split("/")[0] for p in gone} == {"3", "7", "__HIVE_DEFAULT_PARTITION__"}
    assert len(before & after) >= 8
    changed = {r.id: r.status for r in spark.table(table).collect()}
    assert len(changed) == 100 and {k: v for k, v in changed.items() if v != 1} == {13: 2, 53: None, 27: 0, 3: 3}
    assert S.update_status(spark, table, "id", "status", updates.where("id = 1000")) == 0
    assert files(spark, path) == after
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_failed_change_leaves_the_table(spark, stored):
    table, path = stored
    before = files(spark, path)
    with pytest.raises(Exception, match="not a status"):
        S.update_status(spark, table, "id", "status", spark.createDataFrame([(13, 9)], "id bigint, new_status int"))
    with pytest.raises(ValueError, match="other partitions"):
        S.rewrite_partitions(spark, table, [(3,)], lambda df: df.withColumn("part", F.lit(4)))
    assert files(spark, path) == before


def test_upsert_into_partitions(spark, stored):
    table, path = stored
    changes = spark.createDataFrame([(13, 0, 3), (200, 2, 3), (201, 2, 77), (None, 1, 1)], "id bigint, status int, part int")
    assert S.upsert_rows(spark, table, changes, "id") == 2
    got = {r.id: (r.status, r.part) for r in spark.table(table).collect()}
    assert (got[13], got[200], got[201], len(got)) == ((0, 3), (2, 3), (2, 77), 102)
    with pytest.raises(ValueError, match="partition columns"):
        S.upsert_rows(spark, table, changes.select(F.lit(999).alias("id"), "status"), "id")


def test_keyed_table(spark):
    table = scratch_table("privacy")
    path = scratch_path(spark, table)
    S.save_keyed_table(spark.range(400).selectExpr("id AS doc", "'old' AS result"), table, path, "doc", 32)
    before = files(spark, path)
    changes = spark.createDataFrame([(5, "a", None), (5, "b", 1), (1000, "new", None)], "doc bigint, result string, run int")
    assert S.upsert_rows(spark, table, changes, "doc", order="run") <= 2
    got = {r.doc: r.result for r in spark.table(table).collect()}
    assert (got[5], got[1000], got[6], len(got)) == ("b", "new", "old", 401)
    assert len(before & files(spark, path)) >= len(before) - 2
    assert S.touched_partitions(spark, table, changes, "doc") == [
        tuple(r) for r in spark.table(table).where("doc IN (5, 1000)").select(S.KEY_PART).distinct().collect()
    ] or S.keyed_parts(spark, table, "doc") == 32
    assert spark.table(table).where(F.col(S.KEY_PART) != S.key_part("doc", 32)).isEmpty()


def test_table_without_partitions(spark):
    table = scratch_table("flat")
    spark.range(3).write.option("path", scratch_path(spark, table)).saveAsTable(table)
    with pytest.raises(ValueError, match="no partitions"):
        S.update_status(spark, table, "id", "id", spark.createDataFrame([(1, 2)], "id bigint, new_status int"))


def test_orders_that_are_null(spark):
    table = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    changes = spark.createDataFrame([(1, "lost", None), (1, "won", 5), (2, "only", None), (3, "a", 1), (3, "b", 1)], "id int, v string, at int")
    got = [rows(C.upsert(table, changes.repartition(n), "id", order="at")) for n in (1, 3)]
    assert got[0] == got[1] and got[0][:2] == [(1, "won"), (2, "only")] and len(got[0]) == 3


def test_repeated_keys_and_codes_are_errors(spark):
    table = spark.createDataFrame([(1, 0), (2, 1)], "id int, status int")
    with pytest.raises(Exception, match="changed more than once"):
        C.set_status(table, "id", "status", spark.createDataFrame([(1, 2), (1, 2)], "id int, new_status int")).collect()
    labels = spark.createDataFrame([("id", "1", "one"), ("id", "1", "one"), ("id", "2", "two")], "column string, code string, label string")
    assert rows(X.apply_value_labels(table, labels, ["id"])) == [("one", 0), ("two", 1)]
    for other in ("uno", None):
        with pytest.raises(Exception, match="two labels in id for code 1"):
            X.apply_value_labels(table, labels.union(spark.createDataFrame([("id", "1", other)], labels.schema)), ["id"]).collect()


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1e-6) or a != a and b != b))


@pytest.fixture
def growing(spark):
    """A feature table that grew by three appends, one of them of nulls; the profile states; how many files each refresh read."""
    table = scratch_table("growing")
    states = scratch_path(spark, "states")
    parts = [
        "id * id AS x, double(id) / 7 AS y, 'a' AS s, CAST(NULL AS INT) AS z, true AS b",
        "id - 50 AS x, double('NaN') AS y, string(id) AS s, 3 AS z, false AS b",
        "CAST(NULL AS BIGINT) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS STRING) AS s, CAST(NULL AS INT) AS z, CAST(NULL AS BOOLEAN) AS b",
        "7 AS x, 1e9 AS y, 'a' AS s, 3 AS z, true AS b",
    ]
    read = []
    for i, part in enumerate(parts):
        df = spark.range(120 + i).selectExpr(*part.split(", "))
        if i:
            append_rows(spark, df, table)
        else:
            save_feature_table(df, table, scratch_path(spark, table))
        read.append(P.refresh_states(spark, table, states))
    yield table, states, read
    spark.sql(f"DROP TABLE {table}")


def test_states_merge_to_the_whole_profile(spark, growing):
    table, states, read = growing
    held = P.state_sections(P.stored_states(spark, table, states))
    want = {r.variable: r for r in P.numeric_profile(spark.table(table)).collect()}
    got = {r.variable: r for r in held["numeric"].collect()}
    assert want.keys() == got.keys()
    for c in want:
        assert all(close(a, b) for a, b in zip(want[c], got[c])), (want[c], got[c])
    counts = {r.variable: r for r in P.distinct_counts(spark.table(table)).collect()}
    for r in held["columns"].collect():
        whole = counts[r.variable]
        assert (r.n, r.n_missing) == (whole.n, whole.n_missing) and abs(r.n_distinct - whole.n_distinct) <= 0.03 * whole.n_distinct
    top = {(r.variable, r["rank"]): (r.value, r["count"], r.exact) for r in held["top"].collect()}
    assert top["s", 1] == ("a", 243, True) and top["x", 1] == ("7", 124, True)
    quantiles = {r.variable: r for r in held["quantiles"].collect()}
    assert quantiles["z"].q50 == 3.0 and -50 <= quantiles["x"].q25 <= 119**2


def test_old_files_are_not_read(spark, growing):
    table, states, read = growing
    assert read[0] >= 1 and P.refresh_states(spark, table, states) == 0
    location = T.describe(spark, table)["Location"].removeprefix("file:")
    old = [os.path.join(location, f) for f in os.listdir(location) if f.startswith("part-")]
    kept = {}
    for f in old:  # same length and time, no content: reading one would fail
        at = os.stat(f)
        kept[f] = open(f, "rb").read()
        with open(f, "wb") as out:
            out.write(b"\0" * at.st_size)
        os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    for f in os.listdir(location):
        if f.endswith(".crc"):
            os.unlink(os.path.join(location, f))
    append_rows(spark, spark.sql("SELECT 99999L AS x, 0D AS y, 'new' AS s, 1 AS z, false AS b"), table)
    assert P.refresh_states(spark, table, states) == 1
    got = {r.variable: r for r in P.state_sections(P.stored_states(spark, table, states))["numeric"].collect()}
    assert got["x"].max == 99999 and got["x"].n == 120 + 121 + 122 + 123 + 1


def test_replaced_files_are_read_again(spark, growing):
    table, states, _ = growing
    append_rows(spark, spark.sql("SELECT 5L AS x, 0D AS y, 'new' AS s, 1 AS z, false AS b"), table)
    with pytest.raises(ValueError, match="no states yet"):
        P.stored_states(spark, table, states)
    P.refresh_states(spark, table, states)
    rows_now = spark.table(table).where("z IS NOT NULL").drop("fg_date").collect()
    df = spark.createDataFrame(rows_now, spark.table(table).drop("fg_date").schema)
    df.select("*", F.lit("x").alias("fg_date")).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
    assert P.refresh_states(spark, table, states) > 0
    want = {r.variable: r for r in P.numeric_profile(spark.table(table)).collect()}
    got = {r.variable: r for r in P.state_sections(P.stored_states(spark, table, states))["numeric"].collect()}
    assert got["x"].n == want["x"].n and all(close(a, b) for a, b in zip(want["x"], got["x"]))


def test_grouped_deviations_and_histograms(spark):
    sql = "SELECT IF(id < 900, 'big', IF(id < 990, CAST(NULL AS STRING), string(id))) AS g, IF(id % 10 = 0, NULL, id * id % 101) AS v, 4 AS c FROM range(1000)"
    df = spark.sql(sql)
    got = {(r.g, r.variable): (r.median, r.mad) for r in P.grouped_median_absolute_deviation(df, ["g"]).collect()}
    bins = {}
    for r in P.grouped_histogram(df, ["g"], bins=8).collect():
        bins.setdefault((r.g, r.variable), {})[r.bin] = (r.lower, r.upper, r["count"])
    groups = {r.g for r in df.select("g").distinct().collect()}
    for g in groups:
        some = df.where(F.col("g").eqNullSafe(F.lit(g))).select("v", "c")
        for r in P.median_absolute_deviation(some).collect():
            assert got.get((g, r.variable), (None, None)) == (r.median, r.mad)
        want = {}
        for r in P.histogram(some, bins=8).collect():
            want.setdefault((g, r.variable), {})[r.bin] = (r.lower, r.upper, r["count"])
        assert {k: v for k, v in bins.items() if k[0] == g} == want


def test_vectors(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (4, ""), (5, "c É")], "id int, t string")
    got = {r.id: r.vector for r in V.tfidf_vector(df, "id", "t").collect()}
    want = {(r.id, r.term): r.tfidf for r in X.tfidf(df, "id", "t").collect()}
    numbers = {r.value: r.number for r in V.dictionary(X.term_counts(df, "id", "t"), "term").collect()}
    assert sorted(numbers, key=numbers.get) == ["a", "b", "c", "é"] and sorted(numbers.values()) == [0, 1, 2, 3]
    assert {k: (v.size, v.indices) for k, v in got.items()} == {1: (4, [0, 1]), 2: (4, [0]), 3: (4, []), 4: (4, []), 5: (4, [2, 3])}
    assert all(abs(got[i]["values"][got[i].indices.index(numbers[t])] - w) < 1e-12 for (i, t), w in want.items())
    by_count = {r.value: r.number for r in V.dictionary(df.select(F.explode(F.split("t", " ")).alias("w")), "w", by_frequency=True).collect()}
    assert [by_count[w] for w in ("a", "b")] == [0, 1]


def test_one_hot_of_a_million_values(spark):
    df = spark.range(1_000_000, numPartitions=8).selectExpr("id", "IF(id % 3 = 0, 'usual', string(id)) AS v")
    out = V.one_hot_vector(df, "v", "vector")
    sums = out.agg(F.count("id"), F.count_distinct(F.col("vector.indices")[0]), F.min(F.col("vector.indices")[0]), F.max(F.col("vector.indices")[0]), F.max("vector.size")).first()
    n = 1_000_000 - 333_334 + 1
    assert tuple(sums) == (1_000_000, n, 0, n - 1, n)
    words = V.dictionary(df.where("id < 10"), "v")
    unknown = V.one_hot_vector(df.where("id IN (1, 3, 77)"), "v", "vector", words).collect()
    assert sorted((r.id, len(r.vector.indices), r.vector.size) for r in unknown) == [(1, 1, 7), (3, 1, 7), (77, 0, 7)]
    none = V.one_hot_vector(df.limit(0), "v", "vector").collect()
    assert none == []
