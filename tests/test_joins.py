import pytest
from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.session import Scratch, scratch_scope, shared_root


def tables(spark):
    """One key holds a third of the rows, some are null, some have no match."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 10)
    many = spark.range(2000).select(key.alias("k"), "id")
    one = spark.range(8).where("id <> 4").select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return many, one.unionByName(spark.sql("select 1L as k, -1L as v"))


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_split_join(spark, how):
    many, one = tables(spark)
    assert rows(J.split_join(many, one, "k", how)) == rows(many.join(one, "k", how))


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_many_frequent_keys_are_split(spark, how):
    """1500 keys of 20 rows each and one of a third of all; the other side is an aggregate."""
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1500)
        many = J.written(spark.range(45000).repartition(6).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("x")), "many")
        one = many.where("k < 0 OR k >= 1400").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = J.split_join(many, one, "k", how)
        placed = joined.withColumn("p", F.spark_partition_id())
        spread = {r["p"]: r["n"] for r in placed.groupBy("p").agg(F.count_if(F.col("k") < 0).alias("n")).collect()}
        if how == "inner":
            assert sum(spread.values()) == 15000 and max(spread.values()) < 0.8 * 15000
        else:
            assert joined.count() == 30000 - many.where("k >= 1400").count()
    finally:
        for k in SKEW:
            spark.conf.unset(k)


def test_scratch_is_removed_by_its_owner(spark, tmp_path):
    import os

    def listed():
        return {f for f in os.listdir(shared_root(spark)) if f.startswith("mine-")}

    with Scratch(spark) as scratch:
        a, b = (scratch.write(spark.range(10), "mine") for _ in range(2))
        assert len(listed()) == 2 and a.count() + b.count() == 20
        scratch.drop(a)
        assert len(listed()) == 1 and b.count() == 10
    assert listed() == set()
    kept = Scratch(spark)
    with scratch_scope(spark):
        part = J.written(spark.range(5), "mine")
        os.makedirs(Scratch(spark).path("mine"))
        whole = kept.write(part.selectExpr("id + 1 AS id"), "mine")
        assert len(listed()) == 3
    assert len(listed()) == 1 and whole.count() == 5
    kept.close()
    assert listed() == set()
