import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, ids=None):
    """Documents with the given texts; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def clash(spark):
    """Documents with further columns whose names operators might use inside."""

    def add(df):
        names = "fp n u v id component mask value lengths words row c0 c1 _lang _text _kept _n_words _toxic_score _spans _base _row"
        for name in [*names.split(), "a b"]:
            df = df.withColumn(name, F.lit(1))
        return df

    return add
