"""Lookups and pages that read only the files that can hold them.

``save_sorted_table`` writes a table whose files hold one range of a key each, sorted, with
ORC Bloom filters on the key. ``file_ranges`` notes the least and the largest key and the
rows of every file; a lookup then opens the files whose range holds the key, and a page
those that its rows can lie in. Ranges may overlap, as they do after appends: results stay
right, only more files are opened. Files that the ranges do not know, or that are gone,
are an error, since a row could be missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import describe, table_format


def save_sorted_table(df: DataFrame, table: str, path: str, key: str, files: int | None = None) -> None:
    """Write an external ORC table in ranges of ``key``, sorted, with a Bloom filter on it."""
    column = F.col(f"`{key}`")
    rows = df.repartitionByRange(files, column) if files else df.repartitionByRange(column)
    writer = rows.sortWithinPartitions(column).write.format("orc").mode("overwrite").option("path", path)
    writer.option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01").saveAsTable(table)


def file_ranges(spark: SparkSession, table: str, key: str) -> DataFrame:
    """``(path, least, most, n, n_null)`` for each file, from one scan of the key column."""
    rows = spark.table(table).select(F.col(f"`{key}`").alias("k"), F.col("_metadata.file_path").alias("path"))
    return rows.groupBy("path").agg(
        F.min("k").alias("least"), F.max("k").alias("most"), F.count("k").alias("n"), F.count_if(F.col("k").isNull()).alias("n_null")
    )


def _checked(spark: SparkSession, table: str, ranges: DataFrame) -> None:
    """Compare the files that the ranges know with those of the table, by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(describe(spark, table)["Location"])
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    known, there = ranges.select(name), files.where("length > 0").select(name)
    gone = known.join(there, "name", "left_anti").count()
    if gone:
        raise ValueError(f"{gone} files of {table} are gone: note its ranges again")
    new = there.join(known, "name", "left_anti").count()
    # A file without rows has no range.
    if new and spark.table(table).select(F.regexp_extract("_metadata.file_name", "[^/]+$", 0).alias("name")).join(known, "name", "left_anti").limit(1).count():
        raise ValueError(f"{new} files of {table} are not in its ranges: note them again")


def _read(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """The rows of some of the table's files."""
    schema = spark.table(table).schema
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(table_format(spark, table)).schema(schema).option("basePath", describe(spark, table)["Location"])
    return reader.load(paths)


def lookup(spark: SparkSession, table: str, ranges: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with a key; only files whose range holds it are opened, and in these the Bloom filter and the order help."""
    _checked(spark, table, ranges)
    held = ranges.where(F.lit(value).between(F.col("least"), F.col("most")))
    return _read(spark, table, [r.path for r in held.select("path").collect()]).where(F.col(f"`{key}`") == F.lit(value))


def page_files(ranges: DataFrame, after: object | None, limit: int) -> list[str]:
    """The files that can hold the ``limit`` rows that follow a key.

    Files that begin after the key are taken in order until they hold enough rows; whatever
    begins up to the end of the last of these can hold a row of the page.
    """
    left = ranges.where("n > 0") if after is None else ranges.where(F.col("most") > F.lit(after))
    whole = left if after is None else left.where(F.col("least") > F.lit(after))
    rows, last = 0, None
    for r in whole.select("most", "n").orderBy("most").toLocalIterator():
        rows, last = rows + r.n, r.most
        if rows >= limit:
            return [p.path for p in left.where(F.col("least") <= F.lit(last)).select("path").collect()]
    return [p.path for p in left.select("path").collect()]


def keyset_page(spark: SparkSession, table: str, ranges: DataFrame, key: str, after: object | None = None, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows after a key, in order of the key; the first page without one.

    The key must be unique, and rows without one are on no page. However far a page lies
    from the first, no row before it is read, unlike with an offset.
    """
    _checked(spark, table, ranges)
    rows = _read(spark, table, page_files(ranges, after, limit))
    column = F.col(f"`{key}`")
    wanted = rows.where(column.isNotNull()) if after is None else rows.where(column > F.lit(after))
    return wanted.orderBy(column).limit(limit)
