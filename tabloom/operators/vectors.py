"""Features as sparse vectors over a distributed dictionary: nothing comes to the driver.

A dictionary gives each value of a column a number from 0. Values are ordered by range
partitioning, the rows per partition and their running sum say where a partition begins,
and the place within the partition does the rest. Vectors are ``struct<size, indices,
values>`` with increasing indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch, written
from .features import term_counts
from .joins import split_join


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch | None = None) -> DataFrame:
    """The rows with their number from 0 in the given order, without one task that sees them all.

    Rows that agree in ``order`` stand beside each other in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id())
    # The id holds the partition above bit 33 and the place of the row below.
    placed = placed.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    stored = written(placed, "numbered", scratch)
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # A row per partition.
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def dictionary(df: DataFrame, column: str, by_frequency: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``(value, n, number)`` of the present values as text, in their own order or the most frequent first."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).where("value IS NOT NULL")
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("value")] if by_frequency else [F.col("value")]
    return numbered(counted, order, "number", scratch)


def _vector(size: int, indices: Column, values: Column) -> Column:
    return F.struct(F.lit(size).cast("bigint").alias("size"), indices.alias("indices"), values.alias("values"))


def one_hot_vector(df: DataFrame, column: str, output: str, words: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The rows with a vector of one 1 at the number of their value; of none for missing and unknown values.

    ``words`` is a dictionary made before, so that other rows get the same numbers. A column
    of any number of values works: the dictionary is joined, and frequent values are split.
    """
    known = written(dictionary(df, column, scratch=scratch) if words is None else words, "words", scratch)
    size = known.count()
    numbers = known.select(F.col("value").alias("_value"), F.col("number").alias("_number"))
    joined = split_join(df.withColumn("_value", F.col(f"`{column}`").cast("string")), numbers, "_value", "left", scratch)
    indices = F.array_compact(F.array("_number"))
    return joined.withColumn(output, _vector(size, indices, F.transform(indices, lambda _: F.lit(1.0)))).drop("_value", "_number")


def tfidf_vector(df: DataFrame, key: str, column: str, by_frequency: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``(key, vector)`` of every row: term weights ``tf * ln((N + 1) / (df + 1))`` at the numbers of the terms.

    The dictionary numbers all terms of the column, and its counts are the document
    frequencies. Rows without a term have a vector without entries. ``key`` must be unique;
    a row's vector holds its own terms only.
    """
    counts = written(term_counts(df, key, column), "terms", scratch)
    words = written(dictionary(counts, "term", by_frequency, scratch), "words", scratch)
    rows, size = df.count(), words.count()
    entries = words.select(F.col("value").alias("term"), "number", F.log((rows + 1) / (F.col("n") + 1)).alias("idf"))
    weighted = split_join(counts, entries, "term", scratch=scratch)
    weighted = weighted.select(key, F.struct("number", (F.col("tf") * F.col("idf")).alias("weight")).alias("_entry"))
    # Entries of a key lie in many tasks, one or two in each: they are moved as rows and gathered once.
    own = weighted.repartition(key).groupBy(key).agg(F.array_sort(F.collect_list("_entry")).alias("_entries"))
    entries = F.coalesce("_entries", F.expr("CAST(array() AS array<struct<number: bigint, weight: double>>)"))
    vector = _vector(size, F.transform(entries, lambda e: e["number"]), F.transform(entries, lambda e: e["weight"]))
    return df.select(key).join(own, key, "left").select(key, vector.alias("vector"))
