"""Changes to stored tables: only partitions that hold a changed key are read whole and written again.

A table with partitions is changed by dynamic partition overwrite: the new files of a
partition are written aside and then take the place of the old ones, and files of other
partitions stay as they are. ``save_keyed_table`` makes a table whose partitions follow
from a hash of the key, so that the partitions of any key, new ones included, are known
without a look at the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.catalog import set_status, upsert
from ..session import Scratch

# The partition column of keyed tables, and the properties that say what it was made from.
KEY_PART = "key_part"
_KEY, _PARTS = "tabloom.key", "tabloom.parts"


def key_part(key: Column | str, parts: int) -> Column:
    """The partition of a key: a hash of its text."""
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def save_keyed_table(df: DataFrame, table: str, path: str, key: str, parts: int, file_format: str = "orc") -> None:
    """Write the rows as an external table in ``parts`` partitions by a hash of ``key``.

    As many partitions as make each of them one file of good size: a change reads and writes
    whole partitions.
    """
    spark = df.sparkSession
    rows = df.withColumn(KEY_PART, key_part(key, parts)).hint("rebalance", F.col(KEY_PART))
    rows.write.format(file_format).mode("overwrite").option("path", path).partitionBy(KEY_PART).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_KEY}' = '{key}', '{_PARTS}' = '{parts}')")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def keyed_parts(spark: SparkSession, table: str, key: str) -> int | None:
    """Partitions of a table that ``save_keyed_table`` made for this key; None for other tables."""
    said = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return int(said[_PARTS]) if said.get(_KEY) == key and _PARTS in said else None


def touched_partitions(spark: SparkSession, table: str, keys: DataFrame, key: str) -> list[tuple]:
    """The partitions that hold one of the keys, at most as many as the table has.

    In a keyed table they follow from the keys; in others the key column is read and joined.
    """
    parts = keyed_parts(spark, table, key)
    if parts is not None:
        found = keys.where(F.col(key).isNotNull()).select(key_part(key, parts).alias(KEY_PART))
    else:
        columns = partition_columns(spark, table)
        if not columns:
            raise ValueError(f"{table} has no partitions: every change would write it whole")
        found = spark.table(table).join(keys.select(key), key, "left_semi").select(*columns)
    return [tuple(r) for r in found.distinct().collect()]


def _in_partitions(columns: list[str], touched: list[tuple]) -> Column:
    """A condition on partition columns alone, so that other partitions are not listed or read."""
    if len(columns) == 1:
        values = [t[0] for t in touched if t[0] is not None]
        known = F.col(columns[0]).isin(values)
        return known | F.col(columns[0]).isNull() if len(values) < len(touched) else known
    some = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, t)]) for t in touched]
    return reduce(lambda a, b: a | b, some)


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rewrite_partitions(spark: SparkSession, table: str, touched: list[tuple], change: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the rows of some partitions by ``change`` of them; returns how many partitions were written.

    What ``change`` returns must stay in these partitions. It is written to scratch first,
    so a failure while it is computed leaves the table as it was.
    """
    if not touched:
        return 0
    columns = partition_columns(spark, table)
    target = spark.table(table)
    with Scratch(spark) as scratch:
        rows = change(target.where(_in_partitions(columns, touched)))
        rows = scratch.write(rows.select(*[F.col(f"`{c}`") for c in target.columns]), "changed")
        if not rows.where(~_in_partitions(columns, touched)).isEmpty():
            raise ValueError(f"a change would move rows of {table} to other partitions")
        with _dynamic_overwrite(spark):
            rows.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
    return len(touched)


def update_status(spark: SparkSession, table: str, key: str, status: str, updates: DataFrame) -> int:
    """``set_status`` on a stored table; keys it does not have change nothing. Returns the partitions written."""
    with Scratch(spark) as scratch:
        updates = scratch.write(updates.select(key, "new_status"), "updates")
        touched = touched_partitions(spark, table, updates, key)
        return rewrite_partitions(spark, table, touched, lambda rows: set_status(rows, key, status, updates))


def upsert_rows(spark: SparkSession, table: str, changes: DataFrame, key: str, order: str | None = None) -> int:
    """``upsert`` on a stored table; returns the partitions written.

    New keys of a table that is not keyed go to the partition that their row names, so
    ``changes`` must have the partition columns if it has new keys; those of known keys
    must not change. Changes without a key are left out.
    """
    columns = partition_columns(spark, table)
    parts = keyed_parts(spark, table, key)
    with Scratch(spark) as scratch:
        changes = scratch.write(changes.where(F.col(key).isNotNull()), "changes")
        touched = touched_partitions(spark, table, changes, key)
        if parts is None:
            known = spark.table(table).select(key)
            new = changes.join(known, key, "left_anti")
            if not new.isEmpty():
                absent = [c for c in columns if c not in changes.columns]
                if absent:
                    raise ValueError(f"new keys need the partition columns {absent}")
                touched = list({*touched, *(tuple(r) for r in new.select(*columns).distinct().collect())})
            return rewrite_partitions(spark, table, touched, lambda rows: upsert(rows, changes, key, order))

        def change(rows: DataFrame) -> DataFrame:
            return upsert(rows.drop(KEY_PART), changes, key, order).withColumn(KEY_PART, key_part(key, parts))

        return rewrite_partitions(spark, table, touched, change)
