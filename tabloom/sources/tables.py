"""Feature tables and training sets: write, append, export, alter, drop, size."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STAMP_COLUMN = "fg_date"

# Fixed value: the format of the ingest stamp.
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def add_stamp(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Set ``fg_date`` to a time, by default the current one, as a string."""
    at = F.current_timestamp() if at is None else at.cast("timestamp")
    return df.withColumn(STAMP_COLUMN, F.date_format(at, STAMP_FORMAT))


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def save_feature_table(
    df: DataFrame,
    table: str,
    path: str,
    partition_keys: list[str] | None = None,
    stamp_at: Column | None = None,
    file_format: str = "orc",
) -> None:
    """Stamp the rows and write them as an external table.

    With partition keys the rows are rebalanced on them first, so a partition gets few
    files and a key that holds much of the data is still split between tasks.
    """
    keys = list(partition_keys or [])
    rows = add_stamp(df, stamp_at)
    if keys:
        rows = rows.hint("rebalance", *[F.col(k) for k in keys])
    writer = rows.write.format(file_format).mode("overwrite").option("path", path)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.saveAsTable(table)


def describe(spark: SparkSession, table: str) -> dict[str, str]:
    """The detail rows of ``DESCRIBE FORMATTED``."""
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").collect()
    start = next((i for i, r in enumerate(rows) if r.col_name.startswith("# Detailed")), 0)
    return {r.col_name.strip(): r.data_type for r in rows[start:] if r.col_name}


def table_format(spark: SparkSession, table: str) -> str:
    """``orc``, ``parquet`` or ``csv``, for native and for Hive tables."""
    detail = describe(spark, table)
    said = f"{detail.get('InputFormat', '')} {detail.get('Provider', '')}".lower()
    for name, marks in (("orc", ("orc",)), ("parquet", ("parquet",)), ("csv", ("csv", "textinputformat"))):
        if any(m in said for m in marks):
            return name
    raise ValueError(f"unknown storage format of table {table}")


def append_rows(spark: SparkSession, df: DataFrame, table: str, stamp_at: Column | None = None) -> None:
    """Append by column name, in the table's own format and partitioning.

    Columns the rows lack are null, ``fg_date`` is filled if the table has it, and a
    column the table lacks is an error.
    """
    table_format(spark, table)
    target = spark.table(table)
    surplus = [c for c in df.columns if c not in target.columns]
    if surplus:
        raise ValueError(f"columns not in {table}: {surplus}")
    if STAMP_COLUMN in target.columns and STAMP_COLUMN not in df.columns:
        df = add_stamp(df, stamp_at)
    aligned = df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema
        ]
    )
    aligned.write.insertInto(table)


def save_training_set(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV files with headers; one file only on request, since it means one task."""
    rows = df.coalesce(1) if single_file else df
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Write the whole of a table as delimited files, from the executors."""
    df.write.mode("overwrite").options(header=True, sep=delimiter, escape='"').csv(path)


def add_string_columns(spark: SparkSession, table: str, names: list[str]) -> list[str]:
    """Add the columns the table does not have yet; returns those added."""
    present = set(spark.table(table).columns)
    missing = [n for n in dict.fromkeys(names) if n not in present]
    if missing:
        columns = ", ".join(f"`{n}` string" for n in missing)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    return missing


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def path_size(spark: SparkSession, path: str) -> DataFrame:
    """``(n_files, total_bytes)`` under a path, from file listings; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )


def table_sizes(spark: SparkSession, tables: list[str]) -> DataFrame:
    """``(table_name, n_files, total_bytes)`` for the tables that exist.

    Bytes are logical: the storage layer's replication factor is not applied.
    """
    found = None
    for table in tables:
        if not spark.catalog.tableExists(table):
            continue
        size = path_size(spark, describe(spark, table)["Location"]).select(
            F.lit(table).alias("table_name"), "n_files", "total_bytes"
        )
        found = size if found is None else found.unionByName(size)
    if found is None:
        return spark.createDataFrame([], "table_name string, n_files bigint, total_bytes bigint")
    return found


def training_set_path(root: str, training_set_id: str) -> str:
    return os.path.join(root, f"training_dataset_{training_set_id}")


def delete_training_set(spark: SparkSession, path: str | None, allowed_root: str = "hdfs://") -> bool:
    """Delete a folder below ``allowed_root``; anything else is left alone."""
    if not path or ".." in path.split("/"):
        return False
    inside = path.startswith(allowed_root) and path.rstrip("/") != allowed_root.rstrip("/")
    if inside and not allowed_root.endswith("/"):
        inside = path.startswith(allowed_root + "/")
    if not inside or not posixpath.basename(path.rstrip("/")):
        return False
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(jvm_path, True))
