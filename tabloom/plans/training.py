"""Training sets from feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.delimited import read_training_set
from ..sources.tables import save_training_set, scan_table, training_set_path


def create_training_set(
    spark: SparkSession, table: str, root: str, training_set_id: str, file_format: str = "csv", single_file: bool = False
) -> str:
    """Write all rows of a feature table as a training set; returns its path."""
    if file_format != "csv":
        raise ValueError("training sets are written as csv")
    path = training_set_path(root, training_set_id)
    save_training_set(scan_table(spark, table), path, single_file)
    return path


def preview_training_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = read_training_set(spark, path)
    return rows if limit is None else rows.limit(limit)
