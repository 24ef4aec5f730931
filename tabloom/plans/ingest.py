"""From delimited files to feature tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.names import clean_column_names, clean_name_text, clean_table_name_text
from ..operators.features import extract_features, parse_spec, select_features
from ..session import Scratch
from ..sources.delimited import read_csv, read_delimited
from ..sources.tables import append_rows, save_feature_table

READABLE_TYPES = ("csv", "tsv")


def import_csv(
    spark: SparkSession, path: str | list[str], table: str, root: str, delimiter: str = ",", stamp_at: Column | None = None
) -> str:
    """A delimited file to a new external table under ``root``; returns the clean table name."""
    name = clean_table_name_text(table)
    rows = clean_column_names(read_delimited(spark, path, delimiter))
    save_feature_table(rows, name, os.path.join(root, name), stamp_at=stamp_at)
    return name


def append_csv(
    spark: SparkSession, path: str | list[str], table: str, delimiter: str = ",", stamp_at: Column | None = None
) -> str:
    """A delimited file to the end of a table that exists."""
    name = clean_table_name_text(table)
    append_rows(spark, clean_column_names(read_delimited(spark, path, delimiter)), name, stamp_at)
    return name


def feature_rows(source: DataFrame, spec: dict, key: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Clean the names, project the spec's features and extract them."""
    chosen = select_features(clean_column_names(source), [f["name"] for f in spec["features"]])
    return extract_features(chosen, spec, key, scratch)


def create_feature_group(
    spark: SparkSession, spec: str | dict, path: str | list[str], root: str, stamp_at: Column | None = None
) -> dict:
    """A file to the feature table its spec asks for; returns the spec, now ready."""
    spec = parse_spec(spec)
    if spec.get("data_type") not in READABLE_TYPES:
        raise ValueError(f"data type must be one of {READABLE_TYPES}")
    keys = [clean_name_text(k) for k in spec.get("partition_keys") or []]
    with Scratch(spark) as scratch:  # intermediate tables go when the feature table is stored
        rows = feature_rows(read_csv(spark, path), spec, scratch=scratch)
        save_feature_table(rows, spec["table_name"], os.path.join(root, spec["table_name"]), keys, stamp_at)
    return {**spec, "status": "SUCCESS"}
