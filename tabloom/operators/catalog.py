"""Queries and updates over catalog tables: visibility, status, listing, upsert."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Permissions that make an item visible, and file types that can be profiled.
VISIBLE_PERMISSIONS = (0, 2)
PROFILED_TYPES = ("csv", "tsv", "xls", "xlsx", "sav")

# Processing states; null stands for unknown.
DONE, PENDING, RUNNING, FAILED = 0, 1, 2, 3
STATUSES = (DONE, PENDING, RUNNING, FAILED, None)

# The listing page.
PAGE_LIMIT, PAGE_OFFSET = 100, 0


def visible(df: DataFrame, permission: str | None = None, hidden: str | None = None, public: str | None = None) -> DataFrame:
    """Rows anybody may see, by whichever of the three columns the table has."""
    out = df
    if permission:
        out = out.where(F.col(permission).isin(*VISIBLE_PERMISSIONS))
    if hidden:
        out = out.where(~F.col(hidden))
    if public:
        out = out.where(F.col(public))
    return out


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a ``None`` means no condition."""
    out = df
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    return out


def pending_queue(df: DataFrame, status: str, name: str | None = None, format_column: str | None = None, file_format: str | None = None) -> DataFrame:
    """Items waiting to be profiled; without a name where one is asked for they do not count."""
    out = df.where(F.col(status) == PENDING)
    if name:
        out = out.where(F.col(name).isNotNull())
    if format_column and file_format:
        out = out.where(F.col(format_column) == file_format)
    return out


def catalog_items(
    datasets: DataFrame, versions: DataFrame, files: DataFrame, types: Iterable[str] | None = PROFILED_TYPES
) -> DataFrame:
    """Datasets with the file of their latest version, for files that can be profiled, or of all types for ``None``.

    Reads ``dataset(datasetid, latest_version, dataset_preprocessed)``,
    ``file_item_version(version_id, file_item_id)`` and ``file_item(id, file_type)``.
    """
    if types is not None:
        files = files.where(F.col("file_type").isin(*types))
    return (
        datasets.join(versions, F.col("version_id") == F.col("latest_version"))
        .join(files, F.col("id") == F.col("file_item_id"))
        .select("datasetid", "id", "file_type", "dataset_preprocessed")
    )


def items_by_status(items: DataFrame, status: int = PENDING) -> DataFrame:
    return items.where(F.col("dataset_preprocessed") == status).select("id", "file_type")


def item_by_id(items: DataFrame, file_id) -> DataFrame:
    return items.where(F.col("id") == F.lit(file_id)).select("id", "file_type", "dataset_preprocessed")


def item_status(items: DataFrame, file_id) -> DataFrame:
    """The status of a file; ``items`` should hold files of all types, since any file has one."""
    return item_by_id(items, file_id).select("dataset_preprocessed")


def listing(df: DataFrame, order: str | list[str], limit: int = PAGE_LIMIT, offset: int = PAGE_OFFSET, **wanted) -> DataFrame:
    """One page of the matching rows in order of a key."""
    order = [order] if isinstance(order, str) else order
    return matching(df, **wanted).orderBy(*order).offset(offset).limit(limit)


def listing_total(df: DataFrame, **wanted) -> DataFrame:
    """The number of matching rows on all pages."""
    return matching(df, **wanted).agg(F.count(F.lit(1)).alias("total"))


def only_change(changes: DataFrame, key: str) -> DataFrame:
    """The changes, one row per key; a key that stands on several rows is an error."""
    twice = F.raise_error(F.concat(F.lit("changed more than once, and no order is given: "), F.col(key).cast("string")))
    columns = [c for c in changes.columns if c != key]
    only = changes.groupBy(key).agg(F.first(F.struct(*columns)).alias("_row"), F.count(F.lit(1)).alias("_times"))
    return only.where((F.col("_times") == 1) | twice.cast("boolean")).select(key, "_row.*")


def set_status(df: DataFrame, key: str, status: str, updates: DataFrame) -> DataFrame:
    """The table with new statuses from ``updates(key, new_status)``; other rows unchanged.

    A null in ``new_status`` is a value like any other; a number that is no status is an
    error, and so is a key that is updated more than once.
    """
    known = F.col("new_status").isNull() | F.col("new_status").isin([s for s in STATUSES if s is not None])
    wrong = F.raise_error(F.concat(F.lit("not a status: "), F.col("new_status").cast("string")))
    updates = updates.withColumn("new_status", F.when(known, F.col("new_status")).otherwise(wrong.cast(updates.schema["new_status"].dataType)))
    changes = only_change(updates.select(key, "new_status"), key).withColumn("_changed", F.lit(True))
    joined = df.join(changes, key, "left")
    new = F.when(F.col("_changed"), F.col("new_status")).otherwise(F.col(status))
    return joined.select(*[new.alias(c) if c == status else F.col(c) for c in df.columns])


def set_status_where(df: DataFrame, key: str, status: str, keys: DataFrame, value: int | None) -> DataFrame:
    """One new status for all rows whose key is in ``keys``."""
    if value not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    updates = keys.select(key).distinct().select(key, F.lit(value).cast("int").alias("new_status"))
    return set_status(df, key, status, updates)


def next_status(current: Column | str, event: Column | str) -> Column:
    """The state after an event; a finished item keeps its state, as does an unknown event."""
    current = F.col(current) if isinstance(current, str) else current
    event = F.col(event) if isinstance(event, str) else event
    return (
        F.when(current == DONE, current)
        .when(event == "request", F.lit(PENDING))
        .when(event == "start", F.lit(RUNNING))
        .when(event == "finish", F.lit(DONE))
        .when(event == "fail", F.lit(FAILED))
        .when(event == "error", F.lit(None).cast("int"))
        .otherwise(current)
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert new keys and overwrite the changed columns of known ones.

    A null in a change wins over the old value. Where a key is changed more than once, the
    row with the highest ``order`` counts, rows without one before all others, and of equal
    ones always the same; without ``order`` it is an error. A small set of changes is
    broadcast, and the table then does not move.
    """
    columns = [c for c in changes.columns if c not in (key, order)]
    if order:
        row = F.struct(*columns)
        # max_by passes over rows whose order is null, and would find none where all are.
        place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.xxhash64(F.to_json(row)).alias("hash"))
        changes = changes.groupBy(key).agg(F.max_by(row, place).alias("_row")).select(key, "_row.*")
    else:
        changes = only_change(changes, key)
    marked = changes.select(
        F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    merged = table.join(marked, key, "left").select(
        *[
            F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )
    known = table.join(changes.select(key), key, "left_semi").select(key)
    added = changes.join(known, key, "left_anti").select(
        *[F.col(c) if c in changes.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    )
    return merged.unionByName(added)
