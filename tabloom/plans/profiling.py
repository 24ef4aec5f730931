"""Profiles of datasets, feature groups and training sets, one by one or as a queue."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import clean_table_name_text
from ..operators.catalog import DONE, FAILED, RUNNING, pending_queue, set_status
from ..operators.profile import profile_report
from ..session import scratch_path
from ..sources.delimited import MISSING_MARKERS, infer_column_types, read_training_set
from ..sources.online import json_rows
from ..sources.tables import scan_table


def profile_dataset(df: DataFrame) -> DataFrame:
    """A dataset's report; its nulls count as zeros."""
    return profile_report(df, na="fill")


def profile_feature_group(spark: SparkSession, table: str) -> DataFrame:
    """A feature table's report over its complete rows; an empty table is an error."""
    rows = scan_table(spark, table)
    if rows.isEmpty():
        raise ValueError(f"no rows in {clean_table_name_text(table)}")
    return profile_report(rows, na="drop")


def profile_training_set(spark: SparkSession, path: str, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """A training set's report over its complete rows, with column types found in the data.

    Texts that stand for missing values (``markers``) are null before types are found.
    """
    return profile_report(infer_column_types(read_training_set(spark, path, markers)), na="drop")


@dataclass
class QueueRun:
    """What a run over a queue leaves: its reports, the catalog with new statuses, and what became of each item."""

    reports: DataFrame | None
    catalog: DataFrame
    outcomes: DataFrame


# What a ledger of a queue holds: a row when an item begins, and one when it ends.
_LEDGER = "item string, state int, error string, at timestamp"


def _ledger_rows(spark: SparkSession, ledger: str) -> list[tuple]:
    """The last row of each item, by the order in which they were written."""
    try:
        rows = spark.read.schema(_LEDGER).option("recursiveFileLookup", True).json(ledger)
        last = rows.groupBy("item").agg(F.max_by(F.struct("state", "error"), F.struct("at", F.col("state") != RUNNING)).alias("r"))
        return [(r["item"], r["r"]["state"], r["r"]["error"]) for r in last.collect()]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def profile_pending(
    catalog: DataFrame,
    key: str,
    status: str,
    load: Callable[[object], DataFrame],
    profile: Callable[[DataFrame], DataFrame] = profile_dataset,
    folder: str | None = None,
    on_status: Callable[[object, int], None] | None = None,
    ledger: str | None = None,
    workers: int = 1,
    **queue: str,
) -> QueueRun:
    """Profile every pending item of a catalog; ``queue`` holds further conditions of ``pending_queue``.

    Items differ in schema, so each is a job of its own, ``workers`` of them side by side in
    a pool of that name. An item counts as running until its report is stored under
    ``folder``; whatever fails on the way, while planning or while running, marks that item
    as failed, keeps the message, and does not stop the others. ``on_status`` is told of
    each change as it happens. All reports are read back as one table, whatever the length
    of the queue.

    With a ``ledger``, a folder like ``folder`` to be named again in a later run, each
    change is also stored before the next step. A run that was ended half-way is then taken
    up: items whose report is stored are not profiled again, and items that had begun or
    failed are. An item's report has a folder of its own, so a second try replaces it.
    """
    spark = catalog.sparkSession
    folder = folder or scratch_path(spark, "reports")
    told = on_status or (lambda item, state: None)
    done = {item for item, state, _ in (_ledger_rows(spark, ledger) if ledger else []) if state == DONE}
    kind = catalog.schema[key].dataType.simpleString()

    def note(item: object, state: int, error: str | None = None) -> None:
        if ledger:
            row = spark.createDataFrame([(str(item), state, error)], "item string, state int, error string")
            # A folder for each row: writers side by side would clear each other's temporary files.
            row.withColumn("at", F.current_timestamp()).coalesce(1).write.json(os.path.join(ledger, uuid.uuid4().hex))
        told(item, state)

    def one(item: object) -> tuple[object, int, str | None]:
        if str(item) in done:
            return item, DONE, None
        note(item, RUNNING)
        error = None
        try:
            report = profile(load(item)).select(F.lit(item).cast(kind).alias(key), "*")
            report.write.mode("overwrite").parquet(os.path.join(folder, f"of={hashlib.sha256(str(item).encode()).hexdigest()[:24]}"))
        except Exception as failure:
            error = str(failure)
        note(item, DONE if error is None else FAILED, error)
        return item, DONE if error is None else FAILED, error

    items = (row[0] for row in pending_queue(catalog, status, **queue).select(key).distinct().orderBy(key).toLocalIterator())
    if workers > 1:
        # A pool for the items: with a fair scheduler, a long one does not hold up the others.
        before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "profile_pending")
        try:
            with ThreadPoolExecutor(workers) as pool:
                outcomes = list(pool.map(inheritable_thread_target(spark)(one), items))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
    else:
        outcomes = [one(item) for item in items]
    ended = spark.createDataFrame(outcomes, f"`{key}` {kind}, new_status int, error string")
    stored = any(state == DONE for _, state, _ in outcomes)
    reports = spark.read.option("mergeSchema", True).parquet(folder).drop("of") if stored else None
    return QueueRun(reports, set_status(catalog, key, status, ended.drop("error")), ended)


def profile_online_group(stored: DataFrame, kind: str, payload: str, schema: str | None = None) -> DataFrame:
    """An online feature group's report over the complete rows of its payloads; no rows are an error."""
    rows = json_rows(stored, kind, payload, schema)
    if rows.isEmpty():
        raise ValueError("the online group holds no rows")
    return profile_report(rows, na="drop")
