"""The privacy job: pending tables are scanned, and what is found goes into the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.privacy import PII_SAMPLE_ROWS, PII_THRESHOLD, outcome_code
from ..operators.catalog import upsert
from ..operators.privacy import pii_columns


def privacy_job(
    catalog: DataFrame,
    key: str,
    file_type: str,
    load: Callable[[object, str], DataFrame],
    row_key: Callable[[object], list[str]],
    gazetteer: DataFrame | None = None,
    n: int = PII_SAMPLE_ROWS,
    threshold: float = PII_THRESHOLD,
    result: str = "privacy_detection_result",
) -> DataFrame:
    """The catalog with the outcome of each item: its personal columns as JSON, or a code for why there are none.

    Items differ in schema, so each is a job of its own; an item that cannot be read or
    scanned gets the code of its message and does not stop the others. One short row per
    item comes to the driver, then all outcomes are upserted at once.
    """
    spark, found = catalog.sparkSession, []
    for item, kind in catalog.select(key, file_type).orderBy(key).toLocalIterator():
        try:
            flagged = pii_columns(load(item, kind), row_key(item), gazetteer=gazetteer, n=n, threshold=threshold)
            columns = [r["column_name"] for r in flagged.where("is_pii").orderBy("column_name").collect()]
            found.append((item, columns, "Analysis complete: No PII columns detected"))
        except Exception as failure:
            found.append((item, [], f"Error: {failure}"))
    kind = catalog.schema[key].dataType.simpleString()
    rows = spark.createDataFrame(found, f"`{key}` {kind}, columns array<string>, message string")
    outcome = outcome_code("message", "columns")
    return upsert(catalog, rows.select(key, outcome.alias(result)), key)
