"""Profiles of growing tables from stored states, so that an append costs its own rows only.

A state describes the rows of some files, one row per column: counts, central moments and
ends, which merge exactly, and sketches of distinct values, ranks and frequent values,
which merge within a stated error. A ledger says which files a batch of states covers. A
refresh lists the table's files, reads those that no valid batch covers and stores their
states; a batch is valid while all its files are there unchanged. Files are told by path,
length and time of change.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ...sources.tables import describe, table_format
from .columns import chunks, kind_of, present, sql_text
from .frequencies import HLL_BITS
from .moments import COLUMNS_PER_PASS, MAX_PASSES, _derived

# Ranks are off by some 0.35 % of the rows at this size.
KLL_SIZE = 800
# Frequent values are exact for columns of at most so many distinct values.
TRACKED = 4096

_LEDGER = "batch string, path string, length bigint, modified bigint"

_COMMON = {
    "n": "count(1)",
    "n_present": "count({c})",
    "values": f"hll_sketch_agg(string({{c}}), {HLL_BITS})",
    "frequent": f"approx_top_k_accumulate(string({{c}}), {TRACKED})",
}
_NUMBERS = {
    "total": "sum(double({c}))",
    "mean": "avg(double({c}))",
    "spread": "var_pop({c})",
    "skew": "skewness({c})",
    "kurt": "kurtosis({c})",
    "least": "double(min({c}))",
    "most": "double(max({c}))",
    "n_negative": "count_if({c} < 0)",
    "n_zeros": "count_if({c} = 0)",
    "n_infinite": "count_if(abs(double({c})) = double('Infinity'))",
    "ranks": f"kll_sketch_agg_double(double({{c}}), {KLL_SIZE})",
}
_NO_NUMBERS = {name: "CAST(NULL AS DOUBLE)" for name in _NUMBERS} | {
    "n_negative": "CAST(NULL AS BIGINT)", "n_zeros": "CAST(NULL AS BIGINT)", "n_infinite": "CAST(NULL AS BIGINT)", "ranks": "CAST(NULL AS BINARY)",
}


def column_states(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One mergeable state per column: ``(variable, kind, n, n_present, values, frequent, total, mean, m2, m3, m4, ...)``."""
    names = list(columns or df.columns)
    size = max(COLUMNS_PER_PASS, math.ceil(len(names) / MAX_PASSES))
    parts = []
    for part in chunks(names, size):
        kinds = [kind_of(df.schema[c].dataType) for c in part]
        cells = df.select(*[present(df, c).alias(f"v{i}") for i, c in enumerate(part)])
        wanted = [_COMMON | (_NUMBERS if k == "Numeric" else {}) for k in kinds]
        row = cells.agg(*[F.expr(e.format(c=f"v{i}")).alias(f"{name}_{i}") for i, own in enumerate(wanted) for name, e in own.items()])
        rows = []
        for i, (c, kind) in enumerate(zip(part, kinds)):
            fields = {name: f"{name}_{i}" for name in _COMMON} | (_NO_NUMBERS if kind != "Numeric" else {name: f"{name}_{i}" for name in _NUMBERS})
            rows.append(f"named_struct('variable', {sql_text(c)}, 'kind', '{kind}', {', '.join(f'{name!r}, {e}' for name, e in fields.items())})")
        parts.append(row.select(F.expr(f"inline(array({', '.join(rows)}))")))
    states = reduce(DataFrame.unionByName, parts)
    # Sums of powers of the distance from the mean; those of a constant column are zero.
    m2 = F.col("spread") * F.col("n_present")
    m3 = F.when(m2 == 0, 0.0).otherwise(F.col("skew") * F.pow(m2, F.lit(1.5)) / F.sqrt("n_present"))
    m4 = F.when(m2 == 0, 0.0).otherwise((F.col("kurt") + 3) * m2 * m2 / F.col("n_present"))
    return states.withColumns({"m2": m2, "m3": m3, "m4": m4}).drop("spread", "skew", "kurt")


def merged_moments(states: DataFrame) -> DataFrame:
    """``numeric_profile`` of all rows from the states of the numeric columns of any number of batches."""
    whole = Window.partitionBy("variable")
    numbers = states.where("kind = 'Numeric'")
    mean = F.sum(F.col("mean") * F.col("n_present")).over(whole) / F.sum("n_present").over(whole)
    d, n = F.col("mean") - F.col("_mean"), F.col("n_present")
    # Batches without a present value have no mean; aggregates pass over their nulls.
    rows = numbers.withColumn("_mean", mean).select(
        "*",
        (F.col("m2") + n * d * d).alias("s2"),
        (F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("s3"),
        (F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("s4"),
    )
    sums = rows.groupBy("variable").agg(
        *[F.sum(c).alias(c) for c in ("n_present", "total", "s2", "s3", "s4", "n_negative", "n_zeros", "n_infinite")],
        F.min("least").alias("min"),
        F.max("most").alias("max"),
    )
    present_rows = F.col("n_present")
    raw = sums.withColumns(
        {
            "n": F.lit(_rows_of(states)),
            "sum": F.col("total"),
            "variance": F.when(present_rows > 1, F.col("s2") / (present_rows - 1)),
            "skew_biased": F.try_divide(F.sqrt(present_rows) * F.col("s3"), F.pow("s2", F.lit(1.5))),
            "kurt_biased": F.try_divide(present_rows * F.col("s4"), F.col("s2") * F.col("s2")) - 3,
        }
    )
    return raw.select("variable", *_derived())


def _rows_of(states: DataFrame) -> int:
    """The rows of all batches. A column that was added later is missing in the rows before."""
    return states.groupBy("batch").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


def merged_counts(states: DataFrame) -> DataFrame:
    """``(variable, kind, n, n_missing, n_distinct)``; distinct values are estimated (``HLL_BITS``)."""
    merged = states.groupBy("variable").agg(
        F.max("kind").alias("kind"), F.sum("n_present").alias("n_present"), F.expr("hll_sketch_estimate(hll_union_agg(values))").alias("n_distinct")
    )
    rows = merged.withColumn("n", F.lit(_rows_of(states)))
    return rows.select("variable", "kind", "n", (F.col("n") - F.col("n_present")).alias("n_missing"), "n_distinct")


def merged_quantiles(states: DataFrame, probs: Iterable[float]) -> DataFrame:
    """``(variable, q05, ...)`` of the numeric columns: values whose rank is off by what ``KLL_SIZE`` says."""
    probs = list(probs)
    held = states.where("kind = 'Numeric' AND n_present > 0")
    sketch = held.groupBy("variable").agg(F.expr("kll_merge_agg_double(ranks)").alias("ranks"))
    found = F.expr(f"kll_sketch_get_quantile_double(ranks, array({', '.join(f'double({p})' for p in probs)}))")
    return sketch.select("variable", found.alias("q")).select("variable", *[F.col("q")[i].alias(f"q{round(p * 100):02d}") for i, p in enumerate(probs)])


def merged_top_values(states: DataFrame, n: int = 10) -> DataFrame:
    """``(variable, rank, value, count, exact)``; ties go to the lower text.

    Counts are exact where the sketch never had to drop a value, that is for columns of up
    to ``TRACKED`` distinct values, and are else estimates.
    """
    sketch = states.where("n_present > 0").groupBy("variable").agg(
        F.expr("approx_top_k_combine(frequent)").alias("frequent"), F.expr("hll_sketch_estimate(hll_union_agg(values))").alias("d")
    )
    items = sketch.select("variable", (F.col("d") * 1.1 < TRACKED).alias("exact"), F.expr(f"inline(approx_top_k_estimate(frequent, {TRACKED}))"))
    order = Window.partitionBy("variable").orderBy(F.desc("count"), "item")
    ranked = items.where("item IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("variable", "rank", F.col("item").alias("value"), "count", "exact")


def _listed(spark: SparkSession, table: str) -> DataFrame:
    """``(path, length, modified)`` of the table's files, by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(describe(spark, table)["Location"])
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified"))


def _read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _valid(spark: SparkSession, table: str, states: str) -> tuple[DataFrame, DataFrame]:
    """The table's files with the valid batch that covers each, null where none does; and the valid batches."""
    files = _listed(spark, table)
    ledger = _read_or_none(spark, os.path.join(states, "ledger"), _LEDGER)
    if ledger is None:
        ledger = spark.createDataFrame([], _LEDGER)
    there = ledger.join(files.withColumn("there", F.lit(True)), ["path", "length", "modified"], "left")
    valid = there.groupBy("batch").agg(F.every(F.coalesce("there", F.lit(False))).alias("whole")).where("whole").select("batch")
    covered = ledger.join(valid, "batch").select("path", "length", "modified", "batch")
    return files.join(covered, ["path", "length", "modified"], "left"), valid


def refresh_states(spark: SparkSession, table: str, states: str, columns: list[str] | None = None) -> int:
    """Bring the states of a table under the folder ``states`` up to date; returns how many files were read.

    Only files that no valid batch covers are read. The ledger is written last, so a run that
    ends before leaves nothing that counts. One refresh of a table may run at a time.
    """
    files, _ = _valid(spark, table, states)
    # The reader needs the new paths in the driver; a first refresh has all of them.
    new = [tuple(r) for r in files.where("batch IS NULL").select("path", "length", "modified").orderBy("path").toLocalIterator()]
    if not new:
        return 0
    target, location = spark.table(table), describe(spark, table)["Location"]
    rows = spark.read.format(table_format(spark, table)).schema(target.schema).option("basePath", location).load([path for path, *_ in new])
    batch = uuid.uuid4().hex
    found = column_states(rows.select(*[F.col(f"`{c}`") for c in target.columns]), columns)
    found.withColumn("batch", F.lit(batch)).write.mode("append").parquet(os.path.join(states, "states"))
    entries = spark.createDataFrame([(batch, *entry) for entry in new], _LEDGER)
    entries.coalesce(1).write.mode("append").parquet(os.path.join(states, "ledger"))
    return len(new)


def stored_states(spark: SparkSession, table: str, states: str) -> DataFrame:
    """The states that cover the table as it is; files without any are an error, since a profile would lack them."""
    files, valid = _valid(spark, table, states)
    open_files = files.where("batch IS NULL").count()
    if open_files:
        raise ValueError(f"{open_files} files of {table} have no states yet: refresh them first")
    held = _read_or_none(spark, os.path.join(states, "states"))
    if held is None:
        raise ValueError(f"no states under {states}")
    return held.join(valid, "batch")


def state_sections(states: DataFrame, probs: Iterable[float] = (0.05, 0.25, 0.5, 0.75, 0.95), top: int = 10) -> dict[str, DataFrame]:
    """All that the states tell: ``numeric``, ``columns``, ``quantiles`` and ``top``."""
    return {
        "numeric": merged_moments(states),
        "columns": merged_counts(states),
        "quantiles": merged_quantiles(states, probs),
        "top": merged_top_values(states, top),
    }
