"""Whole-table reports in long form, as JSON, and the alerts drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..features import drop_null_rows, fill_zero
from .columns import KINDS, columns_of_kind, kind_of
from ...session import Scratch, written
from .frequencies import (
    approximate_summary,
    boolean_counts,
    datetime_profile,
    distinct_metrics,
    frequency_summary,
    frequent_values,
    imbalance_metric,
    top_values,
)
from .moments import numeric_profile, table_profile
from .quantiles import histogram, median_absolute_deviation, quantiles

# Limits above which a report raises an alert.
SHARE_LIMIT = 0.01
CARDINALITY_LIMIT = 50
SKEWNESS_LIMIT = 20.0
IMBALANCE_LIMIT = 0.5

MISSING_POLICIES = ("keep", "fill", "drop")


def handle_missing(df: DataFrame, na: str) -> DataFrame:
    if na not in MISSING_POLICIES:
        raise ValueError(f"na must be one of {MISSING_POLICIES}")
    return {"keep": lambda d: d, "fill": fill_zero, "drop": drop_null_rows}[na](df)


def _kind_column(df: DataFrame) -> Column:
    kinds = {k: [f.name for f in df.schema if kind_of(f.dataType) == k] for k in KINDS}
    picked = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, names in kinds.items():
        if names:
            picked = picked.when(F.col("variable").isin(names), F.lit(kind))
    return picked


def alerts(df: DataFrame, counted: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """``(variable, alert)``: one row per rule a column breaks.

    ``counted`` and ``moments`` are the frequency summary and numeric profile of ``df``, if known.
    """
    counts = (frequency_summary(df) if counted is None else counted).select(
        "variable",
        *distinct_metrics(),
        imbalance_metric().alias("imbalance"),
        _kind_column(df).alias("kind"),
    )
    if columns_of_kind(df, "Numeric"):
        numbers = (numeric_profile(df) if moments is None else moments).select("variable", "p_zeros", "p_infinite", "skewness")
        counts = counts.join(numbers, "variable", "left")
    else:
        counts = counts.selectExpr("*", *[f"double(null) {c}" for c in ("p_zeros", "p_infinite", "skewness")])
    text = F.col("kind").isin("Categorical", "Boolean")
    rules = {
        "CONSTANT": F.col("n_distinct") == 1,
        "MISSING": F.col("p_missing") > SHARE_LIMIT,
        "ZEROS": F.col("p_zeros") > SHARE_LIMIT,
        "INFINITE": F.col("p_infinite") > SHARE_LIMIT,
        "UNIQUE": F.col("is_unique"),
        "HIGH_CARDINALITY": (F.col("kind") == "Categorical") & (F.col("n_distinct") > CARDINALITY_LIMIT),
        "SKEWED": F.abs("skewness") > SKEWNESS_LIMIT,
        "IMBALANCE": text & (F.col("imbalance") > IMBALANCE_LIMIT),
    }
    raised = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return counts.select("variable", F.explode(raised).alias("alert"))


def _long(frame: DataFrame) -> DataFrame:
    metrics = [c for c in frame.columns if c != "variable"]
    numbers = frame.select("variable", *[F.col(m).cast("double").alias(m) for m in metrics])
    return numbers.unpivot(["variable"], metrics, "metric", "value")


def _metrics(rows: DataFrame, counts: DataFrame, moments: DataFrame | None) -> DataFrame:
    """``(variable, metric, value)`` for all columns; times are in seconds since 1970."""
    parts = [_long(counts.select("variable", *distinct_metrics()))]
    text = columns_of_kind(rows, "Categorical") + columns_of_kind(rows, "Boolean")
    if text:
        parts.append(
            _long(counts.where(F.col("variable").isin(text)).select("variable", imbalance_metric().alias("imbalance")))
        )
    if moments is not None:
        found = quantiles(rows)
        medians = {r["variable"]: r["q50"] for r in found.select("variable", "q50").collect()}
        parts.append(_long(moments.drop("n", "n_missing", "p_missing")))
        parts.append(_long(found))
        parts.append(_long(median_absolute_deviation(rows, medians=medians).select("variable", "mad")))
    if columns_of_kind(rows, "DateTime"):
        times = datetime_profile(rows)
        parts.append(
            _long(
                times.select(
                    "variable",
                    (F.unix_micros("min") / F.lit(1e6)).alias("min"),
                    (F.unix_micros("max") / F.lit(1e6)).alias("max"),
                    F.col("range_seconds").alias("range"),
                )
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _section(frame: DataFrame, section: str, **columns: Column) -> DataFrame:
    """Rows of one section; columns that are not given are null."""
    kinds = {"variable": "string", "name": "string", "rank": "int", "text": "string", "value": "double"}
    picked = [columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return frame.select(F.lit(section).alias("section"), *picked)


def profile_report(df: DataFrame, na: str = "keep", scratch: Scratch | None = None, approximate: bool = False) -> DataFrame:
    """``(section, variable, name, rank, text, value)``: the whole report of a table.

    Sections: ``table`` holds the figures of the table, ``metric`` those of each column
    (times in seconds since 1970), ``top`` the most frequent values by rank, ``flag`` the
    counts of boolean values, ``bin`` the histogram (lower and upper edge and count of each
    bin), ``alert`` the rules that a column breaks.

    Rows that are filled or dropped first, and rows of files that are not columnar, are
    written once, since every part reads the columns it needs by itself; ``scratch`` owns
    them. Jobs that search quantiles and medians run while the report is planned.

    With ``approximate`` distinct values are estimated by sketches in one scan (see
    ``approximate_summary``), frequent ones are searched by sketches and proven, and figures
    that need every single value are left out: values seen once, imbalance, uniqueness.
    """
    rows = handle_missing(df, na)
    if na != "keep" or not _columnar(df):
        rows = written(rows, "profiled", scratch)
    # Short frames, one row per column, that several parts use.
    counts = written(approximate_summary(rows) if approximate else frequency_summary(rows), "counts", scratch)
    moments = written(numeric_profile(rows), "moments", scratch) if columns_of_kind(rows, "Numeric") else None
    figures = table_profile(rows)
    whole = figures.select(*[F.col(c).cast("double").alias(c) for c in figures.columns]).unpivot([], figures.columns, "name", "value")
    metrics = _metrics(rows, counts, moments)
    if approximate:
        metrics = metrics.where(~F.col("metric").isin("n_unique", "p_unique", "is_unique", "imbalance"))
    parts = [
        _section(whole, "table", name=F.col("name"), value=F.col("value")),
        _section(metrics, "metric", variable=F.col("variable"), name=F.col("metric"), value=F.col("value")),
        _section(frequent_values(rows) if approximate else top_values(rows), "top", variable=F.col("variable"), rank=F.col("rank"), text=F.col("value"), value=F.col("count")),
        _section(alerts(rows, counts, moments), "alert", variable=F.col("variable"), name=F.col("alert")),
    ]
    if columns_of_kind(rows, "Boolean"):
        parts.append(_section(boolean_counts(rows), "flag", variable=F.col("variable"), text=F.col("value"), value=F.col("count")))
    if moments is not None:
        ends = histogram(rows).select("variable", "bin", *[F.col(c).cast("double").alias(c) for c in ("lower", "upper", "count")])
        bins = ends.unpivot(["variable", "bin"], ["lower", "upper", "count"], "name", "value")
        parts.append(_section(bins, "bin", variable=F.col("variable"), name=F.col("name"), rank=F.col("bin"), value=F.col("value")))
    return reduce(DataFrame.unionByName, parts)


def _columnar(df: DataFrame) -> bool:
    """True if every file that a frame reads is of a columnar format, judged by its input files' names."""
    files = df.inputFiles()
    return all(f.endswith((".parquet", ".orc")) for f in files)


def profile_json(report: DataFrame) -> DataFrame:
    """``(variable, profile)``: the report of each variable as one JSON object; the table's has a null variable.

    A report has a few dozen rows per variable, so nothing here grows with the table.
    """

    def entries(section: str, *fields: str) -> Column:
        of = F.when(F.col("section") == section, F.struct("rank", *[f for f in fields if f != "rank"]))
        return F.array_sort(F.collect_list(of)).alias(section)

    named = F.when(F.col("section").isin("metric", "table"), F.struct("name", "value"))
    metrics = F.map_from_entries(F.array_sort(F.collect_list(named))).alias("metrics")
    alert = F.sort_array(F.collect_list(F.when(F.col("section") == "alert", F.col("name")))).alias("alerts")
    parts = report.groupBy("variable").agg(
        metrics, entries("top", "text", "value"), entries("flag", "text", "value"), entries("bin", "name", "value"), alert
    )
    return parts.select("variable", F.to_json(F.struct("metrics", "top", "flag", "bin", "alerts")).alias("profile"))
