"""Counts and moments of numeric columns, in one aggregate without a shuffle of rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import KINDS, chunks, columns_of_kind, kind_of, present, sql_text

# Up to this many columns the generated code of one aggregate stays small enough to run
# fused with the scan. A wider table is read once per chunk, each time only the chunk's
# own columns, and at most MAX_PASSES times.
COLUMNS_PER_PASS = 4
MAX_PASSES = 16

# Raw aggregates of one variable, by name.
_BASIC = {
    "n": "count(1)",
    "n_present": "count({c})",
    "sum": "sum(double({c}))",
    "variance": "var_samp({c})",
    "min": "double(min({c}))",
    "max": "double(max({c}))",
    "n_negative": "count_if({c} < 0)",
    "n_zeros": "count_if({c} = 0)",
    "n_infinite": "count_if(abs(double({c})) = double('Infinity'))",
    "skew_biased": "skewness({c})",
    "kurt_biased": "kurtosis({c})",
}


def _share(name: str, total: str = "n") -> Column:
    return F.try_divide(F.col(name), F.col(total))


def _derived() -> list[Column]:
    """The report's metrics from the raw aggregates of one variable."""
    n = F.col("n_present").cast("double")
    mean = F.try_divide(F.col("sum"), n)
    std = F.sqrt("variance")
    # Bias-corrected skewness and kurtosis; 0 for a constant column, null for too few values.
    g1 = F.when(F.col("variance") == 0, F.lit(0.0)).otherwise(
        F.col("skew_biased") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    )
    g2 = F.when(F.col("variance") == 0, F.lit(0.0)).otherwise(
        (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.col("kurt_biased") + 6)
    )
    return [
        F.col("n"),
        (F.col("n") - F.col("n_present")).alias("n_missing"),
        F.try_divide(F.col("n") - F.col("n_present"), F.col("n")).alias("p_missing"),
        mean.alias("mean"),
        std.alias("std"),
        F.col("variance"),
        F.col("min"),
        F.col("max"),
        (F.col("max") - F.col("min")).alias("range"),
        F.col("sum"),
        F.try_divide(std, mean).alias("cv"),
        F.col("n_negative"),
        _share("n_negative").alias("p_negative"),
        F.col("n_zeros"),
        _share("n_zeros").alias("p_zeros"),
        F.col("n_infinite"),
        _share("n_infinite").alias("p_infinite"),
        F.when(n > 2, g1).alias("skewness"),
        F.when(n > 3, g2).alias("kurtosis"),
    ]


def _per_variable(df: DataFrame, part: list[str], keys: list[str]) -> DataFrame:
    """Raw aggregates of some columns, one row per key and variable."""
    cells = df.select(*keys, *[present(df, c).alias(f"v{i}") for i, c in enumerate(part)])
    aggregates = [F.expr(e.format(c=f"v{i}")).alias(f"{name}_{i}") for i in range(len(part)) for name, e in _BASIC.items()]
    grouped = cells.groupBy(*keys).agg(*aggregates) if keys else cells.agg(*aggregates)
    rows = ", ".join(
        f"named_struct('variable', {sql_text(c)}, {', '.join(f'{name!r}, {name}_{i}' for name in _BASIC)})"
        for i, c in enumerate(part)
    )
    return grouped.select(*keys, F.expr(f"inline(array({rows}))"))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of metrics per numeric column."""
    return grouped_profile(df, [], columns)


def grouped_profile(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``numeric_profile`` for every value of the keys, all of them in one job.

    Aggregates are partial before the shuffle, so a key with most of the rows costs no more.
    """
    wanted = [c for c in columns_of_kind(df, "Numeric", columns) if c not in keys]
    if not wanted:
        raise ValueError("no numeric columns to profile")
    size = max(COLUMNS_PER_PASS, math.ceil(len(wanted) / MAX_PASSES))
    parts = [_per_variable(df, part, keys) for part in chunks(wanted, size)]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.select(*keys, "variable", *_derived())


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, variables with missing cells, columns per kind."""
    missing = [F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *missing)
    width = len(df.columns)
    cells = sum((F.col(f"m{i}") for i in range(width)), F.lit(0).cast("bigint"))
    affected = sum((F.when(F.col(f"m{i}") > 0, 1).otherwise(0) for i in range(width)), F.lit(0))
    kinds = [kind_of(f.dataType) for f in df.schema]
    return row.select(
        F.col("n").alias("n_rows"),
        F.lit(width).alias("n_columns"),
        cells.alias("n_cells_missing"),
        F.coalesce(F.try_divide(cells, F.col("n") * width), F.lit(0.0)).alias("p_cells_missing"),
        affected.alias("n_vars_with_missing"),
        *[F.lit(kinds.count(k)).alias(f"n_{k.lower()}") for k in KINDS],
    )
