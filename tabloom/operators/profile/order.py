"""Is a column increasing or decreasing along an order column?"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .columns import present

_EDGES = ("first_lo", "first_hi", "last_lo", "last_hi")
_FLAGS = ("up", "down", "up_strict", "down_strict")


def _check(batch: pd.DataFrame, last: pd.DataFrame | None, flags: dict[str, bool]) -> None:
    """Compare each row with the one before it, the last of the batch before included."""
    rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
    lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
    single = bool((batch["n"] == 1).all())
    flags["up"] &= bool((hi[:-1] <= lo[1:]).all())
    flags["down"] &= bool((lo[:-1] >= hi[1:]).all())
    flags["up_strict"] &= single and bool((hi[:-1] < lo[1:]).all())
    flags["down_strict"] &= single and bool((lo[:-1] > hi[1:]).all())


def _summarizer(columns: list[str]):
    """One row per column for a sorted partition: its ends, and the directions that hold within.

    Batches pass by one at a time; only the last row of a batch is carried to the next.
    """

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[int, pd.Series] = {}
        last: dict[int, pd.DataFrame] = {}
        flags = [dict.fromkeys(_FLAGS, True) for _ in columns]
        for batch in batches:
            for i in range(len(columns)):
                part = batch[["k", f"lo{i}", f"hi{i}", f"n{i}"]].set_axis(["k", "lo", "hi", "n"], axis=1)
                part = part[part["n"] > 0]
                if part.empty:
                    continue
                _check(part, last.get(i), flags[i])
                first.setdefault(i, part.iloc[0])
                last[i] = part.iloc[[-1]]
        rows = []
        for i in first:
            ends = (first[i]["lo"], first[i]["hi"], last[i]["lo"].iloc[0], last[i]["hi"].iloc[0])
            rows.append({"variable": columns[i], "at": first[i]["k"], **dict(zip(_EDGES, ends)), **flags[i]})
        if rows:
            yield pd.DataFrame(rows)

    return summarize


def monotonic_profile(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``(variable, increasing, decreasing, strictly_increasing, strictly_decreasing)``.

    For numeric columns. Nulls are skipped. Rows with the same order value may stand in
    any order among themselves, and rule out a strict direction. They are combined before
    the shuffle; each task checks one range of the order column, and the ends of the
    ranges are compared afterwards, one row per task and column.
    """
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    parts = [
        _ranges(df, order, names, value_type)
        for names, value_type in ((whole, "bigint"), ([c for c in columns if c not in whole], "double"))
        if names
    ]
    return reduce(DataFrame.unionByName, [_stitch(p) for p in parts])


def _ranges(df: DataFrame, order: str, columns: list[str], value_type: str) -> DataFrame:
    aggregates = []
    for i, c in enumerate(columns):
        value = present(df, c).cast(value_type)
        # A range without values of this column is passed over, so zero stands in for null.
        aggregates += [
            F.coalesce(F.min(value), F.lit(0).cast(value_type)).alias(f"lo{i}"),
            F.coalesce(F.max(value), F.lit(0).cast(value_type)).alias(f"hi{i}"),
            F.count(value).alias(f"n{i}"),
        ]
    per_key = df.where(F.col(f"`{order}`").isNotNull()).groupBy(F.col(f"`{order}`").alias("k")).agg(*aggregates)
    edges = ", ".join(f"{e} {value_type}" for e in _EDGES)
    flags = ", ".join(f"{f} boolean" for f in _FLAGS)
    key_type = df.schema[order].dataType.simpleString()
    return (
        per_key.repartitionByRange("k")
        .sortWithinPartitions("k")
        .mapInPandas(_summarizer(columns), f"variable string, at {key_type}, {edges}, {flags}")
    )


def _stitch(ranges: DataFrame) -> DataFrame:
    w = Window.partitionBy("variable").orderBy("at")
    prev_lo, prev_hi = F.lag("last_lo").over(w), F.lag("last_hi").over(w)
    joined = ranges.select(
        "variable",
        (F.col("up") & F.coalesce(prev_hi <= F.col("first_lo"), F.lit(True))).alias("up"),
        (F.col("down") & F.coalesce(prev_lo >= F.col("first_hi"), F.lit(True))).alias("down"),
        (F.col("up_strict") & F.coalesce(prev_hi < F.col("first_lo"), F.lit(True))).alias("up_strict"),
        (F.col("down_strict") & F.coalesce(prev_lo > F.col("first_hi"), F.lit(True))).alias("down_strict"),
    )
    return joined.groupBy("variable").agg(
        F.bool_and("up").alias("increasing"),
        F.bool_and("down").alias("decreasing"),
        F.bool_and("up_strict").alias("strictly_increasing"),
        F.bool_and("down_strict").alias("strictly_decreasing"),
    )
