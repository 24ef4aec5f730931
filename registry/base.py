"""Registration of queries, and SQL pieces shared by their counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}

# White space and tokens in RE2 spelling, which has no Unicode-aware classes.
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CLASS}]+"
TOKEN = rf"([\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{WS_CLASS}])"


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query and its SQL; SQL that needs files is made by a function, when it is asked for."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if callable(sql) else sql.strip()
        return fn

    return register


def oracles() -> dict[str, str]:
    """All SQL counterparts as texts."""
    return {name: sql().strip() if callable(sql) else sql for name, sql in ORACLES.items()}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def sql_list(items: Iterable[str]) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def settled(c: Column | str) -> Column:
    """Round a double far below its size, so the order of summation does not show."""
    c = F.col(c) if isinstance(c, str) else c
    # Adding zero turns a negative zero into a plain one.
    return F.when(F.abs(c) >= 1e6, F.round(c, -1)).when(F.abs(c) >= 1e3, F.round(c, 4)).otherwise(F.round(c, 6)) + 0.0


def settled_sql(expr: str) -> str:
    return (
        f"CASE WHEN abs({expr}) >= 1e6 THEN round({expr}, -1) "
        f"WHEN abs({expr}) >= 1e3 THEN round({expr}, 4) ELSE round({expr}, 6) END + 0.0"
    )


def settle(df: DataFrame) -> DataFrame:
    """``settled`` on all doubles of a result."""
    return df.select(
        *[settled(f"`{f.name}`").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema]
    )


def texts(df: DataFrame) -> DataFrame:
    """All columns as strings."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def texts_sql(columns: Iterable[str]) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
