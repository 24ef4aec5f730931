"""Column kinds shared by the profile modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KINDS = ("Numeric", "Categorical", "DateTime", "Boolean")


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return "Numeric"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return "Categorical"


def columns_of_kind(df: DataFrame, kind: str, columns: list[str] | None = None) -> list[str]:
    wanted = df.columns if columns is None else columns
    return [c for c in wanted if kind_of(df.schema[c].dataType) == kind]


def present(df: DataFrame, column: str) -> Column:
    """The column with not-a-number turned into null; nested values as JSON text."""
    dt = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def sql_text(value: str) -> str:
    """A string literal for SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
