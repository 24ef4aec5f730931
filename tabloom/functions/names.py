"""Cleaning of table, column and key names, on data and on metadata."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, types as T

# White space as Python's str.split() sees it: Unicode's, and four separators.
# (?U) keeps it one class test per character, several times faster than a list of ranges.
WHITESPACE_CLASS = "\\s\\x1c-\\x1f"
WHITESPACE_RUN = f"(?U)[{WHITESPACE_CLASS}]+"

# What a clean name drops, and where a name in camel case is split.
DROPPED = "[^A-Za-z0-9_]"
CAMEL_EDGE = "([a-z0-9])([A-Z])"


def clean_name(c: Column | str) -> Column:
    """White-space runs to one underscore, other marks dropped, lower case."""
    joined = F.regexp_replace(c, WHITESPACE_RUN, "_")
    return F.lower(F.regexp_replace(joined, DROPPED, ""))


def clean_table_name_expr(c: Column | str) -> Column:
    """As ``clean_name`` but lower-cased first, so letters whose lower form is ASCII survive."""
    joined = F.regexp_replace(F.lower(c), WHITESPACE_RUN, "_")
    return F.regexp_replace(joined, DROPPED, "")


def camel_to_snake(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, CAMEL_EDGE, "$1_$2"))


def clean_name_text(name: str) -> str:
    """``clean_name`` for one name held by the driver."""
    return re.sub(DROPPED, "", re.sub(r"\s+", "_", name)).lower()


def clean_table_name_text(name: str) -> str:
    return re.sub(DROPPED, "", re.sub(r"\s+", "_", name.lower()))


def snake_text(name: str) -> str:
    return re.sub(CAMEL_EDGE, r"\1_\2", name).lower()


def clean_column_names(df: DataFrame, on_collision: str = "raise") -> DataFrame:
    """Rename every column at once.

    Two columns that clean to the same name are an error, or get ``_2``, ``_3`` ...
    when ``on_collision`` is ``"suffix"``.
    """
    cleaned = [clean_name_text(c) for c in df.columns]
    clashes = sorted(n for n, k in Counter(cleaned).items() if k > 1)
    if clashes and on_collision == "raise":
        raise ValueError(f"column names collide after cleaning: {clashes}")
    taken: set[str] = set()
    names = []
    for name in cleaned:
        candidate, i = name, 1
        while candidate in taken or (i > 1 and candidate in cleaned):
            i += 1
            candidate = f"{name}_{i}"
        taken.add(candidate)
        names.append(candidate)
    return df.toDF(*names)


def _snake_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType(
            [T.StructField(snake_text(f.name), _snake_type(f.dataType), f.nullable) for f in dt]
        )
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_snake_type(dt.elementType), dt.containsNull)
    return dt


def snake_case_schema(df: DataFrame) -> DataFrame:
    """Rename all keys to snake case, nested structs and arrays of structs included."""
    return df.select(
        *[F.col(f"`{f.name}`").cast(_snake_type(f.dataType)).alias(snake_text(f.name)) for f in df.schema]
    )
