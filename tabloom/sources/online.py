"""Rows kept in an online store, given as DataFrames of payloads or set members."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _objects(kind: Column | str, payload: Column | str) -> Column:
    """The JSON texts of a payload's objects.

    A ``string`` payload is a JSON array of objects, a ``list`` payload is one element of
    a list and holds one object; other kinds have none.
    """
    kind = F.col(kind) if isinstance(kind, str) else kind
    payload = F.col(payload) if isinstance(payload, str) else payload
    texts = F.when(kind == "string", F.from_json(payload, "array<string>")).when(kind == "list", F.array(payload))
    return F.coalesce(texts, F.array().cast("array<string>"))


def payload_schema(df: DataFrame, kind: Column | str, payload: Column | str) -> str:
    """The fields of all objects of all payloads, as the DDL of their columns.

    Types of a field that differ between payloads are widened; the schema is one
    mergeable aggregate, and fields that are null everywhere are strings.
    """
    objects = df.select(F.explode(_objects(kind, payload)).alias("o"))
    found = objects.agg(F.schema_of_variant_agg(F.try_parse_json("o")).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        raise ValueError("the payloads hold no JSON objects")
    quoted = re.split("(`(?:[^`]|``)*`)", found)
    # Type names as the JSON reader spells them; fractions are read as doubles.
    spelling = {r"\bOBJECT<": "STRUCT<", r"\bVOID\b(?!:)": "STRING", r"\bDECIMAL\(\d+, ?\d+\)": "DOUBLE"}
    spelled = [p if p[:1] == "`" else reduce(lambda t, x: re.sub(*x, t), spelling.items(), p) for p in quoted]
    return "".join(spelled)[len("STRUCT<") : -1]


def json_rows(df: DataFrame, kind: Column | str, payload: Column | str, schema: str | None = None, keep: list[str] = ()) -> DataFrame:
    """One row per JSON object of a payload; other kinds give no rows.

    Without a ``schema`` the fields of all payloads are found first. ``keep`` names columns
    carried along.
    """
    schema = schema or payload_schema(df, kind, payload)
    rows = df.select(*keep, F.explode(_objects(kind, payload)).alias("_text"))
    return rows.select(*keep, F.from_json("_text", f"struct<{schema}>").alias("_row")).select(*keep, "_row.*")


def set_members(df: DataFrame, member: Column | str) -> DataFrame:
    """``(key, value)``: the whole member, and its text after the last colon."""
    member = F.col(member) if isinstance(member, str) else member
    return df.select(member.alias("key"), F.substring_index(member, ":", -1).alias("value"))
