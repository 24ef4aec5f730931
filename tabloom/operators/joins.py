"""Joins on keys of which a few may hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import Scratch, written


def split_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", scratch: Scratch | None = None) -> DataFrame:
    """Join whose frequent keys are split between tasks, with a few rows per key in ``one``.

    Adaptive execution splits the large partitions of a sort-merge join, of as many keys as
    are large, but only where both sides come straight from a shuffle for that join. An
    aggregate by the key does not; written first and read back, it does. ``one`` is
    therefore always written, by a job that runs at once, and then read as it is.
    """
    return many.join(written(one, "join-side", scratch), key, how)
