"""Top words of a text column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import WHITESPACE_RUN
from ..functions.stopwords import ENGLISH

# Fixed value: words reported per catalog.
TOP_WORDS = 50


def word_frequencies(
    df: DataFrame,
    column: str,
    stop: Iterable[str] = ENGLISH,
    stop_frame: DataFrame | None = None,
) -> DataFrame:
    """``(word, frequency)`` for all lower-cased words that are not stop words.

    ``stop`` is checked by a hash lookup before the shuffle. ``stop_frame`` holds a
    further list of any length; it meets the words after they are counted, so a frequent
    word is one row in that join.
    """
    stop = sorted(set(stop))
    words = df.select(F.explode(F.split(F.lower(column), WHITESPACE_RUN)).alias("word")).where("word <> ''")
    if stop:
        words = words.where(~F.col("word").isin(stop))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    if stop_frame is not None:
        counts = counts.join(stop_frame.select("word"), "word", "left_anti")
    return counts


def top_words(
    df: DataFrame,
    column: str,
    n: int = TOP_WORDS,
    where: Column | None = None,
    stop: Iterable[str] = ENGLISH,
    stop_frame: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most frequent words, ties by word, over the rows that pass ``where``."""
    rows = df if where is None else df.where(where)
    counts = word_frequencies(rows, column, stop, stop_frame)
    return counts.orderBy(F.desc("frequency"), "word").limit(n)
