"""Stop-word lists: one fixed English list, Spark's own lists, or the caller's files."""

from __future__ import annotations

import os
from importlib import resources

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F

# The English stop words, one per line of a data file.
_LISTS = resources.files(__package__.split(".")[0]).joinpath("data", "stopwords")
ENGLISH = tuple(_LISTS.joinpath("english.txt").read_text(encoding="utf-8").split())

# Language codes and the names Spark gives its bundled lists.
LANGUAGE_NAMES = {
    "da": "danish",
    "de": "german",
    "en": "english",
    "es": "spanish",
    "fi": "finnish",
    "fr": "french",
    "hu": "hungarian",
    "it": "italian",
    "nl": "dutch",
    "no": "norwegian",
    "pt": "portuguese",
    "ru": "russian",
    "sv": "swedish",
    "tr": "turkish",
}


def stop_words(language: str, folder: str | None = None) -> list[str]:
    """The list for a language code or name.

    A ``folder`` on the driver holds one-word-per-line files named by language, for lists
    of the caller's own, such as Indonesian; a file there wins. Without one, English is
    fixed and the others are Spark's own lists.
    """
    name = LANGUAGE_NAMES.get(language, language)
    if folder:
        for file in (f"{name}.txt", name):
            path = os.path.join(folder, file)
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    return [w.strip().lower() for w in f if w.strip()]
    if name == "english":
        return list(ENGLISH)
    if name not in LANGUAGE_NAMES.values():
        raise ValueError(f"no stop words for {language}: give a folder that holds a list")
    return list(StopWordsRemover.loadDefaultStopWords(name))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``(language, word)`` from a folder of one-word-per-line files named by language."""
    return (
        spark.read.text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), "([^/.]+)(?:\\.[^/]*)?$", 1).alias("language"),
            F.lower(F.trim("value")).alias("word"),
        )
        .where("word <> ''")
    )


def stop_word_frame(spark: SparkSession, words: list[str]) -> DataFrame:
    """A list held by the driver as a one-column DataFrame ``(word)``."""
    return spark.range(1).select(F.explode(F.lit(list(words))).alias("word"))


def stop_word_union(*sets: DataFrame) -> DataFrame:
    """The distinct words of several stop-word sets."""
    merged = sets[0].select("word")
    for other in sets[1:]:
        merged = merged.unionByName(other.select("word"))
    return merged.distinct()
