"""What the operators of this folder share: reading, scratch tables, Arrow batches of texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

from ..session import Scratch, scratch_scope

__all__ = [
    "Scratch", "plain_names", "scratch_scope", "slices", "small_batches", "table", "text_bytes", "text_list", "with_fields",
    "word_lists",
]

# Texts per Arrow batch, and bytes of text that a task looks at together.
BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20
# Bytes of one text that are split into words together.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named ``c0``, ``c1`` and so on, and what each is called there.

    Operators add columns whose names start with an underscore; whatever the caller's
    columns are called, they cannot clash with those.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    """A schema with more fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a lower setting of the session is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, nulls as empty texts."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def text_list(column: pa.Array) -> list[str]:
    """Every text, nulls as empty texts."""
    return ["" if t is None else t for t in column.to_pylist()]


def word_lists(text: bytes, plain: bytes, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``most`` bytes each, so that a huge text is never split at once.

    ``plain`` translates bytes; what it turns into spaces stands between words.
    """
    at = 0
    while at < len(text):
        end = at + most
        piece = text[at:end].translate(plain)
        # Take the rest of a word that the cut goes through.
        while end < len(text) and not piece.endswith(b" "):
            more = text[end : end + 4096].translate(plain)
            stop = more.find(b" ") + 1
            more = more[:stop] if stop else more
            piece += more
            end += len(more)
        at = end
        words = piece.split()
        if words:
            yield words
