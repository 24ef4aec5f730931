"""Importance resampling towards a target: documents drawn by hashed n-gram weights and Gumbel noise.

Features of a text are its words and pairs of neighbouring words, hashed into ``BUCKETS``
buckets by CRC-32. Spark counts the buckets of the corpus and of the target; the log ratio
of the two is a bucket's gain, one small array that tasks share. A text's weight is the
mean gain of its features, found by array lookups, and its score is the weight plus noise
that depends on its id alone.

The highest scores are drawn without a global sort. The scored rows are written once; then
jobs count exactly how many rows lie at or above a set of thresholds and narrow the range
until one score is left, and the same way the ``doc_id`` up to which rows of that score are
drawn. Only drawn rows are then range-partitioned and numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, plain_names, small_batches, text_bytes, with_fields, word_lists

BUCKETS = 10000
# Of the texts of so many words or more, so many in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
# Gains, weights and scores are whole thousandths.
SCALE = 1000

# Words remembered by a task, thresholds counted by one job.
REMEMBERED = 1 << 19
PROBES = 32

# Letters, digits and all that is not ASCII stay; capitals become small, the rest white.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _zero_runs(longest: int) -> np.ndarray:
    """``t[n, k, b]``: what byte ``b`` at place ``k`` of a CRC-32 becomes when ``n`` bytes follow.

    A CRC of joined texts is that of the first, moved on by the length of the second, XOR
    that of the second; moving is linear, so a number's bytes can be looked up one by one.
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = out[n] >> 8 ^ step[out[n] & 255]
    return out


# Pairs whose second word is longer are hashed one by one.
_LONGEST = 47
_MOVED = _zero_runs(_LONGEST + 1)


class _Hashes(dict):
    """CRC-32 of each word, and in the upper half that of the word after a space."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = both = zlib.crc32(word) | zlib.crc32(b" " + word) << 32
        return both


def _linked(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text, list by list, and whether a list is the first; others open with the last word before."""
    last: list[bytes] = []
    for words in word_lists(text, _PLAIN):
        yield last + words, not last
        last = words[-1:]


def _buckets(words: list[bytes], first: bool, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs; a word carried over from the piece before counts only in a pair."""
    both = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    own = both.astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))[1:] + 1
    x, t = own[:-1], np.minimum(size, _LONGEST + 1)
    pairs = (both[1:] >> np.uint64(32)).astype(np.uint32)
    for k in range(4):
        pairs = pairs ^ _MOVED[t, k, x >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(size > _LONGEST + 1).tolist():
        pairs[i] = zlib.crc32(words[i] + b" " + words[i + 1])
    return (own if first else own[1:]) % np.uint32(BUCKETS), pairs % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Features of all texts in each bucket. Each task sends its own sums, and the driver gets one row a bucket."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = np.zeros(BUCKETS, np.int64), _Hashes()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                for words, first in _linked(text):
                    for found in _buckets(words, first, hashes):
                        held += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in target and corpus, in whole thousandths."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())]
    )


def gumbel(doc_id: int | None) -> int:
    """The noise of an id, from its hash; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, keep: list[str], id_col: str, text_col: str, gains: np.ndarray) -> DataFrame:
    """The columns ``keep`` with ``_doc_id``, ``_n_words``, ``_n_features``, ``_weight`` and ``_score`` of every row."""
    small_batches(docs.sparkSession)
    names = ["_n_words", "_n_features", "_weight", "_score"]
    rows = docs.select(
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.col(f"`{id_col}`").cast("bigint").alias("_doc_id"),
        *[F.col(f"`{c}`") for c in keep],
    )
    schema = with_fields(rows.drop("_text").schema, ", ".join(f"{n} bigint" for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc_id, text in zip(batch.column(1).to_pylist(), text_bytes(batch.column(0))):
                n = features = total = 0
                for words, first in _linked(text):
                    for k, found in enumerate(_buckets(words, first, hashes)):
                        n += len(found) if k == 0 else 0
                        features += len(found)
                        total += int(gains[found].sum())
                weight = total // features if features else 0
                out.append((n, features, weight, weight + gumbel(doc_id)))
            more = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def lowest_reaching(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int]:
    """The least ``v`` such that ``wanted`` rows have ``key <= v``, and how many rows lie below it.

    Each job counts ``PROBES`` thresholds exactly, and the range shrinks by as much.
    """
    ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    low, high = int(ends["a"]) - 1, int(ends["b"])  # fewer than wanted up to low, enough up to high
    while high - low > 1:
        step = max((high - low) // PROBES, 1)
        probes = list(range(low + step, high, step))
        counts = rows.agg(*[F.count_if(key <= F.lit(p).cast("decimal(20,0)")).alias(f"n{i}") for i, p in enumerate(probes)]).first()
        enough = next((i for i in range(len(probes)) if counts[i] >= wanted), len(probes))
        high = probes[enough] if enough < len(probes) else high
        low = probes[enough - 1] if enough else low
    return high, rows.where(key < F.lit(high).cast("decimal(20,0)")).count()


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores``, a written table, with ``_rank``: 1, 2, 3 ... of the drawn rows, null for the others.

    Higher scores come first, then smaller ids, null ids last, then fewer features. Rows
    that agree in all these have equal results, so it does not matter which is drawn.
    """
    far = F.lit(2**63 - 1).cast("bigint")
    # Decimals, so that no negation and no threshold leaves the range of a long.
    keys = [-F.col("_score").cast("decimal(20,0)"), F.coalesce("_doc_id", far).cast("decimal(20,0)"), F.col("_n_features").cast("decimal(20,0)")]
    fit = F.col("_n_words") >= least_words
    left = wanted = percent * scores.where(fit).count() // 100
    rank = F.lit(None).cast("bigint").alias("_rank")
    if not wanted:
        return scores.select("*", rank)
    ties, cut = scores.where(fit), []
    for key in keys:
        value, below = lowest_reaching(ties, key, left)
        value = F.lit(value).cast("decimal(20,0)")
        cut.append((key, value))
        ties, left = ties.where(key == value), left - below
    drawn = cut[-1][0] <= cut[-1][1]
    for key, value in cut[-2::-1]:
        drawn = (key < value) | ((key == value) & drawn)
    drawn = fit & drawn
    # Equal rows, of which there may be many, are told apart by their place in the table.
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = scores.where(drawn).withColumns(named | {"_place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*named, "_place").sortWithinPartitions(*named, "_place").drop(*named, "_place")
    numbered = Scratch(scores.sparkSession).write(
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)),
        "drawn",
    )
    # One row per range; the rows of the ranges before stand before a range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") + 1
    numbered = numbered.join(F.broadcast(parts), "_part").withColumn("_rank", F.when(place <= wanted, place))
    return numbered.select(*scores.columns, "_rank").unionByName(scores.where(~drawn).select("*", rank))


def resampling_report(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank, n_words)`` of every row of ``docs``; ``rank`` is null where not drawn.

    Null and empty texts have no features and weight 0, and are never drawn. A null id has
    the noise of an empty text and comes last among equal scores. Repeated rows count and
    are drawn each for itself. An empty table gives no rows, an empty target gains from
    smoothing alone. Columns beside id and text are not looked at.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    scores = Scratch(docs.sparkSession).write(scored(docs, [], id_col, text_col, gains), "scores")
    done = ranked(scores)
    return done.select(F.col("_doc_id").alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in ("n_features", "weight", "score", "rank", "n_words")])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, with its columns, whatever they are called. Cases are those of ``resampling_report``."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    rows, named = plain_names(docs)
    scores = Scratch(docs.sparkSession).write(scored(rows, rows.columns, named[id_col], named[text_col], gains), "scores")
    return ranked(scores, percent).where("_rank IS NOT NULL").select(*rows.columns).toDF(*docs.columns)
