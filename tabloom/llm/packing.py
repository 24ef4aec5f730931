"""Packing of token pieces into sequences of fixed capacity by minimum bin slack.

Pieces of one length are alike, so a packing is a plan over lengths: how often which
combination of lengths fills a sequence. The plan needs no more than the number of pieces
per length, at most one count per token of the capacity however many pieces there are.
For each sequence a subset-sum over the lengths still available, held as the bits of an
integer, finds the fullest combination with the longest piece left; it is taken as often
as the counts allow and removed. The pieces then find their places in Spark: numbered
within their length, they are spread over the combinations that use that length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, slices, small_batches, text_list, with_fields

CAPACITY = 2048
END_ID = 0
# Pieces per bucket in which ranks are counted; the number of buckets grows with the pieces.
BUCKET_ROWS = 2000

# Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_encoding(path: str):
    """An encoder of the byte-level BPE in a tokenizers file, kept by the Python worker.

    Merges of this kind of file are ordered by the id of their result, which a test
    confirms against the tokenizers library; ranked merging gives the same ids in less time.
    """
    if path not in _encodings:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


def encode_ids(path: str, text: str) -> np.ndarray:
    """Ids of a text; special strings in it get their special ids, as the library does by default."""
    return byte_encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def token_pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every piece of every document, and its ``ids`` on request.

    A document is its ids and the end id. Longer ones than the capacity are cut into
    pieces of that length, the first of which may be shorter. Null texts are empty and
    consist of the end id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch, 1):
                part = batch.slice(low, high - low)
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(part.column(0).to_pylist(), text_list(part.column(1))):
                    ids = np.append(encode_ids(path, text), np.uint32(end_id)).astype("<u4", copy=False)
                    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids), capacity), len(ids)]
                    for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
                        piece = ids[start:end]
                        row = [doc_id, k, start, end - start, zlib.crc32(piece.tobytes())]
                        for column, value in zip(out, row + [piece.astype(np.int32)] * with_ids):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, ddl)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; longer lengths are preferred.

    Bit ``s`` of ``reach`` says that some multiset sums to ``s``. Copies of a length enter
    as powers of two, and the search ends when the room can be filled.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n, c in counts.items() if 0 < n <= room and c > 0), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            power = min(power, left)
            layers.append((length, power, reach))
            reach |= reach << length * power & mask
            left, power = left - power, 2 * power
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, power, before in reversed(layers):
        if not before >> total & 1:
            total -= length * power
            used[length] = used.get(length, 0) + power
    return used


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: copies})``: how often each combination fills a sequence, until all pieces are used."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            used = fullest(left, capacity - longest)
            left[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(left[n] // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= times * k
            plan.append((times, used))
        left.pop(longest, None)
    return plan


def _places(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each use of a length by a combination: first rank, first sequence, copies, first offset; sorted for lookup."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in plan:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, seen.get(n, 0), sequence, used[n], offset))
            seen[n] = seen.get(n, 0) + times * used[n]
            offset += n * used[n]
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), columns))


def ranked(pieces: DataFrame, length_col: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``pieces`` with ``_rank``: numbers from 0 within a length, whole over all tasks.

    Rows are counted in buckets of about ``BUCKET_ROWS`` by a hash of the row, so a length
    that very many pieces share is spread; the counts of earlier buckets are added after.
    """
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    by = [F.col(f"`{c}`") for c in order]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    within = Window.partitionBy("_bucket", length_col).orderBy(*by)
    numbered = scratch.write(dealt.repartition("_bucket").withColumn("_within", F.row_number().over(within) - 1), "numbered")
    sizes = numbered.groupBy("_bucket", length_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.write(sizes.select("_bucket", length_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "base")
    # Almost as many counts as pieces, though they compress to little: not a side to broadcast.
    joined = numbered.join(base.hint("merge"), ["_bucket", length_col])
    return joined.withColumn("_rank", F.col("_base") + F.col("_within")).drop("_bucket", "_within", "_base")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: list[str] | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in as few sequences as the plan finds.

    ``pieces`` must be a written table, since it is read more than once. Lengths run from
    1 to the capacity; other lengths, or null, raise. ``order`` names the columns that
    tell pieces of a length apart (all by default); rows equal in all of them may swap
    places. An empty table gives no rows.
    """
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession)
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count(F.lit(1))).limit(capacity + 2).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must run from 1 to {capacity}")
    places = spark.sparkContext.broadcast(_places(packing_plan(counts, capacity), capacity))
    rows = ranked(pieces, length_col, order or pieces.columns, scratch)
    names = [*pieces.columns, "_rank"]
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    at, last = pieces.columns.index(length_col), len(names) - 1
    schema = with_fields(pieces.schema, "sequence_id bigint, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        keys = p["length"] * (1 << 48) + p["rank"]
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(last).to_numpy(zero_copy_only=False)
            use = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            nth = rank - p["rank"][use]
            sequence = p["sequence"][use] + nth // p["copies"][use]
            offset = p["offset"][use] + nth % p["copies"][use] * length
            columns = [*batch.columns[:last], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names[:last], "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of ``docs``.

    Null and empty texts give one piece, the end id; repeated rows give repeated pieces
    with places of their own; columns beside id and text are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(token_pieces(docs, path, capacity, end_id), "pieces")
    return pack(pieces, capacity)
