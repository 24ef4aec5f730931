"""Token sequences in training order: fixed-stride shards whose order is a keyed permutation.

Sequences are numbered as they lie in a written table. A Feistel network over the next
power of four, walked along its cycles until it falls below the number of sequences, gives
each one its slot: a permutation that any task computes for its own rows from the key
alone. Slots are cut into ranges; each range is one partition and one shard of binary ids
at a fixed stride, so the place of every slot is known, and reading is sequential and can
be taken up at any slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, slices, small_batches, text_list
from .packing import END_ID, encode_ids
from .warc import _filesystem

LENGTH = 2048
SHARD_SEQUENCES = 8192
KEY = 20240607
FEISTEL_ROUNDS = 6
# Tasks that may write sequences: the bound of the table of their first numbers.
MOST_PARTS = 1 << 20
# Bytes of ids that a task holds before it sends them to their shards.
HELD_BYTES = 48 << 20


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A well spread 64-bit function of each number and a salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, total: int, key: int = KEY, rounds: int = FEISTEL_ROUNDS) -> np.ndarray:
    """The slot of each sequence number below ``total``; different numbers have different slots below ``total``."""
    half = max((max(total - 1, 1).bit_length() + 1) // 2, 1)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    salts = [(key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64) for r in range(rounds)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for salt in salts:
            left, right = right, left ^ (_mixed(right, salt) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, number, doc_ids, start, n_tokens, ids)``: the texts of each task end to end, in sequences of ``length`` ids.

    A document is its ids and the end id. ``start`` counts the ids of the first document
    that stand in earlier sequences. Only the last sequence of a task may be shorter; it is
    filled with the end id, and ``n_tokens`` tells how many ids count. Ids are two-byte
    little-endian numbers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, ends = np.zeros(0, np.uint32), []  # ids not yet cut, and (doc_id, its first place, place after its last) in them

        def cut(all_of_it: bool) -> pa.RecordBatch:
            nonlocal ids, ends, number
            out: list[list] = [[] for _ in schema]
            at, first = 0, 0
            while len(ids) - at >= length or (all_of_it and at < len(ids)):
                stop = min(at + length, len(ids))
                piece = np.full(length, end_id, "<u2")
                piece[: stop - at] = ids[at:stop]
                while ends[first][2] <= at:
                    first += 1
                last = first
                while last < len(ends) and ends[last][1] < stop:
                    last += 1
                row = (part, number, [d for d, _, _ in ends[first:last]], at - ends[first][1], stop - at, piece.tobytes())
                for column, value in zip(out, row):
                    column.append(value)
                at, number = stop, number + 1
            ids = ids[at:]
            ends = [(d, a - at, b - at) for d, a, b in ends[first:] if b > at]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for low, high in slices(batch, 1):
                piece = batch.slice(low, high - low)
                held, at = [ids], len(ids)
                for doc, text in zip(piece.column(0).to_pylist(), text_list(piece.column(1))):
                    own = np.append(encode_ids(path, text), np.uint32(end_id))
                    if own.max() > 0xFFFF:
                        raise ValueError("ids of this tokenizer need more than two bytes")
                    held.append(own)
                    ends.append((doc, at, at + len(own)))
                    at += len(own)
                ids = np.concatenate(held)
                yield cut(False)
        if len(ids):
            yield cut(True)

    return rows.mapInArrow(run, "part int, number bigint, doc_ids array<bigint>, start bigint, n_tokens bigint, ids binary")


def _firsts(table: DataFrame) -> tuple[np.ndarray, int]:
    """The number of sequences before those of each task, and of all. One short row per task comes to the driver."""
    counts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).limit(MOST_PARTS + 1).collect()
    if len(counts) > MOST_PARTS or any(r["part"] >= MOST_PARTS for r in counts):
        raise ValueError(f"more than {MOST_PARTS} tasks wrote sequences; read the documents in fewer partitions")
    size = np.zeros(max((r["part"] for r in counts), default=-1) + 2, np.int64)
    for r in counts:
        size[r["part"] + 1] = r["n"]
    return np.cumsum(size), int(size.sum())


def _with_slots(table: DataFrame, firsts, total: int, key: int, columns: list[str]) -> DataFrame:
    """``slot`` and some columns of each sequence."""
    fields = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            slot = slots(firsts.value[part] + number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[2:]], ["slot", *columns])

    return table.select("part", "number", *columns).mapInArrow(run, ", ".join(["slot bigint", *fields]))


def write_shards(table: DataFrame, folder: str, scratch: Scratch, length: int = LENGTH, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Write the ids of ``sequences``, a written table, to shards; ``(shard, file, first_slot, n_sequences, crc32)`` comes back, written.

    A task packs the sequences it reads by shard, so what moves is compressed once; the
    task of a shard fills one buffer of the shard's size and writes it under a name of its
    own attempt. Files that no row names, from lost or repeated attempts, are not read.
    """
    spark = table.sparkSession
    firsts, total = _firsts(table)
    shared, stride = spark.sparkContext.broadcast(firsts), 2 * length
    shards = -(-total // shard_sequences)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            slot = np.concatenate([s for s, _ in held])
            ids = np.concatenate([x for _, x in held])
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            to = slot // shard_sequences
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = np.append(first[1:], len(to))
            columns = [
                pa.array(to[first].astype(np.int32)),
                pa.array([slot[a:b].tolist() for a, b in zip(first, ends)], pa.list_(pa.int64())),
                pa.array([squeeze.compress(ids[order[a:b]].tobytes()) for a, b in zip(first, ends)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "slots", "packed"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, stride)
            held.append((slots(shared.value[part] + number, total, key), ids))
            if sum(x.nbytes for _, x in held) >= HELD_BYTES:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        unpack = zstandard.ZstdDecompressor()
        now, buffer, seen = None, None, None

        def written() -> pa.RecordBatch:
            n = min(shard_sequences, total - now * shard_sequences)
            if not seen[:n].all():
                raise ValueError(f"shard {now} lacks sequences")
            data = buffer[:n].tobytes()
            name = f"shard-{now:08d}-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = (now, name, now * shard_sequences, n, zlib.crc32(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for shard, slot, packed in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != now:
                    if now is not None:
                        yield written()
                    now, seen = shard, np.zeros(shard_sequences, bool)
                    buffer = np.zeros((shard_sequences, stride), np.uint8) if buffer is None else buffer
                at = np.array(slot, np.int64) - shard * shard_sequences
                buffer[at] = np.frombuffer(unpack.decompress(packed), np.uint8).reshape(-1, stride)
                seen[at] = True
        if now is not None:
            yield written()

    names = ["shard", "file", "first_slot", "n_sequences", "crc32"]
    dealt = table.select("part", "number", "ids").mapInArrow(deal, "shard int, slots array<bigint>, packed binary")
    # A shard is a range of slots and a partition of its own.
    ranges = dealt.repartitionById(max(shards, 1), F.col("shard")).sortWithinPartitions("shard")
    manifest = ranges.mapInArrow(fill, "shard int, file string, first_slot bigint, n_sequences bigint, crc32 bigint")
    return scratch.write(manifest, "manifest")


def read_shards(manifest: DataFrame, folder: str, length: int = LENGTH, from_slot: int = 0) -> DataFrame:
    """``(slot, shard, byte_offset, ids)`` from ``from_slot`` on, each shard read from front to back."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for shard, name, first, n in zip(*[c.to_pylist() for c in batch.columns]):
                skip = max(from_slot - first, 0)
                with system.open_input_file(f"{root}/{name}") as stream:
                    stream.seek(skip * stride)
                    while skip < n:
                        most = min(256, n - skip)
                        data = stream.read(most * stride)
                        slot = np.arange(skip, skip + most)
                        rows = [data[i * stride : (i + 1) * stride] for i in range(most)]
                        columns = [pa.array(first + slot), pa.array(np.full(most, shard, np.int32)), pa.array(slot * stride), pa.array(rows, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "ids"])
                        skip += most

    wanted = manifest.where(F.col("first_slot") + F.col("n_sequences") > from_slot).select("shard", "file", "first_slot", "n_sequences")
    return wanted.mapInArrow(run, "slot bigint, shard int, byte_offset bigint, ids binary")


def training_order(
    docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES, folder: str | None = None
) -> DataFrame:
    """``(slot, shard, byte_offset, n_tokens, doc_ids, start, ids_crc32)`` of every sequence, from shards read back.

    Null and empty texts are the end id alone; repeated rows and null ids stay; an empty
    table writes no shard and gives no rows; columns beside id and text are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    folder = folder or scratch.path("shards")
    table = scratch.write(sequences(docs, path, length), "sequences", compression="zstd")
    manifest = write_shards(table, folder, scratch, length, key, shard_sequences)
    firsts, total = _firsts(table)
    told = _with_slots(table, spark.sparkContext.broadcast(firsts), total, key, ["n_tokens", "doc_ids", "start"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(b) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["slot", "shard", "byte_offset", "ids_crc32"])

    spread = manifest.repartition(max(1, manifest.count()))
    back = read_shards(spread, folder, length).mapInArrow(digest, "slot bigint, shard int, byte_offset bigint, ids_crc32 bigint")
    # Both sides grow with the sequences, which the size of a manifest does not show.
    return back.join(told.hint("merge"), "slot").select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", "start", "ids_crc32")
