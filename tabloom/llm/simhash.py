"""Near-duplicates by SimHash: fingerprints, and links found by shared bytes at their positions.

Two fingerprints of eight bytes that differ in at most ``d`` bits agree in at least
``8 - d`` bytes at the same positions. The inverted index therefore lists fingerprints
under their positional bytes, and a pair is looked at only when its tally of shared bytes
reaches that minimum. Lists of single bytes would hold a 256th of everything, so the index
holds the intersections of lists: one entry per choice of ``8 - d`` positions. All
fingerprints of an entry share those bytes, and at most ``256 ** d`` can differ in the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, plain_names, slices, small_batches, text_bytes
from .graph import connected_components

BYTES = 8
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = b" ".join(words)
    last = max(len(words) - shingle, 0)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    counts, total = np.zeros(64, np.int64), last + 1
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, total)
    for at in range(0, total, BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8", copy=False)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, same)`` per row: the fingerprint as a signed long, 0 for null texts, and a hash of the whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                fps = np.array([fingerprint(t, shingle) for t in text_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), part.column(2)], ["doc_id", "fp", "same"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, same bigint")


def postings(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(kept, shared, fp)``: every fingerprint under each choice of positions whose bytes a partner must share."""
    masks = []
    for free in combinations(range(BYTES), max_bits):
        mask = (1 << 64) - 1
        for at in free:
            mask ^= 0xFF << (8 * at)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    listed = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("kept", "mask")
    return prints.select("fp", listed).select(F.col("kept").cast("tinyint"), F.expr("fp & mask").alias("shared"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """Number of zero bytes of each difference: the bytes that a pair shares at their positions."""
    return (x.astype("<u8", copy=False).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def entry_links(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within one entry of the index, as a forest: each fingerprint with the root of its linked group.

    Partners are probed by the bit patterns they may differ in, so an entry of ``n``
    fingerprints costs ``n`` times a constant, and the pairs found are verified.
    """
    prints = np.sort(prints)
    spread = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [np.uint64(1 << b) for b in range(64) if int(spread) >> b & 1]
    left, right = [], []
    for k in range(1, max_bits + 1):
        for some in combinations(bits, k):
            other = prints ^ np.bitwise_or.reduce(np.array(some, np.uint64))
            at = np.searchsorted(prints, other)
            at[at == len(prints)] = 0
            hit = np.flatnonzero((prints[at] == other) & (prints < other))
            left.append(hit)
            right.append(at[hit])
    u, v = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    diff = prints[u] ^ prints[v]
    good = (_shared_bytes(diff) >= BYTES - max_bits) & (_popcount(diff) <= max_bits)
    u, v = u[good], v[good]
    root = np.arange(len(prints))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return prints[moved], prints[root[moved]]


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp_a, fp_b)``: links that join exactly the distinct fingerprints reachable by ``max_bits`` or fewer bits.

    Each row comes from a forest of verified pairs of one index entry, so an entry gives
    fewer rows than it has fingerprints, however densely they are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            two = starts[size == 2]
            a, b = flat[two], flat[two + 1]
            diff = a ^ b
            good = (_shared_bytes(diff) >= BYTES - max_bits) & (_popcount(diff) <= max_bits)
            left, right = [a[good]], [b[good]]
            for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
                u, v = entry_links(flat[s : s + n], max_bits)
                left.append(u)
                right.append(v)
            out = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(out, ["fp_a", "fp_b"])

    entries = postings(prints.select("fp"), max_bits).groupBy("kept", "shared").agg(F.collect_list("fp").alias("prints"))
    return entries.where(F.size("prints") > 1).select("prints").mapInArrow(run, "fp_a bigint, fp_b bigint").distinct()


def _classes(prints: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """``(fp, component, component_id)`` of the different fingerprints of a written table; ``component`` is a fingerprint."""
    classes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    links = scratch.write(fingerprint_links(classes, max_bits), "links")
    # Components of fingerprints; the least doc_id over the classes of a component names it.
    parts = connected_components(links, "fp_a", "fp_b")
    labelled = scratch.write(classes.join(parts, F.col("fp") == F.col("id"), "inner").select("fp", "component", "first_id"), "labelled")
    least = scratch.write(labelled.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    named = labelled.join(least, "component").select("fp", "component", "component_id")
    alone = F.col("component").isNull()
    of = classes.join(named, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    of = scratch.write(of, "components")
    scratch.drop(classes, links, labelled, least)
    return of


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Documents with one fingerprint are first merged into a class, so copies never meet as
    pairs; classes are linked through the index and joined to components. The component's
    id is the smallest ``doc_id`` in it. Texts without words, null texts included, have
    fingerprint zero and are linked like any other. Rows with a null id get a fingerprint
    and a component but name none; a component of such rows alone has a null id. Repeated
    rows stay. Columns of ``docs`` beside id and text are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    of = _classes(prints, max_bits, scratch)
    # Both sides are scans, so adaptive execution can split a fingerprint of very many documents.
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Rows to drop that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the least ``doc_id``, null ids last.

    Ids need not be unique: rows of one id and one component are told apart by a hash of
    their text, the least of which stays, and of rows that agree in both one stays. So no
    component is lost and none keeps two rows. An empty table gives no rows. Decisions are
    taken on ids and hashes; texts are read once more for the join with the rows to drop,
    which is a broadcast of ids up to ``BROADCAST_ROWS``.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, "doc_id", "text", shingle), "fingerprints")
    rows_of = prints.groupBy("fp", "doc_id", "same").agg(F.count(F.lit(1)).alias("n"))
    rows_of = scratch.write(rows_of.join(_classes(prints, max_bits, scratch), "fp").select("component", "doc_id", "same", "n"), "rows-of")
    least = rows_of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "same")).alias("one"))
    # Both sides are scans, so a component of very many rows is split between tasks.
    judged = rows_of.join(scratch.write(least, "least"), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("same") == F.col("one.same"))
    judged = scratch.write(judged.select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "n", stays.alias("stays")).where("NOT stays OR n > 1"), "judged")

    rows, named = plain_names(docs)
    key = F.col(named["doc_id"]).cast("bigint")
    hashed = rows.withColumns({"_own_id": key, "_own_same": F.xxhash64(F.col(named["text"]).cast("string"))})
    match = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_same") == F.col("_same"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, match, how)

    kept = joined(hashed, judged.where("NOT stays").select("_id", "_same"), "left_anti")
    again = judged.where("stays").select("_id", "_same")
    if not again.isEmpty():
        # Rows repeated in id and text: any other columns decide, by a hash of the whole row.
        own = [F.col(c) for c in rows.columns]
        twice = joined(kept, again, "left_semi").withColumn("_order", F.xxhash64(F.to_json(F.struct(*own))))
        one = twice.groupBy("_own_id", "_own_same").agg(F.min_by(F.struct(*own), "_order").alias("_row")).select("_row.*")
        kept = joined(kept, again, "left_anti").select(*rows.columns).unionByName(one)
    return kept.select(*rows.columns).toDF(*docs.columns)
