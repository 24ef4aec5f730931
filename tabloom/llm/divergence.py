"""Source divergence audit: how the terms of each source differ from those of other sources and of the language.

The first pass counts exactly in how many documents of a language each term stands, and
frequent terms are kept. They are dealt into shards of about ``SHARD_TERMS`` by hash, and
each shard becomes a minimal perfect hash: levels of bit arrays that give every kept term
a slot of its own without gaps, and the terms themselves in slot order. A term that was
not kept falls on some slot too, so a slot counts only if the stored term is the same.

The second pass counts occurrences into dense arrays, one number per slot and group of
language and source. Tasks get the perfect hashes by broadcast, as much as ``BROADCAST``
bytes at a time; the size is known before. If the hashes are larger, each task's counts
by term are written once, split by shard groups, and every group of shards is broadcast
in turn and reads its part only.

Distances between all sources of a language come from blocks of slots: a task holds one
block of at most two tiles of sources as a dense matrix.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, small_batches, text_bytes, word_lists

# A term is kept where so many documents of its language hold it; terms listed per group.
LEAST_DOCS, TOP_TERMS = 30, 50
# Shares are whole billionths, and every kept term gets so many occurrences more.
UNIT, SMOOTH = 1_000_000_000, 5

# Terms of a shard, and bytes of shards that are broadcast at a time.
SHARD_TERMS = 1 << 14
BROADCAST = 64 << 20
# Levels of a perfect hash; terms that still collide then are few and are listed.
LEVELS = 24
# Terms that a task counts, and slots that it holds, before it passes them on.
GATHER, SLOTS = 1 << 19, 1 << 23
# Slots and sources that a task compares at a time.
BLOCK, TILE = 4096, 128

# Letters and all that is not ASCII stay; capitals become small, the rest white.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def hashes_of(terms: list[bytes]) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms))


def _mixed(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places of hashes on a level."""
    x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 of n different terms, with the terms, so that others are told apart."""

    def __init__(self, terms: list[bytes]):
        h, at = hashes_of(terms), np.arange(len(terms))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slot, base = np.zeros(len(terms), np.int64), 0
        for level in range(LEVELS):
            if not len(at):
                break
            size = 2 * len(at) + 64 - 2 * len(at) % 64
            place = _mixed(h[at], level, size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = base + np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((size, words, before))
            done = alone[place]
            slot[at[done]] = self._ranks(words, before, place[done])
            base += int(done.sum())
            at = at[~done]
        slot[at] = base + np.arange(len(at))
        # Two terms of one hash never part; such terms stand in a list.
        self.rest = {terms[i]: int(slot[i]) for i in at.tolist()}
        order = np.empty(len(terms), np.int64)
        order[slot] = np.arange(len(terms))
        self.terms = pa.array([terms[i] for i in order.tolist()], pa.binary())

    @staticmethod
    def _ranks(words: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
        low = words[place >> 6] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return before[place >> 6] + np.bitwise_count(low)

    def slots(self, terms: list[bytes], h: np.ndarray) -> np.ndarray:
        """Slots of terms, whose hashes are ``h``; -1 for terms that are not kept."""
        slot, todo = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (size, words, before) in enumerate(self.levels):
            place = _mixed(h[todo], level, size)
            hit = (words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            slot[todo[hit]] = self._ranks(words, before, place[hit])
            todo = todo[~hit]
        for i in todo.tolist():
            slot[i] = self.rest.get(terms[i], -1)
        # The stored term decides.
        at = np.flatnonzero(slot >= 0)
        same = pc.equal(self.terms.take(pa.array(slot[at])), pa.array([terms[i] for i in at.tolist()], pa.binary()))
        slot[at[~same.to_numpy(zero_copy_only=False)]] = -1
        return slot


class Vocabulary:
    """Perfect hashes of the shards of a group, by language; slots are numbered through a language."""

    def __init__(self, rows: list[dict]):
        self.shards: dict[str, tuple[int, dict[int, tuple[int, PerfectHash]]]] = {}
        for r in rows:
            own = self.shards.setdefault(r["lang"], (r["shards"], {}))[1]
            own[r["shard"]] = r["base"], pickle.loads(r["hash"])

    def slots(self, lang: str, terms: list[bytes]) -> np.ndarray:
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.shards:
            return out
        of, own = self.shards[lang]
        h = hashes_of(terms)
        shard = h.view(np.int64) % of
        for k in np.unique(shard).tolist():
            if k in own:
                at = np.flatnonzero(shard == k)
                found = own[k][1].slots([terms[i] for i in at.tolist()], h[at])
                out[at] = np.where(found < 0, -1, found + own[k][0])
        return out


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    columns = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term)``: the terms that stand in at least ``least_docs`` texts of a language, exactly counted."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(own.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                distinct: set[bytes] = set()
                for words in word_lists(text, _PLAIN):
                    distinct.update(words)
                held.setdefault(lang, Counter()).update(distinct)
                if sum(map(len, held.values())) > GATHER:
                    yield from counted()
        yield from counted()

    rows = texts.select("lang", "text").mapInArrow(run, "lang string, term binary, n bigint")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def perfect_hashes(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, shard, shards, base, n, bytes, hash, terms)``: a row per shard; ``terms`` in slot order from ``base`` on."""

    def build(shard: pa.Table) -> pa.Table:
        made = PerfectHash(shard.column("term").to_pylist())
        data = pickle.dumps(made)
        first = shard.slice(0, 1).select(["lang", "shard", "shards"])
        more = {"n": pa.array([len(made.terms)], pa.int64()), "hash": pa.array([data], pa.binary()), "terms": pa.array([made.terms.to_pylist()], pa.list_(pa.binary()))}
        for name, column in more.items():
            first = first.append_column(name, column)
        return first

    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("bigint").alias("shards"))
    dealt = kept.join(scratch.write(sizes, "shard-counts"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    schema = "lang string, shard bigint, shards bigint, n bigint, hash binary, terms array<binary>"
    made = scratch.write(dealt.groupBy("lang", "shard").applyInArrow(build, schema), "hashes")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = made.select("lang", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return scratch.write(made.join(base, ["lang", "shard"]).withColumn("bytes", F.length("hash")), "shards")


def term_counts(texts: DataFrame, shards: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, source, slot, n)``: occurrences of the kept terms in each group, rows for those that occur.

    ``shards`` is a written table. Groups of shards of ``BROADCAST`` bytes are broadcast one
    after the other; with one group, texts are counted and looked up in the same task.
    """
    spark = texts.sparkSession
    small_batches(spark)
    # One short row per shard: the driver deals them into groups.
    group, room, groups = 0, BROADCAST, {}
    for r in shards.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():
        if r["bytes"] > room:
            group, room = group + 1, BROADCAST
        groups.setdefault(group, []).append((r["lang"], r["shard"]))
        room -= r["bytes"]

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], Counter]]:
        """Counts of the terms of each group, passed on before they grow too many."""
        held: dict[tuple[str, str], Counter] = {}
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, text in zip(langs, sources, text_bytes(batch.column(2))):
                own = held.setdefault((lang, source), Counter())
                for words in word_lists(text, _PLAIN):
                    own.update(words)
                    if sum(map(len, held.values())) > GATHER:
                        yield held
                        held = {}
                        own = held.setdefault((lang, source), Counter())
        yield held

    def written_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_term(batches):
            for (lang, source), own in held.items():
                columns = [pa.array([x] * len(own), pa.string()) for x in (lang, source)]
                columns += [pa.array(list(own), pa.binary()), pa.array(own.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n"])

    def read_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], Counter]]:
        for batch in batches:
            held: dict[tuple[str, str], Counter] = {}
            for lang, source, term, n in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault((lang, source), Counter())[term] += n
            yield held

    def recount(rows: DataFrame, counted, which: list[tuple[str, int]]) -> DataFrame:
        """Occurrences by slot of the shards ``which``, summed in tasks and then over tasks."""
        in_group = reduce(lambda a, b: a | b, [(F.col("lang") == lang) & F.col("shard").isin(*own) for lang, own in _by_first(which).items()])
        held = shards.where(in_group).select("lang", "shard", "shards", "base", "hash").toArrow().to_pylist()
        ends = {}
        for r in shards.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            ends[r["lang"]] = r["n"]
        shared = spark.sparkContext.broadcast(Vocabulary(held))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, known = shared.value, {}
            dense: dict[tuple[str, str], np.ndarray] = {}

            def passed_on() -> Iterator[pa.RecordBatch]:
                for (lang, source), n in dense.items():
                    at = np.flatnonzero(n)
                    columns = [pa.array([x] * len(at), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(n[at])], ["lang", "source", "slot", "n"])
                dense.clear()

            for found in counted(batches):
                for (lang, source), own in found.items():
                    slot_of = known.setdefault(lang, {})
                    if len(slot_of) > GATHER:
                        slot_of.clear()
                    new = [t for t in own if t not in slot_of]
                    slot_of.update(zip(new, vocabulary.slots(lang, new).tolist()))
                    slots = np.fromiter(map(slot_of.__getitem__, own), np.int64, len(own))
                    n = np.fromiter(own.values(), np.int64, len(own))
                    if (lang, source) not in dense:
                        if sum(map(len, dense.values())) > SLOTS:
                            yield from passed_on()
                        dense[lang, source] = np.zeros(ends.get(lang, 0), np.int64)
                    dense[lang, source][slots[slots >= 0]] += n[slots >= 0]
            yield from passed_on()

        slots = rows.mapInArrow(run, "lang string, source string, slot bigint, n bigint")
        out = scratch.write(slots.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "counts")
        shared.destroy()
        return out

    if not groups:
        return spark.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    rows = texts.select("lang", "source", "text")
    if len(groups) == 1:
        return recount(rows, by_term, groups[0])
    # The group of a term follows from its shard; terms of languages without kept terms have none.
    numbers = spark.createDataFrame([(g, lang, shard) for g, own in groups.items() for lang, shard in own], "part int, lang string, shard bigint")
    numbers = shards.select("lang", "shard", "shards").join(numbers, ["lang", "shard"])
    of = scratch.write(numbers.groupBy("lang").agg(F.first("shards").alias("shards"), F.map_from_entries(F.collect_list(F.struct("shard", "part"))).alias("parts")), "parts")
    terms = rows.mapInArrow(written_terms, "lang string, source string, term binary, n bigint")
    terms = terms.join(of, "lang").withColumn("part", F.col("parts")[F.pmod(F.xxhash64("term"), F.col("shards"))])
    path = scratch.path("terms")
    terms.select("lang", "source", "term", "n", "part").write.partitionBy("part").parquet(path)
    terms = spark.read.schema("lang string, source string, term binary, n bigint, part int").parquet(path)
    parts = [recount(terms.where(F.col("part") == g).select("lang", "source", "term", "n"), read_terms, own) for g, own in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def _by_first(pairs: list[tuple[str, int]]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def _share(n: str, all_n: str, terms: str) -> F.Column:
    """Smoothed share in whole billionths, exact for any counts."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * ({n} + {SMOOTH}) div ({all_n} + {SMOOTH} * {terms})")


def source_distances(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``(lang, x, y, f)`` of every two sources x < y of a language: differences of shares summed over all kept terms.

    ``groups``: ``(lang, source, all_n, terms, p0)``, where ``p0`` is the share of a term
    that does not occur; ``counts``: ``(lang, source, slot, p)`` of those that do.
    """
    numbered = groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE))
    tiles = numbered.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)) - 1)
    packed = counts.withColumn("block", F.expr(f"slot div {BLOCK}"))
    packed = packed.groupBy("lang", "source", "block").agg(F.collect_list(F.struct((F.col("slot") % BLOCK).alias("at"), "p")).alias("own"))
    rows = numbered.withColumn("block", F.explode(blocks)).join(packed, ["lang", "source", "block"], "left")
    rows = rows.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    rows = rows.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    width = F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).alias("width")

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("source")
        source, tile = part.column("source").to_pylist(), part.column("tile").to_numpy()
        a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
        shares = np.repeat(part.column("p0").to_numpy()[:, None], part.column("width")[0].as_py(), axis=1)
        for i, own in enumerate(part.column("own").to_pylist()):
            for entry in own or ():
                shares[i, entry["at"]] = entry["p"]
        left, right, f = [], [], []
        for i in np.flatnonzero(tile == a).tolist():
            others = np.flatnonzero(tile == b)
            others = others[others > i] if a == b else others
            f.extend(np.abs(shares[others] - shares[i]).sum(axis=1).tolist())
            left.extend([source[i]] * len(others))
            right.extend(source[j] for j in others.tolist())
        columns = [pa.array([part.column("lang")[0].as_py()] * len(f), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string())]
        return pa.table([*columns, pa.array(f, pa.int64())], names=["lang", "x", "y", "f"])

    rows = rows.select("lang", "block", "a", "b", "source", "tile", "p0", width, "own")
    parts = rows.groupBy("lang", "block", "a", "b").applyInArrow(compare, "lang string, x string, y string, f bigint")
    return parts.groupBy("lang", "x", "y").agg(F.sum("f").alias("f"))


def divergence_report(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every other source by distance, and the terms a source favours most.

    Null texts, languages and sources are empty ones. A group without kept terms still
    stands beside the others; a language without any has distances of 0 and no terms.
    Repeated rows count each for itself. An empty table gives no rows, and other columns
    are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _named(docs, text_col, lang_col, source_col)
    kept = scratch.write(kept_terms(texts, least_docs), "kept")
    shards = perfect_hashes(kept, scratch)
    counts = scratch.write(term_counts(texts, shards, scratch), "group-counts")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    groups = texts.select("lang", "source").distinct().join(terms, "lang", "left").join(held, ["lang", "source"], "left")
    groups = groups.fillna(0, ["terms", "all_n"]).withColumn("p0", F.when(F.col("terms") > 0, _share("0L", "all_n", "terms")).otherwise(F.lit(0)))
    groups = scratch.write(groups, "groups")
    shares = scratch.write(counts.join(groups, ["lang", "source"]).select("lang", "source", "slot", _share("n", "all_n", "terms").alias("p")), "shares")

    near = source_distances(groups, shares)
    sides = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = near.select("lang", sides.alias("side"), F.col("f").alias("value")).select("lang", "side.*", F.lit("pair").alias("part"), "value")

    totals = groups.groupBy("lang").agg(F.sum("all_n").alias("all_n"), F.first("terms").alias("terms"))
    words = shards.select("lang", "base", F.posexplode("terms").alias("at", "term"))
    words = words.select("lang", (F.col("base") + F.col("at")).alias("slot"), F.col("term").cast("string").alias("item"))
    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(totals, "lang")
    whole = whole.select("lang", "slot", _share("n", "all_n", "terms").alias("q")).join(words, ["lang", "slot"])
    over = shares.join(scratch.write(whole, "whole"), ["lang", "slot"]).where("p > q")
    favoured = over.select("lang", "source", "item", F.lit("term").alias("part"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    favoured = favoured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(favoured).select("lang", "source", "part", "item", "value", "rank")
