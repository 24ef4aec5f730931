"""Quality rules: counts of words, symbols and repetition, and perplexity bands by language.

The language model is a modified Kneser-Ney model over characters. A character is one of
256 symbols: ASCII as it is, letters of other scripts by a hash that keeps the letters of
one alphabet apart, so that texts of any script have words and not just letter kinds. An
n-gram of ``ORDER`` characters packs into one integer, and a language has as many as its
texts show. Spark counts, for each n-gram, in how many different ways ``SPAN - ORDER``
further characters precede it: the continuation counts of Kneser-Ney, at full length too.
A text that is copied any number of times adds no new way, so large groups of copies
neither bend the model nor look too easy to it.

A text is never scored by a model that has counted it. Texts are dealt into ``FOLDS`` folds
by a hash of their content, so that copies share a fold, and each way remembers the folds
it was seen in. The counts without one fold become sorted arrays of n-grams with their
interpolated log-probabilities, one set for each language and fold, and the texts of that
fold are scored by lookup. Junk is then improbable however little or much of it there is.
The arrays are sorted by a hash of the n-gram, and a table of where each range of hashes
begins leads to an n-gram in a step or two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, plain_names, slices, small_batches, text_bytes, with_fields

# Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))

# The model: symbols scored together, symbols whose ways are counted, bits of a symbol.
ORDER, SPAN, BITS = 5, 7, 8
# Folds of texts; those of one are scored by what the others hold.
FOLDS = 4
# N-grams of all models that tasks hold at a time; beyond it, texts are scored in several passes.
MAX_ENTRIES = 1 << 23
# Symbols looked at together, and n-grams that a task gathers before it merges them.
BLOCK = 1 << 20
GATHER = 1 << 21
# Buckets of a language that n-grams are dealt into, as a power of two.
BUCKET_BITS = 9

# Bands in median absolute deviations of log-perplexity below and above a language's median.
LOWER, UPPER = 12.0, 25.0
# A text of so many bytes has twice the variance of a very long one.
NOISE_BYTES = 1000
LEAST_DEVIATION = 0.005
# Medians are exact over rounded values, of which a language has some ten thousand at most.
DECIMALS = 4
# Times that bands are found at most.
REFITS = 10
# Languages with fewer texts share a band, named by what no language is called.
LEAST_TEXTS = 30
SMALL = "\0small"


def symbols_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the characters of UTF-8 bytes, and which bytes begin one; texts begin at ``starts``.

    Letters of two bytes keep seven bits, which tells those of one alphabet apart; longer
    ones are hashed to seven bits.
    """
    first = (raw & 0xC0) != 0x80
    first[starts] = True
    at = np.flatnonzero(first)
    lead = raw[at]
    follow = [raw[np.minimum(at + k, len(raw) - 1)] & 63 for k in (1, 2, 3)] if len(at) else [lead] * 3
    two = (lead & 1) << 6 | follow[0]
    more = follow[0] * 45 + follow[1] * (1 + 2 * (lead >= 0xF0)) + (lead >= 0xF0) * follow[2]
    return np.where(lead < 0x80, lead, 0x80 | np.where(lead < 0xE0, two, more & 0x7F)).astype(np.uint8), first


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows of three."""
    words = text.split()
    chars = len(text.translate(None, WHITE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated_lines = len(lines) - len(set(lines))
    n = len(words)
    if n < 4:
        return n, chars, symbols, repeated_lines, 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    if len(index) < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # number the pairs first, so that a key fits
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] << 32 | ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return n, chars, symbols, repeated_lines, 0
    at = np.flatnonzero(np.isin(keys, twice))
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[at + k] = True
    return n, chars, symbols, repeated_lines, int(inside.sum())


def _blocks(texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, packed n-gram) of every character of the texts, block by block; starts of texts are padded."""
    held = [i for i, t in enumerate(texts) if t]
    if not held:
        return
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])[:-1]]).astype(np.int64)
    found, first = symbols_of(raw, starts)
    size = np.add.reduceat(first.astype(np.int64), starts)
    pad = span - 1
    ends = np.cumsum(size + pad)
    owners = np.repeat(np.array(held, np.int32), size + pad)
    symbols = np.zeros(int(ends[-1]), np.uint8)
    real = np.ones(len(symbols), bool)
    for k in range(1, pad + 1):
        real[ends - size - k] = False
    symbols[real] = found
    for at in range(0, len(symbols), BLOCK):
        low = max(at - pad, 0)
        part = symbols[low : at + BLOCK].astype(np.uint64)
        grams = part.copy()
        for k in range(1, span):
            grams[k:] |= part[:-k] << np.uint64(BITS * k)
        here = slice(at, at + BLOCK)
        keep = real[here]
        mask = np.uint64((1 << BITS * span) - 1)
        yield owners[here][keep], (grams[at - low :] & mask)[keep]


def _by_language(langs: list) -> Iterator[tuple[str, list[int]]]:
    """Rows of each language; null counts as a language without a name."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang or "", []).append(i)
    yield from rows.items()


def _fold(text: Column) -> Column:
    """Fold of a text, by a hash of its content."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _merged(seen: list[np.ndarray]) -> np.ndarray:
    """Different ways in order, each with a bit for every fold it was seen in as its lowest bits."""
    ordered = np.sort(np.concatenate([np.zeros(0, np.uint64), *seen]))
    if not len(ordered):
        return ordered
    ways = ordered >> np.uint64(FOLDS)
    first = np.flatnonzero(np.concatenate([[True], ways[1:] != ways[:-1]]))
    return ways[first] << np.uint64(FOLDS) | np.bitwise_or.reduceat(ordered & np.uint64((1 << FOLDS) - 1), first)


def _squeezed(ways: np.ndarray) -> bytes:
    """Sorted numbers as differences, bytes of one place side by side, compressed a fifth better than a shuffle does."""
    return zstandard.compress(np.diff(ways, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _bucket(ways: np.ndarray) -> np.ndarray:
    """Bucket of each way by a hash of the n-gram it ends in, so that all ways of an n-gram meet."""
    grams = ways & np.uint64((1 << BITS * ORDER) - 1)
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def continuation_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, gram, n, alone0, ...)``: in how many ways the n-grams of ``ORDER`` symbols are preceded, over all texts.

    ``alone`` counts the ways that only texts of one fold show; ``n`` less that is the count
    without the fold. Each task drops what it has seen before and deals the rest out by n-gram, packed by
    language and bucket; Spark brings the parts of a bucket together, and a task merges
    them one by one, holding the different ways of one bucket of one language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("fold", _fold(F.col("text")))
    alone = [f"alone{f}" for f in range(FOLDS)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                texts = text_bytes(part.column(1))
                bits = np.uint64(1) << part.column(2).to_numpy().astype(np.uint64)
                for lang, at in _by_language(part.column(0).to_pylist()):
                    own = held.setdefault(lang, [])
                    for owner, grams in _blocks([texts[i] for i in at], SPAN):
                        own.append(_merged([grams << np.uint64(FOLDS) | bits[at][owner]]))
                    if sum(map(len, own[1:])) > max(GATHER, len(own[0]) if own else 0):
                        held[lang] = [_merged(own)]
        for lang, own in held.items():
            ways = _merged(own)
            if not len(ways):
                continue  # empty texts only
            bucket = _bucket(ways >> np.uint64(FOLDS))
            ways = ways[np.argsort(bucket, kind="stable")]
            size = np.bincount(bucket, minlength=1 << BUCKET_BITS)
            used = np.flatnonzero(size)
            parts = [_squeezed(w) for w in np.split(ways, np.cumsum(size[used])[:-1])]
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "ways"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def counted() -> pa.RecordBatch:
            ways = _merged(own)
            folds = ways & np.uint64((1 << FOLDS) - 1)
            grams, at, n = np.unique(ways >> np.uint64(FOLDS) & np.uint64((1 << BITS * ORDER) - 1), return_inverse=True, return_counts=True)
            only = [np.bincount(at[folds == np.uint64(1 << f)], minlength=len(n)).astype(np.int32) for f in range(FOLDS)]
            columns = [pa.array([key[0]] * len(n), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, only)], ["lang", "gram", "n", *alone])

        for batch in batches:
            for lang, bucket, ways in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (lang, bucket):
                    if own:
                        yield counted()
                    key, own = (lang, bucket), []
                own.append(_spread(ways))
                if sum(map(len, own[1:])) > max(GATHER, len(own[0])):
                    own = [_merged(own)]
        if own:
            yield counted()

    dealt = rows.mapInArrow(gather, "lang string, bucket int, ways binary").repartition("lang", "bucket")
    return dealt.sortWithinPartitions("lang", "bucket").mapInArrow(count, ", ".join(["lang string, gram bigint, n bigint", *[f"{c} int" for c in alone]]))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of modified Kneser-Ney for counts 0, 1, 2 and more, from the counts of counts."""
    of = [int((n == i).sum()) for i in range(1, 5)]
    y = of[0] / max(of[0] + 2 * of[1], 1)
    out = [0.0]
    for i in (1, 2, 3):
        d = i - (i + 1) * y * of[i] / of[i - 1] if of[i - 1] else 0.5 * i
        out.append(min(max(d, 0.05), i - 0.05))
    return np.array(out)


class HashArray:
    """Different keys sorted by a hash, found by where their range of hashes begins."""

    def __init__(self, keys: np.ndarray):
        hashes = self._hash(keys.astype(np.uint64))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.shift = 64 - max(int(len(keys)).bit_length(), 1)
        starts = np.arange(1 << 64 - self.shift, dtype=np.uint64) << np.uint64(self.shift)
        self.starts = np.append(np.searchsorted(self.hashes, starts), len(keys)).astype(np.int32)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        """A permutation of 64-bit numbers, so that different keys never meet."""
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not held."""
        h = self._hash(keys)
        at = (h >> np.uint64(self.shift)).astype(np.int64)
        place, end = self.starts[at], self.starts[at + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(place < end)
        place, end, h = place[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashes[place] == h
            out[todo[hit]] = place[hit]
            place = place + 1
            more = ~hit & (place < end)
            todo, place, end, h = todo[more], place[more], end[more], h[more]
        return out


class LanguageModel:
    """Sorted hash arrays of n-grams of every order, with log-probabilities and back-off weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        levels = [(grams[order].astype(np.int64), counts[order].astype(np.int64))]
        for k in range(ORDER - 1, 0, -1):
            levels.insert(0, np.unique(levels[0][0] & ((1 << BITS * k) - 1), return_counts=True))
        self.keys, self.logs, self.contexts, self.backs = [], [], [], []
        prob = np.zeros(0)
        for k, (keys, n) in enumerate(levels):
            d = _discounts(n)[np.minimum(n, 3)]
            context = keys >> BITS
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(n, first)
            back = np.add.reduceat(d, first) / total
            lower = 1 / (1 << BITS) if k == 0 else prob[np.searchsorted(levels[k - 1][0], keys & ((1 << BITS * k) - 1))]
            prob = (n - d) / np.repeat(total, size) + np.repeat(back, size) * lower
            held, before = HashArray(keys), HashArray(context[first])
            self.keys.append(held)
            self.logs.append(np.log(prob[held.order]).astype(np.float32))
            self.contexts.append(before)
            self.backs.append(np.log(back[before.order]).astype(np.float32))
        for held in (*self.keys, *self.contexts):
            del held.order

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last character of each n-gram given the others."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER - 1, -1, -1):
            part = grams[todo] & np.uint64((1 << BITS * (k + 1)) - 1)
            at = self.keys[k].find(part)
            hit = at >= 0
            out[todo[hit]] += self.logs[k][at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            # A context that was never seen has no weight; a seen one passes its share on.
            at = self.contexts[k].find(part >> np.uint64(BITS))
            known = at >= 0
            out[todo[known]] += self.backs[k][at[known]]
        out[todo] -= BITS * np.log(2)
        return out


def model_passes(counts: DataFrame) -> list[dict[str, list[int]]]:
    """Languages and folds to score together: their models hold ``MAX_ENTRIES`` n-grams, or there is one model only."""
    held = [F.count_if(F.col("n") > F.col(f"alone{f}")).alias(f"rows{f}") for f in range(FOLDS)]
    passes, room = [{}], MAX_ENTRIES
    for r in sorted(counts.groupBy("lang").agg(*held).collect(), key=lambda r: r["lang"]):
        for fold in range(FOLDS):
            rows = r[f"rows{fold}"]
            if rows > room and passes[-1]:
                passes.append({})
                room = MAX_ENTRIES
            if rows:
                passes[-1].setdefault(r["lang"], []).append(fold)
                room -= rows
    return passes


def language_models(counts: DataFrame, lang: str, folds: list[int]) -> dict[int, LanguageModel]:
    """Models of a language for some folds, each from all counts of the other folds."""
    others = [(F.col("n") - F.col(f"alone{f}")).cast("int").alias(f"n{f}") for f in folds]
    held = counts.where(F.col("lang") == lang).select("gram", *others).toArrow()
    grams, out = held.column("gram").to_numpy(), {}
    for fold in folds:
        n = held.column(f"n{fold}").to_numpy()
        out[fold] = LanguageModel(grams[n > 0], n[n > 0])
    return out


def scored(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the base counts and ``_log_perplexity`` per character.

    It is null for empty texts, and where no text of the language lies in another fold.
    Every n-gram counts: if the models are more than tasks should hold at a time, the texts
    are read again for each further group of models.
    """
    spark = docs.sparkSession
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        text.alias("_text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("_lang"),
        _fold(text).alias("_fold"),
        *[F.col(f"`{c}`") for c in keep],
    )
    # The text itself leaves the task only if it is among the kept columns.
    more = ["_lang string", "_bytes bigint", *[f"_{c} bigint" for c in names], "_log_perplexity double"]
    schema = with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, ", ".join(more))

    def run(batches: Iterator[pa.RecordBatch], models: dict[str, Broadcast]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 0):
                part = batch.slice(start, end - start)
                texts = text_bytes(part.column(0))
                counts = list(zip(*[base_counts(t) for t in texts]))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                total = np.zeros(len(texts))
                folds = part.column(2).to_numpy()
                for lang, rows_of in _by_language(part.column(1).to_pylist()):
                    rows_of = np.array(rows_of)
                    of = models[lang].value if lang in models else {}
                    for fold in np.unique(folds[rows_of]).tolist():
                        at = rows_of[folds[rows_of] == fold]
                        model = of.get(fold)
                        for owner, grams in _blocks([texts[i] for i in at], ORDER) if model else ():
                            total[at] -= np.bincount(owner, model.score(grams), len(at))
                        if not model:
                            total[at] = np.nan
                # Characters are what is left of a text without the further bytes of each.
                letters = np.fromiter((len(t.translate(None, _CONTINUATION)) for t in texts), np.int64, len(texts))
                mean = pa.array(total / np.maximum(letters, 1), mask=(size == 0) | np.isnan(total))
                columns = [*part.columns[3:], part.column(1), pa.array(size), *[pa.array(c, pa.int64()) for c in counts], mean]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "_lang", "_bytes", *[f"_{c}" for c in names], "_log_perplexity"])

    with Scratch(spark) as scratch:
        counts = scratch.write(continuation_counts(docs, text_col, lang_col), "ways")
        passes = model_passes(counts)
        # The driver holds one language at a time, and a task fetches the languages that it meets.
        models = [{lang: spark.sparkContext.broadcast(language_models(counts, lang, own)) for lang, own in which.items()} for which in passes]
    # Texts without a model go with the first pass.
    later: dict[str, list[int]] = {}
    for i, which in enumerate(passes[1:], start=1):
        for lang, folds in which.items():
            for fold in folds:
                later.setdefault(lang, [0] * FOLDS)[fold] = i
    if later:
        pairs = [x for lang, own in sorted(later.items()) for x in (F.lit(lang), F.array(*map(F.lit, own)))]
        turn = F.coalesce(F.get(F.try_element_at(F.create_map(*pairs), F.col("_lang")), F.col("_fold")), F.lit(0))
        parts = [rows.where(turn == i).mapInArrow(partial(run, models=m), schema) for i, m in enumerate(models)]
        return reduce(DataFrame.unionAll, parts)
    return rows.mapInArrow(partial(run, models=models[0]), schema)


def judged(scores: DataFrame) -> DataFrame:
    """``scores``, a written table, with ``_base_failed`` and ``_kept``.

    Bands come from the texts of a language that pass the base rules: their median
    log-perplexity, and so many median absolute deviations to either side. Texts outside are
    left out and the band is found again until it stays, so that what a junk source adds to
    the median and the deviations does not widen it. Deviations of short texts, which
    scatter more, count less. Languages of fewer than ``LEAST_TEXTS`` such texts share the
    band of all of them, if they have as many together.
    """
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    rows = scores.withColumn("_base_failed", failed)
    passed = ~failed & F.col("_log_perplexity").isNotNull()
    texts = {r["_lang"]: r["count"] for r in rows.where(passed).groupBy("_lang").count().collect()}
    large = sorted(lang for lang, n in texts.items() if n >= LEAST_TEXTS)
    rows = rows.withColumn("_band", F.when(F.col("_lang").isin(*large), F.col("_lang")).otherwise(SMALL))
    banded = {*large, *([SMALL] if sum(texts.values()) - sum(map(texts.get, large)) >= LEAST_TEXTS else [])}
    passed = rows.where(passed & F.col("_band").isin(*banded))
    away = (F.col("_log_perplexity") - F.col("_median")) / F.sqrt(1 + F.lit(NOISE_BYTES) / F.greatest("_bytes", F.lit(1)))
    within, last = passed, ({}, {})
    for _ in range(REFITS if banded else 0):
        middle = within.groupBy("_band").agg(F.median(F.round("_log_perplexity", DECIMALS)).alias("_median"))
        medians = {r["_band"]: r["_median"] for r in middle.collect()}
        spread = _constants(within, "_median", medians)
        spread = spread.groupBy("_band").agg(F.median(F.round(F.abs(away), DECIMALS)).alias("_spread")).collect()
        spreads = {r["_band"]: max(r["_spread"], LEAST_DEVIATION) for r in spread}
        if (medians, spreads) == last:
            break
        last = medians, spreads
        within = _constants(_constants(passed, "_median", medians), "_spread", spreads)
        within = within.where(away.between(-LOWER * F.col("_spread"), UPPER * F.col("_spread"))).drop("_median", "_spread")
    bands = _constants(_constants(rows, "_median", last[0]), "_spread", last[1])
    away = away / F.col("_spread")
    inside = F.coalesce((away >= -LOWER) & (away <= UPPER), F.lit(True))
    return bands.withColumn("_deviations", away).withColumn("_kept", ~F.col("_base_failed") & inside)


def _constants(rows: DataFrame, name: str, by_band: dict[str, float]) -> DataFrame:
    """A column with a value for each band; null for bands without one."""
    if not by_band:
        return rows.withColumn(name, F.lit(None).cast("double"))
    pairs = [x for band, value in sorted(by_band.items()) for x in (F.lit(band), F.lit(float(value)))]
    return rows.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col("_band")))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, deviations, kept)``.

    Null and empty texts have no words and fail the base rules; a null language is a
    language of its own; languages of fewer than ``LEAST_TEXTS`` texts that pass the base
    rules share a band. Repeated rows stay, an empty table gives no rows, and columns
    beside id, text and language are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    done = judged(scratch.write(scored(rows, ["doc_id"]), "scores"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "deviations", "kept"]
    return done.select("doc_id", *[F.col(f"_{c}").alias(c) for c in names])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``, whatever they are called."""
    scratch = Scratch(docs.sparkSession)
    rows, named = plain_names(docs)
    done = judged(scratch.write(scored(rows, rows.columns, named[text_col], named[lang_col]), "scores"))
    return done.where("_kept").select(*rows.columns).toDF(*docs.columns)
