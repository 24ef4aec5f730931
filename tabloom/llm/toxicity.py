"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel compares two words by the subsequences of three symbols that they share. A
subsequence may skip symbols, at most two in all, and each skipped one costs a factor
``DECAY``, so an insult with inserted or spaced characters still meets its plain form.
Since the gaps are bounded, the kernel is a product of explicit, sparse vectors, and the
machine's decision, a weighted sum of kernels with landmark words, folds into one weight
per subsequence. Whole texts are scored by looking these weights up, position by position.

Training takes a bounded sample of labelled documents and treats their words, the units of
their sentences, as instances: every word of a harmless document is harmless, and of a
toxic document at least the worst words are toxic. Which those are is settled in rounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import plain_names, slices, small_batches, text_list, with_fields

# Labelled documents of each class that are learnt from, and bytes of text of all of them.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 16 << 20
LANDMARKS, COMMON_LANDMARKS = 160, 96
ROUNDS, TOP_WORDS = 4, 3
# Different words that the machine is trained on.
HARMLESS_WORDS, TOXIC_WORDS = 12000, 6000
DECAY = 0.6
# Offsets of the second and third symbol of a subsequence.
PATTERNS = tuple((a, b) for b in range(2, 5) for a in range(1, b))
BITS, BOUNDARY, TABLE = 6, 27, 1 << 18
BLOCK = 1 << 19
REGULAR = 1e-2
# Neighbouring words whose values are summed; documents that are joined to longer ones for the curve.
WINDOW, CLEAR, MOST = 400, 0.4, 1.8
LENGTHS, JOINED_WEIGHT = (8, 64, 512), 0.05
# Forms with one character put in that the machine is shown of a toxic word, and their share of its weight.
FORMS, FORM_WEIGHT = 4, 0.5


def _classes() -> np.ndarray:
    """Symbol of each byte of a lower-case text: letters, digits, marks, and bytes of other letters."""
    of = np.full(256, BOUNDARY, np.uint8)
    of[ord("a") : ord("z") + 1] = np.arange(1, 27)
    of[ord("0") : ord("9") + 1] = 28
    of[0x80:0xC0] = 32 + np.arange(0x80, 0xC0) % 32
    of[0xC0:] = 29
    return of


CLASSES = _classes()
# Bytes that are no part of words: all below 0x80 but letters, digits and white space.
MARKS = bytes(b for b in range(0x80) if not chr(b).isalnum() and b not in b"\x20\x09\x0a\x0b\x0c\x0d")
_WHITE = np.zeros(256, bool)
_WHITE[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True


@dataclass
class Units:
    """Words of a block of text: symbols with a mark before, between and after them, and where they start."""

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def units(text: bytes) -> Units:
    """The words of a text; neighbouring words of one symbol are one unit, so spelt-out words stay together."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    white = _WHITE[raw]
    first = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    last = np.flatnonzero(~white[:-1] & white[1:])
    single = last == first
    joined = np.zeros(len(first), bool)
    joined[1:] = single[1:] & single[:-1]
    starts = first[~joined]
    ends = last[np.append(np.flatnonzero(~joined)[1:], len(first)) - 1] if len(first) else last
    return Units(CLASSES[raw], starts, ends)


def subsequences(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(start, packed subsequence, weight) for every pattern of gaps that stays within a unit and its two marks."""
    n = len(u.symbols)
    if not len(u.starts):
        return
    # The last place that a subsequence starting at a place may reach: the mark after its unit.
    size = u.ends - u.starts + 2
    begin = np.repeat(u.starts - 1, size)
    place = begin + np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size)
    reach = np.repeat(u.ends + 1, size)
    symbols = u.symbols.astype(np.int32)
    head = symbols[place] << 2 * BITS
    for a, b in PATTERNS:
        ok = place + b <= reach
        at = place[ok]
        yield at, head[ok] | symbols[at + a] << BITS | symbols[np.minimum(at + b, n - 1)], DECAY ** (b - 2)


def unit_scores(u: Units, weights: np.ndarray) -> np.ndarray:
    """The sum of weights of each unit's subsequences."""
    total = np.zeros(len(u.symbols) + 1)
    for at, grams, weight in subsequences(u):
        total[:-1] += np.bincount(at, weights[grams], len(u.symbols)) * weight
    upto = np.concatenate([[0.0], np.cumsum(total)])
    # A place between two units may serve both, as the end of one and the start of the next; only starts count.
    return upto[u.ends + 1] - upto[u.starts - 1]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of words: (word number, subsequence, value), sorted and summed."""
    u = units(b" zz ".join(words))  # the word between keeps neighbours of one symbol apart
    owner = np.zeros(len(u.symbols), np.int64)
    owner[u.starts - 1] = 1
    owner = np.cumsum(owner) - 1
    keys, values = [], []
    for at, grams, weight in subsequences(u):
        own = owner[at] % 2 == 0
        keys.append(owner[at[own]] // 2 * TABLE + grams[own])
        values.append(np.full(int(own.sum()), weight))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, values = np.concatenate(keys), np.concatenate(values)
    unique, where = np.unique(keys, return_inverse=True)
    return unique // TABLE, unique % TABLE, np.bincount(where, values)


class Landmarks:
    """Kernel values against landmark words, and their Nyström map."""

    def __init__(self, words: list[bytes]):
        word, gram, value = features(words)
        self.size = len(words)
        self.column = np.full(TABLE, -1, np.int64)
        used = np.unique(gram)
        self.column[used] = np.arange(len(used))
        self.used = used
        self.vectors = np.zeros((len(used), self.size), np.float32)
        self.vectors[self.column[gram], word] = value
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=0), 1e-9)
        values, basis = np.linalg.eigh((self.vectors.T @ self.vectors).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        self.root = (basis[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def map(self, words: list[bytes], chunk: int = 250) -> np.ndarray:
        """Nyström features of words."""
        out = np.zeros((len(words), self.root.shape[1]), np.float32)
        for at in range(0, len(words), chunk):
            word, gram, value = features(words[at : at + chunk])
            column = self.column[gram]
            hit = column >= 0
            kernel = np.zeros((len(words[at : at + chunk]), self.size), np.float32)
            rows = word[hit]
            if len(rows):
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                sums = np.add.reduceat(self.vectors[column[hit]] * value[hit, None].astype(np.float32), first)
                kernel[rows[first]] = sums
            out[at : at + chunk] = kernel @ self.root
        return out

    def fold(self, w: np.ndarray) -> np.ndarray:
        """One weight per subsequence, such that a word's sum of weights is ``w`` times its features."""
        table = np.zeros(TABLE)
        table[self.used] = self.vectors @ (self.root @ w)
        return table


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    scale = weight / weight.sum()
    active = np.ones(n, bool)
    for _ in range(rounds):
        a, rhs = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
        rows = np.flatnonzero(active)
        for at in range(0, len(rows), 1000):  # in parts, so that only the small system is held
            part = rows[at : at + 1000]
            xa, s = np.hstack([x[part], np.ones((len(part), 1), np.float32)]).astype(np.float64), scale[part]
            a += (xa * s[:, None]).T @ xa
            rhs += xa.T @ (s * y[part])
        a[np.arange(d), np.arange(d)] += REGULAR * 1e-2
        a[d, d] += 1e-9
        sol = np.linalg.solve(a, rhs)
        w, b = sol[:d], float(sol[d])
        now = y * (x @ w + b) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return w, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve, the last one constant, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (weight * (p - y)) + 1e-2 * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return beta


# Three or more words of one character each, one after the other.
_SPELT = re.compile(rb"(?<![^\s])(?:(?:[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]+)[ \t]){2,}(?:[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]+)(?!\S)")


def normal(text: str) -> bytes:
    """Lower case in UTF-8 without marks, so that a word with marks in it is the word, as is one spelt with spaces."""
    plain = text.lower().encode().translate(None, MARKS)
    return _SPELT.sub(lambda m: m[0].replace(b" ", b"").replace(b"\t", b""), plain)


@dataclass
class ToxicityModel:
    """Weights of subsequences, the bias of a word, and the curve from a document's words to its score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(TABLE))
    bias: float = -1.0
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -5.0]))

    def word_scores(self, text: bytes) -> np.ndarray:
        """Decision values of all units of a text, block by block.

        Blocks end at white space; only a unit longer than a block, which is no word of any
        language, is cut.
        """
        parts, at = [], 0
        while at < len(text):
            end = min(at + BLOCK, len(text))
            if end < len(text):
                cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t"))
                end = cut + 1 if cut > at else end
            parts.append(unit_scores(units(text[at:end]), self.weights) + self.bias)
            at = end
        return np.concatenate(parts) if parts else np.zeros(0)

    def summary(self, values: np.ndarray) -> np.ndarray:
        return summarize([values])[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """A score from 0 to 1 for each text."""
        rows = summarize([self.word_scores(normal(t)) for t in texts])
        return _sigmoid(np.hstack([rows, np.ones((len(rows), 1))]) @ self.curve)


def summarize(values: list[np.ndarray]) -> np.ndarray:
    """Per document: what looks toxic in the worst window, that per word of it, and the length.

    Values count from ``CLEAR`` up, ``MOST`` at most, so a harmless word adds nothing, and
    only those of the ``WINDOW`` neighbouring words that hold most; length alone adds nothing.
    """
    out = np.zeros((len(values), 3))
    for i, v in enumerate(values):
        if not len(v):
            continue
        upto = np.concatenate([[0.0], np.cumsum(np.clip(v - CLEAR, 0.0, MOST))])
        size = min(len(v), WINDOW)
        worst = float((upto[size:] - upto[:-size]).max())
        out[i] = np.log1p(4 * worst), np.log1p(WINDOW * worst / size), np.log1p(len(v) / WINDOW)
    return out


def joined_examples(values: list[np.ndarray], y: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Longer documents made of the sample's, one by one, with their labels.

    Harmless documents one after the other are harmless, and a toxic one among harmless ones
    is toxic; the curve learns from both what length does to a summary.
    """
    clean = [v for v, t in zip(values, y) if not t]
    bad = [v for v, t in zip(values, y) if t]
    for times in LENGTHS:
        for at in range(0, len(clean) - times + 1, times):
            yield np.concatenate(clean[at : at + times]), 0
        for i, v in enumerate(bad[:: max(times // 4, 1)]):
            around = [clean[(i * times + k) % len(clean)] for k in range(min(times, len(clean)))]
            yield np.concatenate([*around[: times // 2], v, *around[times // 2 :]]), 1


def hash_of(word: bytes) -> int:
    return zlib.crc32(word)


def gapped_forms(word: bytes) -> list[bytes]:
    """The word with one letter or digit put in, at places and with characters that its hash names."""
    h, out = hash_of(word), []
    for k in range(FORMS if len(word) > 3 else 0):
        at = 1 + (h >> 4 * k) % (len(word) - 1)
        if word[at] & 0xC0 != 0x80:  # not within a letter of several bytes
            out.append(word[:at] + b"abcdefghijklmnopqrstuvwxyz0123456789"[(h >> 5 * k) % 36 :][:1] + word[at:])
    return out


def fit(texts: list[str], toxic: list[int], total: tuple[int, int] | None = None) -> ToxicityModel:
    """A model from labelled texts. Without texts of both kinds every text scores near zero.

    ``total`` gives the numbers of all harmless and toxic labels, if the texts are a
    sample of unequal shares.
    """
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    index: dict[bytes, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in dict.fromkeys(normal(t).split())], np.int64) for t in texts]
    names = list(index)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    in1 = np.bincount(np.concatenate([d for d, t in zip(docs, y) if t]), minlength=len(names)).astype(float)
    in0 = np.bincount(np.concatenate([d for d, t in zip(docs, y) if not t]), minlength=len(names)).astype(float)
    share = (in1 + in0) / (n1 + n0)
    first = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    by_first, by_common = np.argsort(-first, kind="stable"), np.argsort(-in0, kind="stable")
    chosen = list(dict.fromkeys([*by_first[:LANDMARKS].tolist(), *by_common[:COMMON_LANDMARKS].tolist()]))
    marks = Landmarks([names[i] for i in chosen])
    # Instances: all words that some harmless document holds, thinned to a share, and the likely words of toxic ones.
    spread = np.array([hash_of(w) for w in names])
    harmless = np.flatnonzero((in0 > 0) & ((in0 > 1) | (spread % 4 == 0) | (first > 0)))
    harmless = harmless[np.argsort(spread[harmless], kind="stable")[:HARMLESS_WORDS]]
    of_toxic = np.flatnonzero((in1 > 0) & (in0 <= 0.2 * in1 * n0 / n1))
    of_toxic = of_toxic[np.argsort(-first[of_toxic], kind="stable")[:TOXIC_WORDS]]
    used = np.union1d(harmless, of_toxic)
    x = marks.map([names[i] for i in used])
    slot = np.full(len(names), -1, np.int64)
    slot[used] = np.arange(len(used))
    allowed = np.zeros(len(names), bool)
    allowed[of_toxic] = True
    value = first.copy()
    forms = [(i, f) for i in of_toxic if in1[i] > 1 for f in gapped_forms(names[i]) if f not in index]
    shaped = np.array([i for i, _ in forms], np.int64)
    x_forms = marks.map([f for _, f in forms])
    w, b = np.zeros(x.shape[1]), -1.0
    for _ in range(ROUNDS):
        picked = np.zeros(len(names))
        for d, t in zip(docs, y):
            if t:
                own = d[allowed[d]]
                top = own[np.argsort(-value[own], kind="stable")[:TOP_WORDS]]
                # A word that no other toxic document holds is weak evidence.
                picked[top] += np.where(in1[top] > 1, 1.0, 0.1)
        positive = np.flatnonzero(picked)
        if not len(positive):
            return ToxicityModel()
        negative = harmless[picked[harmless] == 0]
        rows = slot[np.concatenate([positive, negative])]
        often = np.log1p(in0[negative])
        label = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([picked[positive] / picked.sum(), 2 * often / max(often.sum(), 1e-9)])
        some = np.flatnonzero(picked[shaped] >= 1)
        label = np.concatenate([label, np.ones(len(some))])
        weight = np.concatenate([weight, FORM_WEIGHT / FORMS * picked[shaped[some]] / picked.sum()])
        w, b = train_svm(np.concatenate([x[rows], x_forms[some]]), label, weight)
        value = np.full(len(names), -np.inf)
        value[used] = x @ w + b
    model = ToxicityModel(marks.fold(w), b)
    values = [model.word_scores(normal(t)) for t in texts]
    joined = [(summarize([v])[0], t) for v, t in joined_examples(values, y)]
    rows = np.vstack([summarize(values), *[r for r, _ in joined]])
    all0, all1 = total or (n0, n1)
    label = np.concatenate([y, np.array([t for _, t in joined], np.int64)])
    weight = np.where(label == 1, all1 / n1, all0 / n0) * np.concatenate([np.ones(len(y)), np.full(len(joined), JOINED_WEIGHT)])
    model.curve = train_logistic(rows, label, weight * len(y) / weight.sum())
    return model


def learn(docs: DataFrame, labels: DataFrame, fold: int | None = 0, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model from at most ``sample`` labelled documents of each kind, ``SAMPLE_BYTES`` of text in all.

    Rows whose crc32 of the id leaves ``fold`` modulo 5 are not learnt from (all are for
    ``None``). The sample is that of the lowest hashes of the id, whatever the size of the
    tables. Of a long harmless document a part of some 17,000 characters teaches, a toxic one
    of over 67 kB does not. Labels other than 0 and 1, labels without a
    document and repeated rows of an id count once or not at all.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if fold is not None:
        marked = marked.where(crc % 5 != fold)
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [marked.where(F.col("toxic") == t).orderBy(*order).limit(sample) for t in (0, 1)]
    few = F.broadcast(parts[0].unionByName(parts[1]))  # at most twice `sample` short rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id")
    # Long texts teach by a bounded part, taken at a place that the id's hash names; this bounds what comes to the driver.
    most = 4 * SAMPLE_BYTES // (2 * sample)
    text = F.col("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - most, F.lit(0)) + 1).cast("int") + 1
    rows = found.where(text.isNotNull()).select("doc_id", "toxic", F.when(F.col("toxic") == 1, text).otherwise(F.substring(text, start, F.lit(most))).alias("text"))
    # A toxic label says nothing of single parts: such a text is taken whole, or passed over if a few like it would fill the sample.
    rows = rows.where(F.octet_length("text") <= 4 * most)
    # Of rows that share an id, the least text counts.
    one = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    held, texts, toxic = {0: 0, 1: 0}, [], []
    for r in sorted(one.collect(), key=lambda r: (hash_of(str(r["doc_id"]).encode()), r["doc_id"])):
        if held[r["toxic"]] + len(r["text"]) <= SAMPLE_BYTES // 2:
            held[r["toxic"]] += len(r["text"])
            texts.append(r["text"])
            toxic.append(r["toxic"])
    return fit(texts, toxic, (total.get(0, 0), total.get(1, 0)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "_toxic_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row. Null and empty texts have no words and score as such."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("*", F.col(f"`{text_col}`").cast("string").alias("_scored_text"))
    at, names = len(docs.columns), [*docs.columns, out_col]
    schema = with_fields(docs.schema, f"`{out_col}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, end in slices(batch, at):
                part = batch.slice(start, end - start)
                values = pa.array(m.scores(text_list(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], values], names)

    return rows.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``, learnt from rows that are not held out.

    Rows with a null id are not learnt from and not held out. Repeated rows stay, an empty
    table gives no rows, columns beside id and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(rows, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = score(rows, model).drop("text")
    return out.select("doc_id", held.alias("held_out"), F.col("_toxic_score").alias("score"), (F.col("_toxic_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with the columns of ``docs``."""
    model = learn(docs.select("doc_id", "text"), labels)
    rows, named = plain_names(docs)
    return score(rows, model, named["text"]).where(F.col("_toxic_score") < limit).select(*rows.columns).toDF(*docs.columns)
