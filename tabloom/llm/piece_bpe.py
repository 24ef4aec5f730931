"""SentencePiece encoding in vectorised merge rounds, and decoding.

The symbols of many words lie in one flat array. A round finds the rank of every pair of
neighbours, the lowest rank of each word, and merges the leftmost pair of that rank in
every word at once; where a merged symbol can form no better pair with any neighbour, all
non-overlapping occurrences of the pair merge together, since the order of the library's
queue would reach them next anyway. Finished words leave the array, until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, small_batches, text_list

SPACE = "▁"
# A word is a run of spaces and what follows up to the next one; no piece reaches across its start.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Words remembered by a task, and characters of a word up to which rounds are used.
REMEMBERED = 400_000
LONG_WORD = 4096
NONE = np.iinfo(np.int64).max


class PieceModel:
    """Merge tables of a SentencePiece BPE model with byte fallback, no normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {pieces[i]: i for i in plain}
        crossing = [p for p in self.id_of if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces that reach across words are not supported: {crossing[:3]}")
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        # Characters without a piece get numbers from `size` on, so that every symbol is an integer.
        self.size = size
        # A rank orders pieces by falling score; equal scores share a rank and fall to the leftmost pair.
        scores = np.array([sp.get_score(i) for i in range(size)])
        order = np.unique(-scores[plain])
        self.rank = np.full(size, NONE, np.int64)
        self.rank[plain] = np.searchsorted(order, -scores[plain])
        keys, merged = [], []
        for i in plain:
            text = pieces[i]
            for cut in range(1, len(text)):
                a, b = self.id_of.get(text[:cut]), self.id_of.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # A symbol is safe if none of its own pairs ranks as well as the pair that made it.
        best = np.full(size, NONE, np.int64)
        for side in (self.pair_keys // size, self.pair_keys % size):
            np.minimum.at(best, side, self.rank[self.pair_ids])
        self.safe = best > self.rank
        self.pair_of = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist()))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or -1."""
        key = left * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge until no pair is left; yields (word, symbol) of words as they finish."""
        pair = np.full(len(symbols), -1, np.int64)
        stale = np.arange(len(symbols))
        while len(symbols):
            # Only pairs beside a merge of the round before have to be looked up again.
            stale = stale[stale + 1 < len(symbols)]
            inside = word[stale] == word[stale + 1]
            at = stale[inside]
            pair[stale[~inside]] = -1
            pair[at] = self._pairs(symbols[at], symbols[at + 1])
            pair[-1] = -1
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(starts, len(word)))
            low = np.minimum.reduceat(rank, starts)
            done = np.repeat(low == NONE, size)
            if done.any():
                yield word[done], symbols[done]
            at = np.flatnonzero((rank == np.repeat(low, size)) & ~done)
            if not len(at):
                return
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            # Occurrences of one pair may stand side by side (aaa): every second of a run merges.
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            heads = np.flatnonzero(run)
            even = (np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0
            # One rank can stand for several pieces; only the leftmost piece's pair merges in this round.
            lead = pair[at[first]][np.cumsum(first) - 1]
            take = at[first | (even & (pair[at] == lead) & self.safe[pair[at]])]
            symbols[take] = pair[take]
            keep = ~done
            keep[take + 1] = False
            moved = (np.cumsum(keep) - 1)[take]
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            stale = np.concatenate([moved, moved[moved > 0] - 1])

    def _queue(self, symbols: list[int]) -> list[int]:
        """One very long word by a queue of pairs, in time n log n."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, queue = [True] * n, []

        def push(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] < self.size and symbols[j] < self.size:
                piece = self.pair_of.get(symbols[i] * self.size + symbols[j])
                if piece is not None:
                    heapq.heappush(queue, (int(self.rank[piece]), i, symbols[i], symbols[j], piece))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b, piece = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = piece, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [symbols[i] for i in range(n) if alive[i]]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, spaces already marked."""
        out: list[tuple[int, ...]] = [()] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            flat = "".join(words[i] for i in short)
            points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
            chars, which = np.unique(points, return_inverse=True)
            number = np.array([self.id_of.get(chr(c), self.size + i) for i, c in enumerate(chars.tolist())], np.int64)
            tail = {self.size + i: [self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for i, c in enumerate(chars.tolist())}
            word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
            for of, symbols in self._rounds(number[which], word):
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                ends = np.append(starts[1:], len(of)).tolist()
                ids, plain = symbols.tolist(), np.maximum.reduceat(symbols, starts) < self.size
                for k, s, e, p in zip(of[starts].tolist(), starts.tolist(), ends, plain.tolist()):
                    got = ids[s:e] if p else [x for i in ids[s:e] for x in (tail[i] if i >= self.size else (i,))]
                    out[short[k]] = tuple(got)
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                unknown = {c: self.size + k for k, c in enumerate(sorted({c for c in w if c not in self.id_of}))}
                char = {v: [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")] for c, v in unknown.items()}
                got = self._queue([self.id_of.get(c, unknown.get(c)) for c in w])
                out[i] = tuple(x for g in got for x in (char[g] if g >= self.size else (g,)))
        return out


class Encoder:
    """Encodes texts word by word and remembers the words it has met."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        # Words without their first space mark, their ids, and the ids as text.
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, str] = {}
        # One object per id keeps the memory of a word small.
        self.one = list(range(self.model.size))
        self.names = list(map(str, self.one))

    def _split(self, text: str) -> list[str]:
        """The words of a text, each without the one space mark that starts it."""
        if "  " not in text and SPACE not in text and text.strip(" ") == text:
            return text.split(" ") if text else []
        return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        split = list(map(self._split, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.shown.clear()
        fresh = list(set(chain.from_iterable(split)).difference(self.known))
        one, name = self.one, self.names
        for w, ids in zip(fresh, self.model.encode_words([SPACE + w for w in fresh])):
            self.known[w] = tuple([one[i] for i in ids])
            self.shown[w] = " ".join([name[i] for i in ids])
        return split

    def ids(self, words: list[str]) -> list[int]:
        """Ids of a text, given by its words, with the end id."""
        return list(chain(chain.from_iterable(map(self.known.__getitem__, words)), (self.model.end,)))

    def shown_ids(self, words: list[str]) -> str:
        """The same ids in decimals, joined by one space."""
        return " ".join([*map(self.shown.__getitem__, words), self.names[self.model.end]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id."""
        return list(map(self.ids, self.words(texts)))

    def decode(self, ids: list[int]) -> str:
        return self.model.processor.decode(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a model file, kept by the Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an array of ids per row, end id last. Null texts are empty and have the end id alone.

    All columns pass through; an existing ``out_col`` raises. No rows give no rows.
    """
    if out_col in docs.columns:
        raise ValueError(f"the documents already have a column {out_col}")
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start, end in slices(batch, at):
                part = batch.slice(start, end - start)
                ids = pa.array(enc.encode(text_list(part.column(at))), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids stand for; null ids give null."""
    if out_col in encoded.columns:
        raise ValueError(f"the rows already have a column {out_col}")
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if ids is None else enc.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row: encoded, then decoded, in one pass.

    Null texts are empty; repeated rows stay; columns beside id and text are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(path), hashlib.sha256
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                words = enc.words(text_list(part.column(1)))
                encoded = list(map(enc.ids, words))
                columns = [
                    part.column(0),
                    pa.array([len(ids) for ids in encoded], pa.int64()),
                    pa.array([sha(enc.shown_ids(w).encode()).hexdigest() for w in words], pa.string()),
                    pa.array([sha(enc.decode(ids).encode()).hexdigest() for ids in encoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
