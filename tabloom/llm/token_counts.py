"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both agree.

A tokenizer of words reads a text from left to right and starts every word afresh: what
follows the start of a word does not depend on what stands before it. Two encodings of
overlapping chunks may therefore be joined at a place where both start a word, far enough
from the ends of both chunks that no word, special token or normalised character there was
cut. If the overlap has no such place, it is widened, to the whole text if need be.

White space is such a place always: no word holds it, no special token holds it, and no
character is normalised together with it. Texts that are not huge are therefore encoded
at their spaces, and a task encodes a word that it has met before only once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, small_batches, text_list

# Characters of a chunk, of its overlap with the next one, and of a chunk's edge that proves nothing.
CHUNK = 1 << 14
OVERLAP = 512
EDGE = 64
TOKEN_LIMIT = 2048
# Words whose counts a task remembers.
REMEMBERED = 500_000
# Words that are encoded together.
TOGETHER = 1000


def _starts_word(encoding, at: int) -> int | None:
    """The number of tokens before a place, if a token there starts a word and shares no character with the one before."""
    token = encoding.char_to_token(at)
    if not token or encoding.token_to_chars(token)[0] != at or encoding.token_to_chars(token - 1)[1] > at:
        return None
    word = encoding.token_to_word(token)
    return token if word is not None and word != encoding.token_to_word(token - 1) else None


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> list[int]:
    """The ids of ``tokenizer`` for a whole text, encoded chunk by chunk.

    Each chunk overlaps the one before it. From the common word starts of the overlap the
    last is taken: tokens before it come from the earlier chunk, tokens after it from the
    later one. Without one, the later chunk starts earlier and the earlier one ends later,
    by twice as much each time.
    """
    ids: list[int] = []
    start, end = 0, min(chunk, len(text))
    now, first = tokenizer.encode(text[start:end], add_special_tokens=False), 0
    while end < len(text):
        wide, reach = overlap, end
        while True:
            begin, reach = max(end - wide, start), min(end + (wide if wide > overlap else 0), len(text))
            if begin == start:  # widened over the whole chunk: encode both as one, twice as long each time
                stop = min(end + max(chunk, end - start), len(text))
                now, end = tokenizer.encode(text[start:stop], add_special_tokens=False), stop
                break
            if reach > end:
                now = tokenizer.encode(text[start:reach], add_special_tokens=False)
            stop = min(reach + chunk, len(text))
            later = tokenizer.encode(text[begin:stop], add_special_tokens=False)
            for at in range(reach - edge - 1, begin + edge - 1, -1):
                a = _starts_word(now, at - start)
                b = _starts_word(later, at - begin) if a is not None and a >= first else None
                if b is not None:
                    break
            else:
                a = b = None
            if b is not None:
                ids += now.ids[first:a]
                now, first, start, end = later, b, begin, stop
                break
            wide *= 2
    return ids + now.ids[first:]


class Counter:
    """Counts tokens of texts, and remembers the counts of words between spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode words together, spaces between them, and count the tokens that start in each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(size + 1) - size - 1
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        places = np.fromiter((s for s, _ in encoded.offsets), np.int64, len(encoded))
        owner = np.searchsorted(starts, places, side="right") - 1
        self.known.update(zip(words, np.bincount(owner, minlength=len(words)).tolist()))

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text."""
        words = [t.replace("\n", " ").split(" ") if len(t) <= chunk else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list(set(chain.from_iterable(words)).difference(self.known))
        for at in range(0, len(fresh), TOGETHER):
            self._learn(fresh[at : at + TOGETHER])
        count = self.known.__getitem__
        return [
            sum(map(count, w)) if len(t) <= chunk else len(spliced_ids(self.tokenizer, t, chunk, overlap))
            for t, w in zip(texts, words)
        ]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, kept by the Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = TOKEN_LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row.

    Counts are those of the library for whole texts. Null texts are empty and have 0 bytes
    and tokens; repeated rows stay; an empty table gives no rows; columns beside id and
    text are not looked at. A task holds one batch of texts and one chunk's tokens.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                texts = text_list(part.column(1))
                counts = counter(path).counts(texts, chunk, overlap)
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                n_tokens = pa.array(counts, pa.int64())
                over = pa.array([n > limit for n in counts], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, n_tokens, over], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
