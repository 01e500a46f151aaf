"""Byte-level BPE of whole columns: boundaries from class arrays, merges from a cache.

The pre-tokenisation of the byte-level vocabularies is the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Read as an automaton over code-point classes, the transition of each place is
either "keep" or "a slice starts here", and these functions compose
associatively, so boundaries come from array scans over the whole batch, not
from a regex that walks each text. Slices keep their offsets; equal slices are
merged once, and merged slices stay in a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import slices as S

#: Where the public vocabularies are, unless a path is given.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Most slices that a worker remembers; beyond it the cache starts anew (results don't depend on it).
CACHE_SLICES = 400_000
#: The suffixes that the pattern cuts after an apostrophe. Fixed values.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


def pieces(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each slice of the pre-tokenisation starts, over texts laid end to end.

    ``offsets`` are the starts of the texts, with the total length last. No
    slice crosses from one text into the next.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = S.class_table()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # of texts; an empty text's start is the next one's
    space = kind == S.SPACE
    blank = points == 32
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = kind[:-1]
    head = first[:-1]
    # A change of class starts a slice, except that one blank goes to what follows it.
    start = (before != kind) | head
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~head[1:]
    start &= ~(after_blank & ~space)
    # The last of a run of white space stands alone or with what follows, unless the text ends there.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    start |= last
    # An apostrophe that starts a slice may take a suffix with it.
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        end = offsets[np.searchsorted(offsets, quote, side="right")]
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.zeros(len(quote), np.int64)
        for suffix in SUFFIXES:
            hit = (one == ord(suffix[0])) & (quote + len(suffix) < end)
            if len(suffix) == 2:
                hit &= two == ord(suffix[1])
            size[hit] = len(suffix)
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        start[quote + 1] = False
        rest = quote + size + 1
        inside = rest < end
        # What follows the suffix starts a slice, be it letters or another class; a blank run has its own rules.
        rest = rest[inside]
        rest = rest[~space[rest] | start[rest]]
        start[rest] = True
    return np.flatnonzero(start)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: the pair of lowest rank is merged first, the leftmost of equals.

    A heap over a linked list, so that long unbroken slices stay n·log n.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = right[i]
        if j >= n or right[j] != e:  # either half has changed since
            continue
        alive[j] = False
        right[i] = e
        if e < n:
            left[e] = i
            r = ranks.get(piece[i : right[e]])
            if r is not None:
                heapq.heappush(heap, (r, i, right[e]))
        if (k := left[i]) >= 0:
            r = ranks.get(piece[k:e])
            if r is not None:
                heapq.heappush(heap, (r, k, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of a token's bytes, then its id, line by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Ids of many texts at once. One per worker; see ``encoder``."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.known: dict[str, np.ndarray] = {}

    def _ids(self, word: str) -> np.ndarray:
        ids = self.known.get(word)
        if ids is None:
            ids = np.array(merge(word.encode(), self.ranks), np.int32)
            if len(word) <= 64:
                if len(self.known) >= CACHE_SLICES:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of each text's ids, one more than texts; all ids). Without ids only the offsets."""
        points, offsets = S.code_points(texts)
        start = pieces(points, offsets)
        end = np.append(start[1:], len(points))
        code, model = S.distinct_slices(points, start, end)
        joined = "".join(texts)
        words = [self._ids(joined[a:b]) for a, b in zip(start[model].tolist(), end[model].tolist())]
        sizes = np.array([len(w) for w in words], np.int64)
        each = sizes[code] if len(code) else np.zeros(0, np.int64)
        running = np.concatenate([[0], np.cumsum(each)])
        of_text = running[np.searchsorted(start, offsets)]
        if not ids:
            return of_text, np.zeros(0, np.int32)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        at = np.cumsum(sizes) - sizes
        return of_text, flat[S.flat_ranges(at[code], each)] if len(code) else flat


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """The path of a public rank file."""
    return os.path.join(VOCABULARIES, f"{name}.tiktoken")


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with ``out``, the ids of each text, as array<int>.

    Null and empty texts have an empty list. A column named ``out`` that ``df``
    already has is replaced; all other columns pass through, whatever they are
    called. Nothing is shuffled: each partition is encoded where it is read.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in S.portions(batch, text):
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                offsets, ids = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], names=[*names, out])

    return df.select(*(F.col(f"`{n}`") for n in [*names, text])).mapInArrow(run, schema)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """As ``encode``, but with the number of ids (bigint), 0 for null and empty texts."""
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.LongType(), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in S.portions(batch, text):
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                offsets, _ = own.encode(texts, ids=False)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.diff(offsets))], names=[*names, out])

    return df.select(*(F.col(f"`{n}`") for n in [*names, text])).mapInArrow(run, schema)


def decode(ids: list[int], path: str) -> str:
    """The text of ids (the inverse of the encoding)."""
    back = {v: k for k, v in read_ranks(path).items()}
    return b"".join(back[i] for i in ids).decode()



__all__ = ["Encoder", "count_tokens", "decode", "encode", "encoder", "merge", "pieces", "vocabulary"]
