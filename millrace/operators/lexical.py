"""Keyword search to the best k: chunks are scored where they are read, block by block, and pairs are never shuffled."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Tokens whose terms are remembered; it only saves work.
REMEMBERED = 1 << 18


class Terms:
    """The terms of a set of queries: places in the query's list, and how often each query has them."""

    def __init__(self, queries: pa.Table, whole: str) -> None:
        """``queries`` has query_id, terms (list) and counts (list)."""
        self.names = queries["query_id"].combine_chunks()
        lists = queries["terms"].combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist() if len(lists) else [0]
        coded = lists.flatten().dictionary_encode()
        self.terms = coded.dictionary.to_pylist()
        self.at, self.n = coded.indices.to_numpy().tolist(), queries["counts"].combine_chunks().flatten().to_numpy().tolist()
        self.totals = np.array([sum(self.n[a:b]) for a, b in zip(self.starts, self.starts[1:])], dtype=np.int64)
        self.whole = whole

    def finder(self) -> Callable[[str], tuple[int, ...]]:
        """A function that gives the terms that a token is, or has within itself."""
        whole = re.compile(self.whole)
        own = {t: i for i, t in enumerate(self.terms) if whole.search(t)}
        inner = {t: i for i, t in enumerate(self.terms) if t not in own}
        lengths = sorted({len(t) for t in inner})

        @functools.lru_cache(REMEMBERED)
        def find(token: str) -> tuple[int, ...]:
            if whole.search(token):
                return (own[token],) if token in own else ()
            parts = {token[i : i + m] for m in lengths for i in range(len(token) - m + 1)}
            return tuple(inner[p] for p in parts if p in inner)

        return find


def _postings(tokens: pa.ListArray, find: Callable[[str], tuple[int, ...]], terms: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a block: where each term's rows start, the rows, in order, and how often each has the term."""
    coded = tokens.flatten().dictionary_encode()
    found = [find(t) for t in coded.dictionary.to_pylist()]
    size = np.array([len(f) for f in found], dtype=np.int64)
    every, first = np.array([t for f in found for t in f], dtype=np.int64), np.cumsum(size) - size
    token = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    n = size[token] if len(token) else np.zeros(0, np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key, count = np.unique(every[np.repeat(first[token], n) + within] * len(tokens) + np.repeat(row, n), return_counts=True)
    return np.searchsorted(key, np.arange(terms + 1) * len(tokens)).tolist(), key % max(len(tokens), 1), count


class Best:
    """The ``k`` best chunks of each query among blocks that come in the order of chunk_id: how many terms they have, and their places.

    A later row that only equals the k-th best loses by its id, so a block is
    looked through only for what is better.
    """

    def __init__(self, q: Terms, k: int) -> None:
        self.q, self.k, self.find, self.base = q, k, q.finder(), 0
        self.kind = np.uint8 if q.totals.max(initial=0) < 256 else np.int32
        self.got, self.place, self.least = np.zeros((len(q.names), k), np.int32), np.full((len(q.names), k), -1, np.int64), [0] * len(q.names)

    def take(self, tokens: pa.ListArray) -> None:
        q, k, got, place, least, kind = self.q, self.k, self.got, self.place, self.least, self.kind
        starts, rows, counts = _postings(tokens, self.find, len(q.terms))
        sum_ = np.zeros(len(tokens), kind)
        for i in range(len(q.names)):
            have = [(starts[t], starts[t + 1], n) for t, n in zip(q.at[q.starts[i] : q.starts[i + 1]], q.n[q.starts[i] : q.starts[i + 1]]) if starts[t] < starts[t + 1]]
            if sum(n for _, _, n in have) <= least[i]:
                continue
            sum_.fill(0)
            for a, b, n in have:
                sum_[rows[a:b]] += 1 if n == 1 else np.minimum(counts[a:b], n).astype(kind)
            if (top := int(sum_.max())) <= least[i]:
                continue
            new = np.flatnonzero(sum_ > least[i])
            if len(new) > k:
                new = new[np.argsort(top - sum_[new], kind="stable")[:k]]
            g, p = np.concatenate([got[i], sum_[new]]), np.concatenate([place[i], self.base + new])
            order = np.argsort(-g, kind="stable")[:k]
            got[i], place[i] = g[order], p[order]
            least[i] = int(got[i, -1])
        self.base += len(tokens)


def best(batches: Iterator[pa.RecordBatch], q: Terms, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, score): the ``k`` best of each query among all batches of (chunk_id, tokens), which come in the order of chunk_id."""
    found, ids = Best(q, k), []
    for batch in batches:
        found.take(batch["tokens"])
        ids.append(batch["chunk_id"])
    got, place = found.got, found.place
    i, j = np.nonzero(place >= 0)
    if len(i):
        of = pa.chunked_array(ids)
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([q.names.take(pa.array(x)), of.take(pa.array(place[x, y])).combine_chunks(), pa.array(got[x, y] / q.totals[x])], ["query_id", "chunk_id", "score"])
