"""The whole search of many questions: each task answers its own questions while all chunks pass by in the order of chunk_id, so candidates are never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import lexical

#: Chunks that are scored at once, columns of scores looked at by their greatest, and questions fused at once.
BLOCK, GROUP, FUSED = 1 << 15, 64, 1 << 10


def matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors to length one, and which rows have one; null and empty ones are zeros."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    has = size > 0
    out = np.zeros((len(lists), int(size.max(initial=0))))
    if has.any():
        out[has] = lists.flatten().to_numpy(zero_copy_only=False).reshape(int(has.sum()), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), has


class Nearest:
    """The ``k`` nearest of each vector among blocks that come in order; equal cosines, to 12 digits, keep the earlier place.

    Single precision finds what may count, with a margin above its error; what
    counts is then computed in double precision.
    """

    def __init__(self, m: np.ndarray, k: int) -> None:
        self.m, self.m4, self.k = m, m.astype(np.float32), k
        self.margin = (m.shape[1] + 8) * 2.0**-23
        self.best, self.place = np.full((len(m), k), -np.inf), np.full((len(m), k), -1, np.int64)

    def take(self, x: np.ndarray, base: int) -> None:
        groups = -(-len(x) // GROUP)
        x4 = np.zeros((groups * GROUP, x.shape[1]), np.float32)
        x4[: len(x)] = x
        step = max(1, (1 << 21) // len(x4))
        for a in range(0, len(self.m), step):
            best, place = self.best[a : a + step], self.place[a : a + step]
            s = self.m4[a : a + step] @ x4.T
            s[:, len(x) :] = -np.inf
            s = s.reshape(len(s), groups, GROUP)
            most = s.max(axis=2)
            least = best[:, -1] - self.margin
            if groups >= self.k and (new := np.flatnonzero(np.isneginf(least))).size:
                least[new] = np.partition(most[new], groups - self.k, axis=1)[:, groups - self.k] - 2 * self.margin
            rows, group = np.nonzero((most >= least[:, None]) & (most > -np.inf))
            near = s[rows, group]
            i, j = np.nonzero((near >= least[rows][:, None]) & (near > -np.inf))
            rows, cols = rows[i], group[i] * GROUP + j
            score = np.round(np.einsum("ij,ij->i", self.m[a + rows], x[cols]), 12)
            better = score > best[rows, -1]
            keep(best, place, rows[better], base + cols[better], score[better])


def keep(best: np.ndarray, place: np.ndarray, rows: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
    """Take scores at places into each row's best; of equal scores the earlier place stays."""
    if not len(rows):
        return
    k, some = best.shape[1], np.unique(rows)
    row = np.concatenate([np.repeat(some, k), rows])
    score, at = np.concatenate([best[some].ravel(), score]), np.concatenate([place[some].ravel(), at])
    order = np.lexsort((at, -score, row))
    row, score, at = row[order], score[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, score, at, rank = (v[rank < k] for v in (row, score, at, rank))
    best[row, rank], place[row, rank] = score, at


def fused(near: np.ndarray, near_at: np.ndarray, words: np.ndarray, words_at: np.ndarray, weight: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of each row's candidates, the best first, at most ``window``; place -1 is none. As ``retrieval.fuse``."""
    d = np.where(near_at >= 0, np.maximum(near, 0.0), 0.0)
    m = d.max(axis=1, keepdims=True)
    d = np.divide(d, m, out=np.zeros_like(d), where=m > 0)
    same = (words_at[:, :, None] == near_at[:, None, :]) & (words_at >= 0)[:, :, None]
    both = np.concatenate([weight * d + (1 - weight) * (same * words[:, :, None]).sum(axis=1), weight * 0.0 + (1 - weight) * words], axis=1)
    at = np.concatenate([near_at, np.where(same.any(axis=2), -1, words_at)], axis=1)
    score = np.where(at >= 0, np.floor(both * 1e9 + 0.5) / 1e9, -np.inf)
    order = np.lexsort((at, -score), axis=1)[:, :window]
    return np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)


def diverse(score: np.ndarray, valid: np.ndarray, x: np.ndarray, weight: float, k: int) -> np.ndarray:
    """Places of the ``k`` that maximal marginal relevance takes of each row, -1 where there are no more. As ``retrieval.mmr``."""
    high, low = np.where(valid, score, -np.inf).max(axis=1, keepdims=True, initial=-np.inf), np.where(valid, score, np.inf).min(axis=1, keepdims=True, initial=np.inf)
    span = np.where(high > low, high - low, 0.0)
    s = np.where(span > 0, (np.where(valid, score, 0.0) - np.where(valid.any(axis=1, keepdims=True), low, 0.0)) / np.where(span > 0, span, 1.0), 1.0)
    left, near, picked, every = valid.copy(), np.zeros(s.shape), np.full((len(s), k), -1, np.int64), np.arange(len(s))
    for n in range(min(k, s.shape[1])):
        value = np.where(left, np.round(weight * s - (1 - weight) * near, 12), -np.inf)
        i = value.argmax(axis=1)
        some = left[every, i]
        picked[some, n] = i[some]
        left[every, i] = False
        new = np.einsum("rcd,rd->rc", x, x[every, i])
        near = np.maximum(near, new) if n else new
    return picked


def answers(batches: Iterator[pa.RecordBatch], terms: lexical.Terms, vectors: np.ndarray, has: np.ndarray, k: int, pool: int, window: int, weight: float, mmr_weight: float) -> Iterator[pa.RecordBatch]:
    """(query_id, item_id, rank, status) of all questions, from batches of (chunk_id, tokens, embedding) in the order of chunk_id.

    Of the chunks that passed only those that are some question's candidate are kept.
    """
    asked = np.flatnonzero(has)
    words, near, base = lexical.Best(terms, pool), None, 0
    held, ids, x, full = np.zeros(0, np.int64), None, None, np.zeros(0, bool)
    for tokens, names, lists in _blocks(batches):
        block, there = matrix(lists)
        if x is None or not x.shape[1]:  # the first vectors
            x = np.zeros((len(held), block.shape[1]))
        if not block.shape[1]:
            block = np.zeros((len(block), x.shape[1]))
        words.take(tokens)
        if there.any() and len(asked):
            near = near or Nearest(vectors[asked], pool)
            own = np.flatnonzero(there)
            near.take(block[own], base) if len(own) == len(block) else _apart(near, block, own, base)
        at = np.unique(np.concatenate([words.place.ravel(), near.place.ravel() if near else held[:0]]))
        at = at[at >= 0]
        old, new = np.searchsorted(held, at[at < base]), at[at >= base] - base
        fresh = names.take(pa.array(new))
        ids = fresh if ids is None else pa.concat_arrays([ids.take(pa.array(old)), fresh])
        x, full, held, base = np.concatenate([x[old], block[new]]), np.concatenate([full[old], there[new]]), at, base + len(names)
    if not len(held):
        return
    none = np.full((1, pool), -1, np.int64)
    where = np.full(len(terms.names), -1, np.int64)
    where[asked] = np.arange(len(asked))
    for a in range(0, len(terms.names), FUSED):
        w = where[a : a + FUSED]
        near_at = np.where((w >= 0)[:, None], near.place[w], -1) if near else np.repeat(none, len(w), 0)
        near_score = near.best[w] if near else np.zeros((len(w), pool))
        total = np.maximum(terms.totals[a : a + FUSED, None], 1)
        score, at = fused(near_score, near_at, words.got[a : a + FUSED] / total, words.place[a : a + FUSED], weight, window)
        valid = at >= 0
        i = np.where(valid, np.searchsorted(held, at), 0)
        applied = (full[i] | ~valid).all(axis=1)
        picked = np.where(np.arange(min(k, at.shape[1]))[None, :] < valid.sum(axis=1)[:, None], np.arange(min(k, at.shape[1])), -1)
        if applied.any():
            picked[applied] = diverse(score[applied], valid[applied], x[i[applied]], mmr_weight, picked.shape[1])
        r, n = np.nonzero(picked >= 0)
        status = pa.array(np.where(applied[r], "mmr", "kept").tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([terms.names.take(pa.array(a + r)), ids.take(pa.array(i[r, picked[r, n]])), pa.array((n + 1).astype(np.int32)), status], ["query_id", "item_id", "rank", "status"])


def _apart(near: Nearest, block: np.ndarray, own: np.ndarray, base: int) -> None:
    """A block of which some rows have no vector: places count all rows."""
    near.take(block[own], base)
    here = near.place >= base
    near.place[here] = base + own[near.place[here] - base]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListArray, pa.Array, pa.ListArray]]:
    """Tokens, chunk_id and embedding of at least ``BLOCK`` chunks, but for the last."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        if (n := n + batch.num_rows) >= BLOCK:
            yield tuple(pa.concat_arrays([b[c] for b in some]) for c in ("tokens", "chunk_id", "embedding"))
            some, n = [], 0
    if n:
        yield tuple(pa.concat_arrays([b[c] for b in some]) for c in ("tokens", "chunk_id", "embedding"))
