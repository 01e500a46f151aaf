"""Texts as flat arrays of code points, shared by the vectorised operators."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Code-point classes.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, or other."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (one entry more than texts)."""
    joined = "".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_ODD), run(_ODD_INVERSE)


def slice_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of points[start:end] for all slices at once, equal for equal content.

    Prefix sums of scrambled code points times powers of an odd base; the
    difference of two of them, times the inverse power, doesn't depend on place.
    """
    n = len(points) + 1
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    sums = np.zeros(n, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def distinct_slices(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each slice, the first slice of each code), by content, proven by comparison."""
    codes, kinds = pd.factorize(slice_hashes(points, start, end))
    first = np.zeros(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    size = end - start
    if len(codes):
        own, model = size, size[first[codes]]
        same = np.array_equal(own, model)
        if same:
            shift = np.repeat(start[first[codes]] - start, size)
            at = flat_ranges(start, size)
            same = np.array_equal(points[at], points[at + shift])
        if not same:  # two contents with one hash: fall back on the contents
            keys = [points[s:e].tobytes() for s, e in zip(start, end)]
            codes, kinds = pd.factorize(np.array(keys, dtype=object))
            first = np.zeros(len(kinds), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def flat_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … for size[0] values, then the same of the next, in one array."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def portions(batch: pa.RecordBatch, column: str, chars: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many characters, so that work arrays stay small."""
    sizes = batch.column(column)
    lengths = np.nan_to_num(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False).astype(float))
    group = ((np.cumsum(lengths) - lengths) // chars).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
