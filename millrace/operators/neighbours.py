"""Nearest neighbours by shared keywords without forming all pairs: sets meet at the subsets they share."""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import retrieval

#: Subsets that are sorted at once; a hot keyword's subsets are taken in several passes.
MOST_SUBSETS = 1 << 22
_NONE, _ID = np.iinfo(np.int64).max, 40


def most_frequent(tokens: Column, k: int) -> Column:
    """The ``k`` most frequent of a text's tokens, ties in their own order, without a row for each token."""

    @F.pandas_udf(ST.ArrayType(ST.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [x for x, _ in heapq.nsmallest(k, Counter(t).items(), key=lambda p: (-p[1], p[0]))], na_action="ignore")

    return run(tokens)


def jaccard_top(sets: DataFrame, floor: float, k: int) -> DataFrame:
    """(node, other, weight, rank): the ``k`` best neighbours of each set by Jaccard from ``floor`` on, ties by other, of sets (id bigint, terms array<bigint>).

    Sets are small (a set of n terms has 2^n subsets) and floor is above 0.
    Of the sets that hold a subset S, those that are shorter, then those of
    lower id, are neighbours no worse than the later ones to any set that
    shares just S with them. So if y is among the k best of x, it is among the
    first k + 1 sets (x itself may be one) that hold all they share: per subset
    only so many can matter, however many sets hold it. A subset is looked at
    where its rarest term is, so a set goes to its rarest terms only.
    """
    each = sets.select("id", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    own = each.join(df, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term")))["term"].alias("terms")).withColumn("m", F.size("terms"))
    last = (F.col("m") - F.ceil(F.col("m") * floor)).cast("int")  # at least ceil(m * floor) terms are shared, the rarest of them at this place or before
    at = own.select("id", "m", "terms", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    at = at.select("id", "m", F.get("terms", F.col("i")).alias("term"), F.slice("terms", F.col("i") + 1, F.col("m") - F.col("i")).alias("terms"))
    parts = 4 * max(retrieval.LEAST_PARTS, sets.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m, terms in _groups(batches):
            yield _nearest(ids, m, terms, floor, k)

    found = at.repartition(parts, "term").sortWithinPartitions("term").mapInArrow(run, "node bigint, other bigint, weight double")
    # A pair may come from several terms; where all it shares was looked at, its weight is the greatest and right.
    found = found.repartition("node").groupBy("node", "other").agg(F.max("weight").alias("weight"))
    return retrieval.top(found.withColumn("weight", F.round("weight", 9)), "node", "weight", "other", k)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Whole terms' rows, many terms at once while they are few rows: ids, sizes, and the terms from the own one on."""
    held, n = [], 0
    for batch in batches:
        term = batch["term"].to_numpy()
        ends = np.flatnonzero(np.diff(term)) + 1
        if n and len(term) and term[0] != held[-1]["term"][-1].as_py():
            ends = np.concatenate([[0], ends])
        # Cut at the last end of a term once enough is held.
        if len(ends) and n + ends[-1] >= 1 << 15:
            yield _arrays([*held, batch.slice(0, ends[-1])])
            held, n, batch = [], 0, batch.slice(ends[-1])
        held, n = [*held, batch], n + batch.num_rows
    if n:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    t = pa.Table.from_batches(held).combine_chunks()
    lists = t["terms"].combine_chunks()
    length = lists.value_lengths().to_numpy()
    return t["id"].to_numpy(), t["m"].to_numpy(), np.split(lists.flatten().to_numpy(), np.cumsum(length)[:-1])


def _weights(most: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the weight by (shared, size, size), the best first, -1 below the floor; weights by place."""
    s, x, y = np.ogrid[: most + 1, : most + 1, : most + 1]
    union = x + y - s
    w = np.where((s > 0) & (s <= np.minimum(x, y)), s / np.maximum(union, 1), 0.0)
    values = np.unique(w[w >= floor])[::-1]
    return np.where(w >= floor, len(values) - 1 - np.searchsorted(values[::-1], w), -1), values


def _nearest(ids: np.ndarray, m: np.ndarray, terms: list[np.ndarray], floor: float, k: int) -> pa.RecordBatch:
    """(node, other, weight) of the rows of some terms: the ``k`` best that each finds by the subsets whose rarest term is its own here.

    The same id may come several times, once a term; rows of different terms have no subset in common.
    """
    names, name = np.unique(ids, return_inverse=True)  # in the order of ids, for ties
    order = np.lexsort((name, m))
    name, m = name[order], m[order].astype(np.int64)
    length = np.array([len(terms[i]) for i in order])
    place, values = _weights(int(m.max()), floor)
    kinds = []  # rows of one size and length, their terms mixed in two ways, subsets of the rest that are large enough
    for x, n in sorted(set(zip(m.tolist(), length.tolist()))):
        rows = np.flatnonzero((m == x) & (length == n))
        a = np.stack([terms[i] for i in order[rows]]).astype(np.uint64).T.copy()
        b = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        b ^= b >> np.uint64(32)
        least = next(s for s in range(1, x + 1) if (place[s, x] >= 0).any())
        kinds += [(rows, a, b, [c for s in range(max(least, 1), n + 1) for c in itertools.combinations(range(1, n), s - 1)])]
    passes = -(-sum(len(rows) * len(subsets) for rows, _, _, subsets in kinds) // MOST_SUBSETS)
    best = np.full((k, len(m)), _NONE)
    for now in range(passes):
        row, one, two, size = [], [], [], []
        for rows, a, b, subsets in kinds:
            for c in subsets:
                x = a[0].copy()
                for i in c:
                    x += a[i]
                mine = slice(None) if passes == 1 else np.flatnonzero((x >> np.uint64(24)) % np.uint64(passes) == now)
                y = b[0][mine].copy()
                for i in c:
                    y += b[i][mine]
                row.append(rows[mine])
                one.append(x[mine])
                two.append(y)
                size.append(np.full(len(y), len(c) + 1, np.int8))
        _better(best, *map(np.concatenate, (row, one, two, size)), m, name, place)
    at, which = np.nonzero(best.T != _NONE)
    code = best[which, at]
    return pa.RecordBatch.from_arrays([pa.array(names[name[at]]), pa.array(names[code & ((1 << _ID) - 1)]), pa.array(values[code >> _ID])], ["node", "other", "weight"])


def _better(best: np.ndarray, row: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray, m: np.ndarray, name: np.ndarray, place: np.ndarray) -> None:
    """Take into ``best``, codes of weight and neighbour by row, what the subsets (``one``, ``two``) of rows bring."""
    slots = (1 << int(4 * len(row)).bit_length()) - 1
    slot = ((one ^ (one >> np.uint64(32))) & np.uint64(slots)).astype(np.int64)
    some = np.bincount(slot)[slot] > 1  # most subsets are of one row only
    row, one, two, size = row[some], one[some], two[some], size[some]
    order = np.lexsort((row, two, one))
    row, one, two, size = row[order], one[order], two[order], size[order]
    first = np.ones(len(row), bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    start = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    n, own = np.diff(np.append(start, len(row)))[run], np.arange(len(row)) - start[run]
    at, codes = [np.tile(np.arange(best.shape[1]), len(best))], [best.ravel()]
    for j in range(len(best)):  # the first k of the run besides itself
        other = j + (own <= j)
        ok = np.flatnonzero(other < n)
        x, y = row[ok], row[start[run[ok]] + other[ok]]
        w = place[size[ok], m[x], m[y]].astype(np.int64)
        good = w >= 0
        at.append(x[good])
        codes.append((w[good] << _ID) | name[y[good]])
    at, codes = np.concatenate(at), np.concatenate(codes)
    for j in range(len(best)):
        best[j] = _NONE
        np.minimum.at(best[j], at, codes)
        rest = (codes & ((1 << _ID) - 1)) != (best[j][at] & ((1 << _ID) - 1))
        at, codes = at[rest], codes[rest]
