"""Vectors of hashed features, where a model's are not at hand. BLAKE2b isn't built in, so each is an Arrow function of text."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .text import TOKENS

_TOKENS = re.compile(TOKENS)


@functools.lru_cache(1 << 16)
def _digest(feature: str, size: int) -> bytes:
    return hashlib.blake2b(feature.encode(), digest_size=size).digest()


@functools.lru_cache(1 << 18)
def _signed(feature: str, dimensions: int) -> int:
    """A feature's place, or its complement where it counts as negative."""
    d = hashlib.blake2b(feature.encode(), digest_size=16).digest()
    place = int.from_bytes(d[:8], "big") % dimensions
    return ~place if d[8] % 2 else place


def sparse_of(text: str, dimensions: int = 1 << 20) -> tuple[list[int], list[float]]:
    """Places, in order, and weights of a text's tokens: one plus the logarithm of their count, added where places collide, to length one."""
    weights: dict[int, float] = {}
    for token, n in Counter(_TOKENS.findall(text.lower())).items():
        at = int.from_bytes(_digest(token, 8), "big") % dimensions
        weights[at] = weights.get(at, 0.0) + 1 + math.log(n)
    length = math.hypot(*weights.values()) or 1.0
    places = sorted(weights)
    return places, [weights[p] / length for p in places]


def dense_of(text: str, dimensions: int = 64) -> np.ndarray:
    """Signed counts of a text's tokens and character triples in hashed places, to length one."""
    features = _TOKENS.findall(text.lower()) + [text[i : i + 3] for i in range(len(text) - 2)]
    at = np.array([_signed(f, dimensions) for f in features], dtype=np.int64)
    out = np.bincount(at[at >= 0], minlength=dimensions) - np.bincount(~at[at < 0], minlength=dimensions).astype(np.float64)
    return out / (np.linalg.norm(out) or 1.0)


def sparse_vector(text: Column, dimensions: int = 1 << 20) -> Column:
    """struct(indices, values) of a text's sparse vector; null stays null."""

    @F.pandas_udf(ST.StructType([ST.StructField("indices", ST.ArrayType(ST.IntegerType())), ST.StructField("values", ST.ArrayType(ST.DoubleType()))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(None, None) if t is None else sparse_of(t, dimensions) for t in s]
            yield pd.DataFrame(rows, columns=["indices", "values"], dtype=object)

    return run(text)


def dense_vector(text: Column, dimensions: int = 64) -> Column:
    """The hashed embedding of a text; null stays null."""

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: dense_of(t, dimensions), na_action="ignore")

    return run(text)


def sparse_dot(a: Column, b: Column) -> Column:
    """The dot product of two sparse vectors; those whose lists differ in length count as empty. Take vectors that are columns, not Python functions within this."""
    ok = lambda v: F.when(F.size(v["indices"]) == F.size(v["values"]), v)
    weight = F.map_from_arrays(ok(b)["indices"], ok(b)["values"])
    both = F.zip_with(ok(a)["indices"], ok(a)["values"], lambda i, x: x * F.coalesce(F.element_at(weight, i), F.lit(0.0)))
    return F.coalesce(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
