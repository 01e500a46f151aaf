"""Encoding, token counts and mixing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, slices

LIBRARY = os.path.join(bpe.VOCABULARIES, "byte_bpe_50k.json")
PIECES = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "\t", "1", "!", "a", "'ll", "\xa0", "　", "é", "한", "é", "\r\n", "'S", "½", "\x1c", "\x85", "<|endoftext|>", "日", "😀", ""]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def encode(texts):
    offsets, ids = bpe.encoder(bpe.vocabulary()).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_same_as_library_on_random_texts(library):
    r = random.Random(4)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 16))) for _ in range(5000)]
    assert encode(texts) == library(texts)


def test_every_code_point(library):
    texts = [f"{chr(c)}a{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 0]
    assert encode(texts) == library(texts)


def test_long_unbroken_and_round_trip(library):
    texts = ["a" * 30000, "가나다" * 5000, " " * 10000 + "x", "ab" * 7000 + " c"]
    got = encode(texts)
    assert got == library(texts)
    assert [bpe.decode(x, bpe.vocabulary()) for x in got] == texts


def test_merge_is_leftmost_of_lowest_rank():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3, b"ab": 4}
    assert bpe.merge(b"aaab", ranks) == [2, 4]
    assert bpe.merge(b"aab", ranks) == [3]


def test_equal_hashes_fall_back_on_contents(monkeypatch):
    import numpy as np

    monkeypatch.setattr(slices, "slice_hashes", lambda p, s, e: np.zeros(len(s), np.uint64))
    assert encode(["ab cd ab"]) == [bpe.encoder(bpe.vocabulary()).encode(["ab cd ab"])[1].tolist()]
    points, _ = slices.code_points(["abcdab"])
    codes, first = slices.distinct_slices(points, np.array([0, 2, 4]), np.array([2, 4, 6]))
    assert codes.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_operator_defines_null_empty_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode(df, bpe.vocabulary())
    assert out.columns == ["doc_id", "ids"]
    got = sorted((r.doc_id, r.ids) for r in out.collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert bpe.encode(df.limit(0), bpe.vocabulary()).count() == 0
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, bpe.vocabulary()).collect()}
    assert counts == {1: 0, 2: 0, 3: 2}


TARGETS = [("Big-One", 0.5, 1), ("small", 0.3, 4), (" other ", 0.2, 2), ("absent", None, 1), (None, 0.1, 1)]


def sized(spark, extra=()):
    r = random.Random(1)
    rows = [(i, "big_one" if i % 3 else " BIG-ONE", r.randint(1, 400)) for i in range(3000)] + [(10_000 + i, "small", 50) for i in range(60)] + [(20_000 + i, "other", r.randint(10, 90)) for i in range(900)] + [(30_000, "unlisted", 10), (30_001, None, 10), (30_002, "small", 0), (None, "small", 9)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, source string, n_tokens bigint")


def test_mix_reaches_shares_within_caps(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    docs = sized(spark, extra=[(1, "big_one", 5), (1, "big_one", 5)])
    out = mixing.mix(docs, targets)
    rows = out.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    caps = {"big_one": 1, "small": 4, "other": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    report = {r.source: r for r in mixing.shares(out, targets).collect()}
    total = sum(r.n_tokens * r.copies for r in rows)
    for name, share in (("big_one", 0.5), ("small", 0.3), ("other", 0.2)):
        assert abs(report[name].reached_share - share) < 0.01, name
    # The source that limits the mix is used up to its cap.
    assert abs(total - 60 * 50 * 4 / 0.3) / total < 0.02
    assert {r.copies for r in rows if r.source == "small"} == {4}


def test_mix_is_the_same_again_and_weights_count(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    docs = sized(spark)
    a, b = (sorted(map(tuple, mixing.mix(docs, targets).collect())) for _ in range(2))
    assert a == b
    heavy = docs.withColumn("w", F.when(F.col("doc_id") < 300, 5.0).when(F.col("doc_id") < 400, None).otherwise(1.0))
    out = mixing.mix(heavy, targets, weight="w").collect()
    used = {r.doc_id for r in out}
    often = sum(i in used for i in range(300)) / 300
    assert often > 1.5 * sum(i in used for i in range(1000, 3000)) / 2000
    report = {r.source: r.reached_share for r in mixing.shares(mixing.mix(heavy, targets, weight="w"), targets).collect()}
    assert abs(report["big_one"] - 0.5) < 0.03


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(sized(spark).limit(0), targets).count() == 0
    assert mixing.mix(sized(spark), targets.limit(0)).count() == 0
    report = mixing.shares(mixing.mix(sized(spark).limit(0), targets), targets).collect()
    assert {r.reached_share for r in report} == {0.0}


def test_mix_keeps_shares_and_inclusion(spark):
    """Reached shares are the targets within a document's tokens, caps hold, and over many seeds documents of one source come in about equally often by their weights."""
    rows = [(i, "ab"[i % 3 == 0], 10 + i % 7) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    size = {i: (s, n) for i, s, n in rows}
    mixed = [(x.doc_id, x.copies) for x in mixing.mix(docs, targets).collect()]
    total = sum(size[i][1] * c for i, c in mixed)
    for s, share, cap in (("a", 0.7, 2), ("b", 0.3, 1)):
        own = [(i, c) for i, c in mixed if size[i][0] == s]
        assert all(0 < c <= cap for _, c in own) and abs(sum(size[i][1] * c for i, c in own) / total - share) < 0.01
    assert {x.source: round(x.reached_share, 2) for x in mixing.shares(mixing.mix(docs, targets), targets).collect()} == {"a": 0.7, "b": 0.3}


def test_mix_inclusion_follows_weights(spark):
    """Over seeds, documents come in as often as their weight says, whatever their size."""
    rows = [(i, "a" if i < 500 else "b", 10 + i % 7, 1.0 + i % 2) for i in range(560)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, w double")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 4)], "source string, target_share double, max_repeats int")
    seen = {}
    for seed in range(4):
        for x in mixing.mix(docs, targets, seed=seed, weight="w").collect():
            seen[x.doc_id] = seen.get(x.doc_id, 0) + x.copies
    light, heavy = (sum(seen.get(i, 0) for i in range(k, 500, 2)) / 1000 for k in (0, 1))
    assert 0 < light < heavy <= 1 and abs(heavy / light - 2) < 0.25
    small, large = (sum(seen.get(i, 0) for i in range(500) if i % 7 == k) for k in (0, 6))
    assert abs(small / large - 1) < 0.3
