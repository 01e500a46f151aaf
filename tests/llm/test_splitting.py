"""Splitting at natural boundaries."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import splitting as sp


def walk(levels, n, limit):
    """The greedy cuts of one item, one after the other."""
    out, at = [], 0
    while n:
        least = at + max(limit.size // 2, limit.overlap + 1)
        if at + limit.size >= n:
            out.append((at, n))
            return out
        end = at + limit.size
        for level in (4, 3, 2, 1):
            best = max((p for p in range(least, at + limit.size + 1) if levels[p] >= level), default=-1)
            if best >= 0:
                end = best
                break
        out.append((at, end))
        back = end - limit.overlap
        word = max((p for p in range(0, max(back, 0) + 1) if levels[p] >= 1), default=-1)
        if limit.overlap and word > at and back - word <= limit.overlap:
            back = word
        at = max(back, at + 1)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n한글。", max_size=120), min_size=1, max_size=4), st.integers(2, 20), st.integers(0, 8))
def test_doubling_gives_the_greedy_cuts(texts, size, overlap):
    limit = sp.Limit("chars", size, min(overlap, size - 1))
    got = sp.pieces_of(texts, limit)
    for t, pieces in zip(texts, got):
        from millrace.llm import slices as S

        levels = sp.char_levels(S.code_points([t])[0]) if t else np.zeros(1)
        assert [(a, b) for a, b, _ in pieces] == walk(levels, len(t), limit)
        assert all(0 < b - a <= size for a, b, _ in pieces)
        if pieces:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
        for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]):
            assert b - c >= min(limit.overlap, b - 1) or c == b - limit.overlap


def test_words_are_units():
    text = " ".join(f"w{i}." if i % 9 == 8 else f"w{i}" for i in range(500))
    pieces = sp.pieces_of([text, "", "  \n ", "one"], sp.Limit("words", 180, 20))
    assert [p[2] for p in pieces[3]] == [1] and pieces[1] == [] and pieces[2] == []
    words = [text[a:b].split() for a, b, _ in pieces[0]]
    assert all(len(w) == n <= 180 for w, (_, _, n) in zip(words, pieces[0]))
    assert all(w[-1].endswith(".") for w in words[:-1])
    for x, y in zip(words, words[1:]):
        assert x[-20:] == y[:20]


def test_long_unbroken_text_is_cut_hard():
    (pieces,) = sp.pieces_of(["x" * 100_000], sp.Limit("chars", 4000, 200))
    assert all(b - a <= 4000 for a, b, _ in pieces) and pieces[-1][1] == 100_000
    assert all(b - c == 200 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))


def test_normalise():
    assert sp.normalise("ａ \r\nb\t\r\r\r\r\nc  ") == "a\nb\n\nc"
    assert sp.normalise("") == ""


def test_bad_limits():
    for bad in (("bytes", 5, 1), ("chars", 0, 0), ("chars", 5, 5)):
        with pytest.raises(ValueError):
            sp.Limit(*bad)


def test_tables(spark):
    r = random.Random(2)
    long = "# Top\n\n" + "\n\n".join("Word " * r.randint(20, 60) + "end." for _ in range(40))
    raw = spark.createDataFrame([("d1", long, "2024-01-01"), ("d1", long, "2024-02-01"), ("d2", "short", "2024-01-01"), ("d2", "x" * 5000, "2023-01-01"), (None, None, None), ("d3", "", None)], "doc_id string, content string, ingested_at string")
    drafts = spark.createDataFrame([("d1", 0, "y " * 900, None), ("d1", 0, "y " * 900, None), ("d1", 1, "z", "S")], "doc_id string, draft_no int, text string, section string")
    chunks = spark.createDataFrame([("c1", "w " * 400, 3), ("c1", "w " * 400, 3), ("c2", None, None)], "chunk_id string, text string, token_count int")
    limits = spark.createDataFrame([("doc", "chars", 4000, 200), ("draft", "chars", 1200, 120), ("chunk", "words", 180, 20)], "item_kind string, size_unit string, max_size int, overlap_size int")
    out = sp.split_tables(raw, drafts, chunks, limits).collect()
    cut = {(x.item_kind, x.item_id, x.draft_no) for x in out if x.n_pieces > 1}
    # d2 is judged by its latest delivery only.
    assert cut == {("doc", "d1", -1), ("draft", "d1", 0), ("chunk", "c1", -1)}
    assert len(out) == len({(x.item_kind, x.item_id, x.draft_no, x.piece_no) for x in out})
    assert all(x.piece_section == "Top" for x in out if x.item_id == "d1" and x.item_kind == "doc")
    assert {x.piece_section for x in out if x.item_kind == "draft" and x.draft_no == 1} == {"S"}
    assert {x.piece_section for x in out if x.item_kind == "draft" and x.draft_no == 0} == {None}
    assert sp.split_tables(raw.limit(0), drafts.limit(0), chunks.limit(0), limits).count() == 0
