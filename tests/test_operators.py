"""Operators against hand cases, brute force and invariants."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashed
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking, diagnose, grounding, intervals, joint, judged, lexical, neighbours, optimize, preprocess, report, retrieval
from millrace.sources import readers, writers
from millrace.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def chars(s):
    return T.answer_chars(F.lit(s))


def test_answer_matching_by_hand(spark):
    assert one(spark, T.char_f1(chars("332cm입니다"), chars("332cm"))) == pytest.approx(10 / 13)
    assert one(spark, T.answer_match(chars("332cm입니다"), chars("332cm"))) == 1.0
    assert one(spark, T.answer_match(chars("x"), chars(""))) == 0.0
    assert one(spark, T.char_f1(chars(None), chars("a"))) == 0.0
    ref = "abcdefghij" * 3
    assert one(spark, T.answer_match(chars("zzzz " + ref + " zzzzzzzzzzzz"), chars(ref))) == pytest.approx(26 / 30, abs=0.14)
    assert one(spark, T.normal_answer(F.lit("  A, 'b'  (C)! "))) == "a b c"


def test_abstention(spark):
    assert one(spark, T.abstains(F.lit("I DON'T KNOW"))) and one(spark, T.abstains(F.lit(" \n"))) and not one(spark, T.abstains(F.lit("42")))
    assert not one(spark, T.abstains(F.lit("not mentioned"))) and one(spark, T.abstains(F.lit("not mentioned"), more=True))


def test_vectors(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, V.cosine(a(1, 0), a(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, V.cosine(a(0, 0), a(1, 1))) == 0.0 and one(spark, V.cosine(a(1), a(1, 1))) == 0.0


def test_fixed_chunks_by_hand(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "   ")], "id int, t string")
    got = [(r.start_pos, r.end_pos) for r in chunking.fixed(df, "t", 4, 1).orderBy("draft_no").collect()]
    assert got == [(0, 4), (3, 7), (6, 10)]
    with pytest.raises(ValueError):
        chunking.fixed(df, "t", 4, 4)


def test_greedy_chunks_are_slices(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices(["word ", "end. ", "\n", "\n\n", "# H\n", "한글 ", "x" * 30], k=r.randint(0, 80)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string")
    texts = dict(rows)
    for s in ("recursive", "recursive_sentence", "markdown", "markdown_recursive", "1"):
        out = chunking.chunk(df, "id", "t", s, 60, 10).collect()
        assert all(texts[c.id][c.start_pos : c.end_pos] == c.chunk_text for c in out)
        assert s == "markdown" or all(len(c.chunk_text) <= 60 for c in out)
        for i, t in rows:
            covered = {p for c in out if c.id == i for p in range(c.raw_start, c.raw_end)}
            assert all(p in covered for p, x in enumerate(t) if not x.isspace())


def test_raw_spans_leave_no_gap(spark):
    """Every character of a text lies in the raw span of a chunk, in texts with long blank runs too; spans of chunks are trimmed."""
    r = random.Random(7)
    rows = [(i, "".join(r.choices(["word ", "end. ", "\n", " " * 90, "\u3000", "# H\n", "x" * 30], k=r.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string")
    for s in ("fixed", "recursive", "recursive_sentence", "markdown", "markdown_recursive"):
        out = chunking.chunk(df, "id", "t", s, 60, 10).collect()
        for i, t in rows:
            own = sorted((c for c in out if c.id == i), key=lambda c: c.draft_no)
            assert bool(own) == bool(t.strip()) and [c.draft_no for c in own] == list(range(len(own)))
            assert all(c.chunk_text == c.chunk_text.strip() == t[c.start_pos : c.end_pos] for c in own)
            covered = {p for c in own for p in range(c.raw_start, c.raw_end)}
            # Only blank sections behind the last one belong to none.
            assert not own or covered >= {p for p in range(len(t)) if not t[p].isspace()} | set(range(own[-1].raw_end if s.startswith("markdown") else len(t)))


def test_windows_against_a_loop():
    """The path through the successors of all positions is what a loop over the text gives."""
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choices(["ab ", "c. ", "\n", "\n\n", "。", "…", "x" * 9, " "], k=r.randint(0, 40)))
        size = r.randint(2, 25)
        overlap = r.randrange(size)
        for separators in (chunking.SEPARATORS, chunking.SENTENCE_SEPARATORS):
            want, a = [], 0
            while a < len(t):
                b = min(len(t), a + size)
                if b < len(t):
                    half = a + max(1, (b - a) // 2)
                    b = next((max(k for k in range(half + len(s), b + 1) if t[:k].endswith(s)) for s in separators if any(t[:k].endswith(s) for k in range(half + len(s), b + 1))), b)
                want.append((a, b))
                if b == len(t):
                    break
                a = next((k for k in range(max(a + 1, b - overlap), b) if not t[k].isspace()), max(a + 1, b))
            assert chunking.windows(t, size, overlap, separators) == (want if len(t) > size else [(0, len(t))] * bool(t))


def test_markdown_paths(spark):
    text = "pre\n# A\na\n\n\n## \n#### B\nb\n  \n# C\n"
    assert [(s, text[a:b], text[x:y]) for s, a, b, [(x, y)] in chunking.sections(text)] == [
        (None, "pre\n", "pre"), ("A", "# A\na\n\n\n## \n", "# A\na\n\n\n##"), ("A > B", "#### B\nb\n  \n", "#### B\nb"), ("C", "# C\n", "# C")]
    assert chunking.sections(" \n\t") == []
    chunking.register("halves", lambda t, n, o, k: [(None, 0, len(t), [(0, len(t) // 2), (len(t) // 2, len(t))])])
    df = spark.createDataFrame([(1, "ab cd")], "id int, t string")
    assert [(c.chunk_text, c.raw_start, c.raw_end) for c in chunking.chunk(df, "id", "t", "halves").collect()] == [("ab", 0, 2), ("cd", 2, 5)]


def test_math_problems(spark):
    text = "Preface\n1. Add\nx\n[2] Subtract\nSET 3: all\ny"
    df = spark.createDataFrame([(1, text, "math"), (2, text, None), (3, "1. one only", "math")], "id int, t string, kind string")
    got = [(c.id, c.section, c.chunk_text) for c in chunking.chunk(df, "id", "t", "markdown", kind="kind").collect()]
    assert got == [(1, "preamble", "Preface"), (1, "문제 1", "1. Add\nx"), (1, "문제 2", "[2] Subtract"), (1, "SET 3", "SET 3: all\ny"), (2, None, text), (3, None, "1. one only")]


def test_dedup_keeps_the_first(spark):
    rows = [(d, k, t) for d, k, t in ((2, 0, "a"), (1, 1, "a"), (1, 0, "b"), (3, 0, "a"), (3, 1, "c"))]
    keep, twins = chunking.dedup(spark.createDataFrame(rows, "doc_id int, draft_no int, chunk_text string"), ["doc_id", "draft_no"])
    assert {(x.doc_id, x.draft_no) for x in keep.collect()} == {(1, 1), (1, 0), (3, 1)} and {(x.doc_id, x.draft_no) for x in twins.collect()} == {(2, 0), (3, 0)}


def test_intervals_against_sets(spark):
    r = random.Random(2)
    spans = [("d", f"s{i}", a, a + r.randint(1, 3000)) for i in range(40) for a in [r.randint(0, 5000)]]
    parts = [("d", i, a, a + r.randint(1, 900)) for i in range(60) for a in [r.randint(0, 6000)]]
    s = spark.createDataFrame(spans, "doc string, span_id string, s_start int, s_end int")
    c = spark.createDataFrame(parts, "doc string, chunk_id int, c_start int, c_end int")
    pairs = intervals.touching(s, c, "doc")
    assert pairs.count() == sum(a < y and x < b for _, _, x, y in spans for _, _, a, b in parts)
    assert intervals.touching(s, c, "doc", contained=True).count() == sum(a <= x and y <= b for _, _, x, y in spans for _, _, a, b in parts)
    got = {r.span_id: r.covered for r in intervals.covered(pairs, ["span_id"]).collect()}
    for _, i, x, y in spans:
        assert got.get(i, 0) == len({p for _, _, a, b in parts for p in range(max(a, x), min(b, y))})


def test_dense_top_and_mmr(spark):
    r = random.Random(3)
    items = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, [1.0] * 8), (901, [1.0] * 8)]
    i = spark.createDataFrame(items, "item_id int, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(1, [1.0] * 8), (2, items[0][1])], "query_id int, embedding array<float>")
    got = retrieval.dense_top(q, i, 5).collect()
    every = i.withColumnRenamed("embedding", "_i").crossJoin(q).select("query_id", "item_id", F.round(V.cosine(F.col("embedding"), F.col("_i")), 6).alias("score"))
    want = retrieval.top(every, "query_id", "score", "item_id", 5).collect()
    assert sorted((x.query_id, x.rank, x.item_id) for x in got) == sorted((x.query_id, x.rank, x.item_id) for x in want)
    pool = spark.createDataFrame([(1, 1, 0.5, 1, [1.0, 0.0]), (1, 2, 0.5, 2, [1.0, 0.0]), (1, 3, 0.5, 3, [0.0, 1.0]), (2, 1, 0.9, 1, None)], "query_id int, item_id int, score double, rank int, embedding array<double>")
    got = {(x.query_id, x.place): (x.item_id, x.applied) for x in retrieval.mmr(pool, 0.5, 2).collect()}
    assert got == {(1, 1): (1, True), (1, 2): (3, True), (2, 1): (1, False)}
    assert retrieval.pool_size(5) == 20 and retrieval.window_size(0, 5) == 40


def test_keyword_scores(spark):
    q = spark.createDataFrame([(1, "사과 apple apple 3/4")], "query_id int, question string")
    c = spark.createDataFrame([("a", "풋사과 pineapple"), ("b", "apple apple 13/4x"), ("c", "none")], "chunk_id string, chunk_text string")
    got = {x.chunk_id: x.score for x in retrieval.keyword_scores(q, c).collect()}
    assert got == {"a": 0.25, "b": pytest.approx(0.75)}


def test_keyword_top_is_the_top_of_all_scores(spark, monkeypatch):
    r, words = random.Random(8), ["사과", "풋사과를", "사과3", "a/b", "xa/by", "apple", "pineapple", "3/4", "13/4", "7"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    q = spark.createDataFrame([(i, said(r.randint(1, 9))) for i in range(40)] + [(98, "?!"), (99, "사과 " * 300)], "query_id int, question string")
    c = spark.createDataFrame([(f"c{r.randint(0, 120):03}", said(r.randint(0, 12))) for _ in range(200)] + [("many", "풋사과 " * 280), (None, "apple")], "chunk_id string, chunk_text string").repartition(3)
    want = sorted(map(tuple, retrieval.top(retrieval.keyword_scores(q, c), "query_id", "score", "chunk_id", 4).select("query_id", "chunk_id", "score", "rank").collect()), key=str)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many blocks a partition
    try:
        assert sorted(map(tuple, retrieval.keyword_top(q, c, 4).collect()), key=str) == want
        monkeypatch.setattr(retrieval, "MOST_QUERIES", 9)
        assert sorted(map(tuple, retrieval.keyword_top(q, retrieval.spread(c, "chunk_id"), 4).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert retrieval.keyword_top(q.limit(0), c, 4).count() == retrieval.keyword_top(q, c.limit(0), 4).count() == 0


def test_keyword_search_joins_no_pairs(spark):
    q = spark.createDataFrame([(i, "one two") for i in range(30)], "query_id int, question string")
    c = spark.createDataFrame([(f"c{i:03}", "one two three") for i in range(400)], "chunk_id string, chunk_text string")
    got = retrieval.keyword_top(q, c, 5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.query_id, x.rank, x.chunk_id) for x in got.collect()) == [(i, k + 1, f"c{k:03}") for i in range(30) for k in range(5)]


def test_jaccard_top_against_all_pairs(spark, monkeypatch):
    r = random.Random(9)
    sets = {i * 3: r.sample(range(1, 15), r.randint(1, 8)) for i in range(150)} | {1000 + i: [7, 8, 9] for i in range(60)} | {2000: list(range(20, 28)), 2001: []}
    ids = {t: r.getrandbits(63) - (1 << 62) for t in range(1, 30)}
    want = set()
    for x, a in sets.items():
        near = [(-round(len({*a} & {*b}) / len({*a} | {*b}), 9), y) for y, b in sets.items() if y != x and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.3]
        want |= {(x, y, -w, i + 1) for i, (w, y) in enumerate(sorted(near)[:2])}
    d = spark.createDataFrame([(i, [ids[t] for t in s]) for i, s in sets.items()], "id bigint, terms array<bigint>")
    assert set(map(tuple, neighbours.jaccard_top(d, 0.3, 2).collect())) == want and len(want) > 300
    at = [(x, len(s), sorted(ids[t] for t in s)) for x, s in sets.items() if s]
    rows = [(x, n, t[i:]) for x, n, t in at for i in range(n)]
    import numpy as np

    def near(rows):
        b = neighbours._nearest(np.array([x for x, _, _ in rows]), np.array([n for _, n, _ in rows]), [np.array(t) for _, _, t in rows], 0.3, 2).to_pydict()
        return sorted(zip(b["node"], b["other"], b["weight"]))

    whole = near(rows)
    monkeypatch.setattr(neighbours, "MOST_SUBSETS", 500)  # many passes
    assert near(rows) == whole


def test_keyword_graph_joins_no_pairs(spark):
    # Sets that are all alike: each has all others for neighbours, of which two count.
    got = neighbours.jaccard_top(spark.createDataFrame([(i, [1, 2, 3, 4, 5, 6, 7, 8]) for i in range(20000)], "id bigint, terms array<bigint>"), 0.3, 2)
    assert got.count() == 40000 and {x.other for x in got.collect()} == {0, 1, 2}
    d = spark.createDataFrame([("a", ["b", "c", "a", "b"]), ("n", None), ("e", [])], "id string, t array<string>")
    assert {x.id: x.k for x in d.select("id", neighbours.most_frequent(F.col("t"), 2).alias("k")).collect()} == {"a": ["b", "a"], "n": None, "e": []}


def test_dense_partitions_give_k_rows_a_query(spark):
    r = random.Random(10)
    items = [(k, [float(r.randint(0, 2)) for _ in range(3)]) for k in range(200)]  # with many ties
    i = spark.createDataFrame(items, "item_id int, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(k, [float(r.randint(1, 3)) for _ in range(3)]) for k in range(9)], "query_id int, embedding array<double>")
    every = i.withColumnRenamed("embedding", "_i").crossJoin(q).select("query_id", "item_id", F.round(V.cosine(F.col("embedding"), F.col("_i")), 9).alias("score"))
    want = sorted((x.query_id, x.rank, x.item_id) for x in retrieval.top(every, "query_id", "score", "item_id", 4).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many batches a partition
    try:
        assert retrieval._near(q, i, 4, 5).count() == 2 * 9 * 4
        assert sorted((x.query_id, x.rank, x.item_id) for x in retrieval.dense_top(q, i, 4, 5).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


BASE = {"probe_id": "p", "has_truth": True, "answer_exists": True, "recall_at_k": 0.0, "top_k": 5, "missed": 1, "f1": 0.1, "oracle_f1": 0.9, "oracle_answered": True}
CASES = [
    ({"recall_at_k": 1.0, "f1": 0.9}, []),
    ({"fused_rank": 9, "window": 20}, ["retrieval_low_rank"]),
    ({"fused_rank": 9, "window": 20, "search_mode": "hybrid", "dense_rank": 2}, ["retrieval_rank_fusion_loss"]),
    ({"fused_rank": 9, "window": 20, "redundant": 5, "projected_rank": 4}, ["retrieval_duplicate_crowding"]),
    ({"fused_rank": 9, "window": 20, "reranked": True, "pre_visible": True, "pre_rank": 3}, ["retrieval_reranker_demotion"]),
    ({"fused_rank": 9, "window": 20, "reranked": True, "pre_visible": True, "pre_rank": 8}, ["retrieval_reranker_ineffective"]),
    ({"fused_rank": 9, "window": 20, "reranked": True, "pre_visible": True}, ["retrieval_rerank_candidate_miss"]),
    ({"lexical_hits_gold": True}, ["retrieval_lexical_mismatch"]),
    ({"lexical_hits_gold": False, "missed_in_corpus": True}, ["retrieval_semantic_mismatch"]),
    ({"missed_in_corpus": True}, ["retrieval_missing_gold"]),
    ({"oversized": 1}, ["chunking_overchunking"]),
    ({"split_spans": 1}, ["chunking_context_mismatch"]),
    ({"gold_in_corpus": False, "gold_all_absent": True, "oracle_f1": 0.9, "judged_abstention": True}, ["corpus_gap"]),
    ({"recall_at_k": 1.0, "missed": 0, "marked_abstention": True}, ["generation_wrongful_abstention"]),
    ({"answer_exists": False, "recall_at_k": -1.0, "missed": 0}, ["generation_abstention_failure"]),
    ({"recall_at_k": 1.0, "missed": 0, "oracle_f1": 0.1, "oracle_faithfulness": 0.2}, ["generation_hallucination"]),
    ({"recall_at_k": 1.0, "missed": 0, "oracle_f1": 0.1, "oracle_faithfulness": 0.9, "oracle_relevancy": 0.9}, ["bad_gold_answer"]),
    ({"recall_at_k": 1.0, "missed": 0, "faithfulness": 0.9}, ["context_noise_interference"]),
    ({"recall_at_k": 1.0, "missed": 0, "faithfulness": 0.2, "context_chars": 7000, "gold_position": 0.5}, ["lost_in_the_middle"]),
    ({"recall_at_k": 1.0, "missed": 0, "faithfulness": 0.2, "context_chars": 7000, "gold_position": 0.0}, ["too_long_context"]),
    ({"recall_at_k": 1.0, "missed": 0, "f1": 0.9, "faithfulness": 0.2}, ["generation_parametric_overreliance"]),
    ({"f1": 0.9, "faithfulness": 0.9}, []),
    ({"has_truth": False}, []),
]


def test_labels_by_hand(spark):
    rows = [BASE | change | {"probe_id": str(i)} for i, (change, _) in enumerate(CASES)]
    schema = ", ".join(f"{k} {v}" for k, v in diagnose.RECORD.items())
    df = spark.createDataFrame([tuple(r.get(k) for k in diagnose.RECORD) for r in rows], schema)
    got = {}
    for r in diagnose.diagnose(df).orderBy("probe_id", "ord").collect():
        got.setdefault(r.probe_id, []).append(r.label)
    for i, (change, want) in enumerate(CASES):
        assert got.get(str(i), []) == want, change


def test_scores_and_decisions(spark):
    assert one(spark, report.harmonic([F.lit(0.8), F.lit(0.2)])) == pytest.approx(0.32)
    assert one(spark, report.weighted({"faithfulness": F.lit(0.8), "response_relevancy": F.lit(0.6), "context_recall": F.lit(None).cast("double")})) == pytest.approx(0.72)
    assert one(spark, judged.correctness(F.lit(2), F.lit(1), F.lit(1), F.lit(0.8))) == pytest.approx(0.70)
    assert one(spark, diagnose.blend(F.lit(0.49), F.lit(0.73))) == pytest.approx(0.634)
    assert not one(spark, optimize.gate(F.lit(92), F.lit(0.55), F.lit(True))) and one(spark, optimize.gate(F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(True)))
    need = spark.createDataFrame([(v,) for v in (3, 4, 4, 5, 6, 7, 8, 12, 15, 100)], "v int")
    assert [(r.candidate, r.is_knee) for r in optimize.knee(need, "v").orderBy("candidate_no").collect()] == [(8, True), (12, False), (15, False)]
    shares = spark.createDataFrame([("a", 75, 1), ("b", 20, 2), ("c", 5, 3)], "k string, w int, o int")
    assert {r.k: r.share for r in optimize.apportion(shares, "k", "w", 30, "o").collect()} == {"a": 23, "b": 6, "c": 1}
    v = optimize.verdict(F.lit(0.5), F.lit(0.6), {"faithfulness": F.lit(0.4)})
    assert one(spark, v) == "rollback" and one(spark, optimize.verdict(F.lit(0.5), F.lit(0.52), {})) == "keep" and one(spark, optimize.verdict(F.lit(None).cast("double"), F.lit(1.0), {})) == "unjudgeable"
    f = spark.createDataFrame([("p", "x", True), ("p", "y", False), ("q", "x", True)], "probe_id string, label string, confirmed boolean")
    assert {(r.label, r.weight) for r in report.label_weights(f).collect()} == {("x", 1.5), ("y", 0.5)}
    ap = judged.context_precision(spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True)], "k string, rank int, verdict boolean"), "k").first()
    assert ap.context_precision == pytest.approx(0.8333, abs=1e-4)


def test_page_text(spark):
    pages = spark.createDataFrame([("d", i, f"Report {i}\nbody {'x' * i}\n- {i} -") for i in range(5)] + [("e", 0, "A"), ("e", 1, "A")], "doc string, page_no int, page string")
    got = {(r.doc, r.place, r.line) for r in preprocess.repeated_lines(pages, "doc").collect()}
    assert got == {("d", "first", "report #"), ("d", "last", "- # -")}
    spans = preprocess.spans(pages, "doc").filter("doc = 'd'").orderBy("page_no").collect()
    whole = "\n\n".join(r.page for r in pages.filter("doc = 'd'").orderBy("page_no").collect())
    assert all(whole[s.page_start : s.page_end].startswith(f"Report {s.page_no}") for s in spans)
    assert one(spark, preprocess.clean_body(F.lit("exam-\nple 가\n나 \n\n\n\nx"))) == "example 가 나\n\nx"
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"), F.lit(None).cast("string")))
    assert one(spark, preprocess.table_markdown(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, preprocess.normalise_document(F.lit("ａ \r\nb\n\n\n\nc "))) == "a\nb\n\nc"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("가나".encode("cp949"))
    (tmp_path / "b.txt").write_bytes("﻿다라".encode())
    got = {r.content for r in readers.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"가나", "다라"}
    import uuid

    assert one(spark, readers.doc_id(F.lit("a"), F.lit("b"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b"))
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"question": "q", "answer": "a"}), "{broken", json.dumps({"question": "q"})]))
    good, bad = readers.log_lines(spark, str(tmp_path / "log.jsonl"))
    assert good.count() == 1 and bad.count() == 2
    writers.write_log(good, bad, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps(x) for x in [{"q": "One  two", "gold_answer": "1"}, {"q": "one two", "gold_answer": "2"}, {"q": " ", "gold_answer": "3"}]))
    assert [r.ground_truth for r in readers.question_set(spark, str(tmp_path / "qa.jsonl")).collect()] == ["2"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": "t"}, {"id": "1", "text": "u"}]))
    with pytest.raises(Exception, match="repeated id"):
        readers.json_corpus(spark, str(tmp_path / "c.json")).collect()
    assert readers.read(spark, "nowhere", "x")[1] is not None
    p = spark.createDataFrame([("d", 0, 0, "abc"), ("d", 2, 1, "CDE"), ("d", 7, 2, "z")], "doc_id string, char_start int, seq int, text string")
    assert readers.stitch(p, "doc_id").first().text == "abCDE  z"
    b = spark.createDataFrame([("p", "1", None, 0, "heading_1", "T"), ("p", "2", "1", 1, "paragraph", "y"), ("p", "3", "1", 0, "bulleted_list_item", "x"), ("p", "4", None, 1, "paragraph", "end")], "page_id string, block_id string, parent_id string, pos int, type string, text string")
    assert readers.block_tree(b).first().content == "# T\n- x\ny\nend"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", [1.0], "d1"), ("b", [2.0], "d2")], "id string, v array<double>, doc_id string")
    new = spark.createDataFrame([("b", [3.0], "d2"), ("c", [], "d3")], "id string, v array<double>, doc_id string")
    out = writers.upsert(old, new, "id", "v")
    assert {(r.id, r.v[0]) for r in out.collect()} == {("a", 1.0), ("b", 3.0)}
    assert writers.delete(out, spark.createDataFrame([("d2",)], "doc_id string")).count() == 1
    with pytest.raises(Exception, match="vector of 2"):
        writers.check_dimension(out, "v", 2).collect()
    assert writers.write_slot(out, str(tmp_path), "a") == "b" and writers.read_slot(spark, str(tmp_path), "b").count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "r", "index", 1), (2, "2024-01-01 00:00:02", "r", "index", 1), (3, "2024-01-01 00:09:00", "r", "eval", 1)]
    spark.createDataFrame(rows, "event_id bigint, at string, run string, stage string, iteration int").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, at timestamp, run string, stage string, iteration int").parquet(str(tmp_path / "in"))
    out = progress.drain(progress.windowed(stream.withColumn("one", F.lit(1)), "at", "5 minutes", "stage", "one").select("stage", "n"), "test")
    assert {(r.stage, r.n) for r in out.collect()} == {("index", 2), ("eval", 1)}
    assert one(spark, progress.percent(F.lit("index"))) == 35 and one(spark, progress.percent(F.lit("serve"))) == 95
    assert progress.after(spark.createDataFrame(rows, "event_id bigint, at string, run string, stage string, iteration int"), 2).count() == 2


def test_minimal_cover_against_a_loop(spark):
    r = random.Random(11)
    chunks = [(f"c{d}-{i}", d, a, a + r.randint(1, 25)) for d in range(6) for i, a in enumerate(r.sample(range(60), 9))]
    spans = [(k, r.randrange(6), a, a + r.randint(0, 30)) for k, a in enumerate(r.randrange(70) for _ in range(120))]
    want = {}
    for k, d, a, b in spans:
        own = [(c, x, y) for c, e, x, y in chunks if e == d and x < b and y > a]
        if b <= a or not own:
            continue
        whole = [(y - x, x, c) for c, x, y in own if x <= a and y >= b]
        if whole:
            want[k] = [min(whole)[2]]
            continue
        parts, at, ids = sorted((c, max(a, x), min(b, y)) for c, x, y in own), a, []
        while at < b and (fits := [p for p in parts if p[1] <= at < p[2]]):
            best = max(fits, key=lambda p: (p[2], -p[1]))
            ids.append(best[0])
            at = best[2]
        want[k] = ids if at >= b else [p[0] for p in parts]
    s = spark.createDataFrame([*spans, (999, None, 1, 2)], "span_id int, doc_id int, s_start int, s_end int")
    got = {}
    for x in sorted(grounding.minimal_cover(s, spark.createDataFrame(chunks, "chunk_id string, doc_id int, c_start int, c_end int")).collect()):
        got.setdefault(x.span_id, []).append(x.chunk_id)
    assert got == want and any(len(v) > 1 for v in want.values())


def test_hashed_vectors(spark):
    places, weights = hashed.sparse_of("a a b")
    assert len(places) == 2 and places == sorted(places) and sum(w * w for w in weights) == pytest.approx(1)
    assert max(weights) / min(weights) == pytest.approx(1 + math.log(2)) and hashed.sparse_of("") == ([], [])
    assert not hashed.dense_of("").any() and abs(hashed.dense_of("abc def") @ hashed.dense_of("abc def") - 1) < 1e-12
    d = spark.createDataFrame([("ab cd", "cd ef"), (None, "x"), ("", "y")], "a string, b string")
    v = d.select(hashed.sparse_vector(F.col("a")).alias("x"), hashed.sparse_vector(F.col("b")).alias("y"), hashed.dense_vector(F.col("a"), 16).alias("v"))
    out = v.select(hashed.sparse_dot(F.col("x"), F.col("y")).alias("s"), "v").collect()
    assert out[0].s == pytest.approx(0.5) and out[1].s == out[2].s == 0.0 and out[1].v is None and len(out[2].v) == 16


def test_gold_coverage_and_redundancy(spark):
    rows = [(1, ["a paragraph of gold"], ["before", "a paragraph\n of gold", None]), (2, ["short"], ["short"]), (3, ["half of it is here, half not at all"], ["half of it is here"]), (4, None, ["x"]), (5, ["long enough gold text"], [])]
    got = {x.id: x.coverage for x in grounding.gold_coverage(spark.createDataFrame(rows, "id int, g array<string>, t array<string>"), "id", "g", "t").collect()}
    assert got[1] == 1.0 and got[2] is got[4] is got[5] is None and 0.5 <= got[3] < 0.7
    ranked = [(1, i, r, s, g, 2, 50) for i, r, s, g in (("a", 1, ["x", "y"], False), ("b", 2, ["x", "y"], False), ("c", 3, ["z"], False), ("d", 4, ["x", "y"], False), ("g", 5, ["q"], True))]
    out = grounding.redundant_above(spark.createDataFrame(ranked, "query_id int, item_id string, rank int, shingles array<string>, is_gold boolean, top_k int, window int")).collect()
    assert [tuple(x) for x in out] == [(1, "g", 5, 2, 3)]


def test_dense_queries_in_parts(spark, monkeypatch):
    r = random.Random(6)
    i = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(50)] + [(99, None)], "item_id int, embedding array<double>")
    q = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(20)] + [(77, None)], "query_id int, embedding array<double>")
    want = sorted(map(tuple, retrieval.dense_top(q, i, 3).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 6)
    assert sorted(map(tuple, retrieval.dense_top(q, i, 3).collect())) == want and len(want) == 60
    assert retrieval.dense_top(q.limit(0), i, 3).count() == 0


def test_measured_values_drive_out_guesses(spark):
    f = spark.createDataFrame([("1", "retrieval_missing_gold", "A", True), ("2", "chunking_overchunking", "A", False), ("2", "corpus_gap", "D", True)], "probe_id string, label string, grp string, confirmed boolean")
    a = optimize.actions(optimize.supports(f))
    v = spark.createDataFrame([("chunk_size", "retrieval_missing_gold", 1, "900"), ("chunk_size", "retrieval_missing_gold", 2, "700")], "path string, label string, place int, value string")
    got = {x.action: (x["values"], x.grounded) for x in optimize.grounded(a, v).collect()}
    assert got["increase_chunk_size"] == (["900", "700"], 1) and got["increase_top_k"] == (["increase"], 0) and "locate_missing_evidence" not in got
    assert {x.probe_id: x.mode for x in optimize.split(f, ["probe_id"]).collect()} == {"1": "apply", "2": "manual"}
    values = spark.createDataFrame([("a", "b1", "7", "e7"), ("a", "b1", "9", "e9"), ("a", "b2", "7", "e0")], "action string, baseline string, value string, effective string")
    attempts, still = spark.createDataFrame([("a", "b1", "7")], "action string, baseline string, value string"), spark.createDataFrame([("e0",)], "effective string")
    assert [x.value for x in optimize.untried(values, attempts, still).collect()] == ["9"]


def test_spans_misses_and_basis(spark):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("exact").alias("quality")), F.struct(F.lit(3).alias("start"), F.lit(4).alias("end"), F.lit("chunk_fallback").alias("quality")))
    assert [x.start for x in one(spark, grounding.exact_spans(spans))] == [0] and [x.end for x in one(spark, grounding.aliases(spans, F.lit("abc")))] == [5]
    assert one(spark, grounding.missed(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == ["a"]
    none = F.lit(None).cast("double")
    assert tuple(one(spark, grounding.recall_basis(none, F.lit(0.5)))) == (0.5, "chunk") and tuple(one(spark, grounding.recall_basis(F.lit(0.0), F.lit(0.5)))) == (0.0, "span")
    assert one(spark, optimize.eligibility({"capable": F.lit(False), "mappable": F.lit(False), "in_catalog": F.lit(None).cast("boolean")})) == "mappable"
    assert one(spark, optimize.even_places(F.lit(0), 3)) is None and one(spark, optimize.even_places(F.lit(2), 3)) == [0, 1] and one(spark, optimize.even_places(F.lit(10), 3)) == [0, 4, 9]


def test_search_is_the_path_of_its_steps(spark, monkeypatch):
    r, words = random.Random(11), ["사과", "풋사과를", "사과3", "apple", "pineapple", "pear", "3/4", "13/4", "7", "plum"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    vector = lambda: r.choice([None, []]) if r.random() < 0.03 else [float(r.randint(-2, 2)) for _ in range(6)]
    q = spark.createDataFrame([(i, said(r.randint(1, 9)), [0.0] * 6 if i == 3 else vector()) for i in range(80)] + [(98, "?!", None), (99, "apple", None)], "query_id bigint, question string, embedding array<double>")
    c = spark.createDataFrame([(f"c{i:03}", said(r.randint(0, 12)), vector()) for i in range(300)] + [("same", "apple apple", [1.0] * 6), ("also", "apple pear", [2.0] * 6)], "chunk_id string, chunk_text string, embedding array<double>").repartition(3)
    items = c.select(F.col("chunk_id").alias("item_id"), "embedding")
    both = retrieval.fuse(retrieval.dense_top(q, items, 20), retrieval.keyword_top(q, c, 20).withColumnRenamed("chunk_id", "item_id"), 0.5, 40)
    want = sorted((x.query_id, x.place, x.item_id, "mmr" if x.applied else "kept") for x in retrieval.mmr(both.join(items, "item_id"), 0.7, 5).collect())
    got = retrieval.search(q, c, 5, mmr_weight=0.7)
    assert sorted((x.query_id, x.rank, x.item_id, x.status) for x in got.collect()) == want
    assert {s for *_, s in want} == {"mmr", "kept"}
    assert retrieval.search(q.limit(0), c, 5, mmr_weight=0.7).count() == retrieval.search(q, c.limit(0), 5, mmr_weight=0.7).count() == 0
    asked = [x.asDict() for x in q.sort("query_id").collect()]
    import numpy as np
    import pyarrow as pa

    # Small blocks, in one process.
    monkeypatch.setattr(joint, "BLOCK", 7)
    tokens = {x.query_id: x.t for x in q.select("query_id", T.tokens(F.col("question")).alias("t")).collect()}
    count = [{t: tokens[x["query_id"]].count(t) for t in tokens[x["query_id"]]} for x in asked]
    table = pa.table({"query_id": [x["query_id"] for x in asked], "terms": pa.array([list(n) for n in count], pa.list_(pa.string())), "counts": pa.array([list(n.values()) for n in count], pa.list_(pa.int32()))})
    vectors, has = joint.matrix(pa.array([x["embedding"] for x in asked], pa.list_(pa.float64())))
    rows = c.select("chunk_id", T.tokens(F.col("chunk_text")).alias("tokens"), "embedding").sort("chunk_id").toArrow().to_batches(max_chunksize=5)
    out = joint.answers(iter(rows), lexical.Terms(table, retrieval.WHOLE), vectors, has, 5, 20, 40, 0.5, 0.7)
    assert sorted((x["query_id"], x["rank"], x["item_id"], x["status"]) for b in out for x in b.to_pylist()) == want
    x = np.random.default_rng(1).normal(size=(5000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = joint.Nearest(x[:90], 20)
    for a in range(0, 5000, 1700):
        near.take(x[a : a + 1700], a)
    assert (near.place == np.argsort(-np.round(x[:90] @ x.T, 12), axis=1, kind="stable")[:, :20]).all()
