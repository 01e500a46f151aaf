"""Failure labels of evaluation records: predicates as columns, labels as an ordered decision per slot.

A record is a row of measured signals; null means not measured and is kept
apart from false. Every label is a pair of conditions (applies, confirmed);
a slot takes the first confirmed label in its order, else the first that
applies. No joins, no shuffles: a record's labels come from its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds.
PASS, EXACT, FAITHFUL, PRECISE, RELEVANT = 0.5, 1.0, 0.7, 0.7, 0.7
DENSE, SEMANTIC_WEIGHT, COVERED, SEMANTIC_FLOOR, NEAR_MISS = 0.2, 0.6, 0.8, 0.3, 0.5
LONG_CONTEXT, MIDDLE = 6000, (0.25, 0.75)
MULTI_HOP = ["bridge", "comparison", "aggregation"]
CRITICAL = ["retrieval_semantic_mismatch", "retrieval_missing_gold", "generation_hallucination", "generation_abstention_failure", "generation_contradiction", "corpus_gap"]
GROUP_ORDER = {"D": 0, "A": 1, "C": 2, "B": 3}

#: The columns of a record that labels read; absent ones count as not measured.
RECORD = {
    "probe_id": "string", "qtype": "string", "answer_exists": "boolean", "has_truth": "boolean", "recall_at_k": "double", "top_k": "int", "n_spans": "int", "n_gold": "int", "missed": "int",
    "f1": "double", "oracle_f1": "double", "oracle_answered": "boolean", "answer_blank": "boolean", "marked_abstention": "boolean", "judged_abstention": "boolean",
    "faithfulness": "double", "relevancy": "double", "context_precision": "double", "correctness": "double", "degraded": "boolean", "tp": "int", "fp": "int", "fn": "int",
    "oracle_faithfulness": "double", "oracle_relevancy": "double", "oracle_correctness": "double", "oracle_degraded": "boolean", "oracle_tp": "int", "oracle_fp": "int", "oracle_fn": "int", "oracle_mode": "string",
    "gold_in_corpus": "boolean", "gold_all_absent": "boolean", "missed_in_corpus": "boolean", "lexical_hits_gold": "boolean", "wide_hit": "boolean", "reranked": "boolean", "mmr": "boolean", "search_mode": "string",
    "fused_rank": "int", "dense_rank": "int", "lexical_rank": "int", "pre_rank": "int", "pre_visible": "boolean", "window": "int", "redundant": "int", "projected_rank": "int", "oversized": "int", "split_spans": "int",
    "density": "double", "context_chars": "int", "gold_position": "double", "promoted": "int",
}


def complete(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a record, null where it has none."""
    have = set(df.columns)
    return df.select(*(F.col(c).cast(t) if c in have else F.lit(None).cast(t).alias(c) for c, t in RECORD.items()))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _semantic(correctness: str, degraded: str, tp: str, fn: str, faith: str) -> Column:
    ac = F.when(_yes(F.col(degraded)), None).otherwise(F.col(correctness))
    coverage = F.when(F.col(tp) + F.col(fn) > 0, F.col(tp) / (F.col(tp) + F.col(fn)))
    return F.greatest(ac, F.when((coverage >= COVERED) & (F.col(faith) >= FAITHFUL), coverage))


def blend(lexical: Column, semantic: Column) -> Column:
    """Lexical and semantic axis in one score; the lexical alone where the semantic isn't measured."""
    lex, sem = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic))
    return F.when(semantic.isNull(), lex).otherwise((1 - SEMANTIC_WEIGHT) * lex + SEMANTIC_WEIGHT * sem)


def _answer_ok(lexical: str, semantic: Column, correctness: str, degraded: str, faith: str) -> Column:
    lex = F.coalesce(F.col(lexical), F.lit(0.0))
    excused = (lex >= EXACT) & _yes(F.col(faith) >= FAITHFUL)
    near_miss = _yes(F.col(degraded)) & ~excused & _yes(F.col(correctness) < NEAR_MISS)
    return F.when(near_miss, False).when(semantic.isNull(), lex >= PASS).when(semantic < SEMANTIC_FLOOR, False).otherwise(blend(lex, semantic) >= PASS)


def predicates(df: DataFrame) -> DataFrame:
    """Add the pre-conditions of the labels, each computed once."""
    c = F.col
    df = complete(df)
    df = df.withColumn("answer_semantic", _semantic("correctness", "degraded", "tp", "fn", "faithfulness")).withColumn("oracle_semantic", _semantic("oracle_correctness", "oracle_degraded", "oracle_tp", "oracle_fn", "oracle_faithfulness"))
    df = df.withColumns({
        "recall_ok": _yes(c("recall_at_k") >= 1), "answer_ok": _answer_ok("f1", c("answer_semantic"), "correctness", "degraded", "faithfulness"), "oracle_ok": _answer_ok("oracle_f1", c("oracle_semantic"), "oracle_correctness", "oracle_degraded", "oracle_faithfulness"),
        "abstained": F.when(_yes(c("answer_blank")), False).otherwise(F.coalesce("judged_abstention", "marked_abstention", F.lit(False))), "grounded": F.coalesce(c("faithfulness") >= FAITHFUL, F.lit(True)), "verified": _yes(c("faithfulness") >= FAITHFUL),
        "no_answer": _yes(~c("answer_exists")), "multi_hop": _yes(c("qtype").isin(MULTI_HOP)), "k": F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(5)), "any_missed": _yes(c("missed") > 0),
    })
    # Ranks of the missed gold against the cut.
    beyond = (c("top_k") > 0) & c("any_missed") & (c("fused_rank") > c("top_k"))
    rerank_seen = _yes(c("reranked")) & _yes(c("pre_visible"))
    df = df.withColumns({"beyond": _yes(beyond), "rankable": _yes(beyond & (c("fused_rank") <= F.coalesce("window", F.lit(100)))), "rerank_seen": rerank_seen, "cut_by_rerank": rerank_seen & ~_yes(c("mmr"))})
    df = df.withColumns({
        "rerank_lost": c("cut_by_rerank") & c("any_missed") & _yes(c("pre_rank") <= c("top_k")), "not_lifted": c("cut_by_rerank") & c("any_missed") & _yes(c("pre_rank") > c("top_k")), "window_missed": c("rerank_seen") & c("rankable") & c("pre_rank").isNull(),
        "advantage": _yes(c("search_mode") == "hybrid") & c("beyond") & (_yes(c("dense_rank") <= c("top_k")) | _yes(c("lexical_rank") <= c("top_k"))), "crowded": _yes((c("redundant") > 0) & (c("projected_rank") <= c("top_k"))),
    })
    df = df.withColumn("rank_scope", c("rerank_lost") | c("not_lifted") | c("rankable") | c("advantage")).withColumn("upstream", c("advantage") | c("crowded"))
    expects = c("no_answer") | (_yes(c("gold_all_absent")) & ~c("answer_ok"))
    df = df.withColumn("expects_abstention", expects)
    df = df.withColumn("wrongful", c("recall_ok") & ~c("answer_ok") & ~c("expects_abstention") & _yes(c("marked_abstention")) & c("abstained"))
    span_pressure = (c("n_spans") >= 2) & (c("n_spans") >= F.floor(c("k") * 0.8))
    gold_pressure = (c("n_gold") >= 2) & (c("n_gold") >= F.floor(c("k") * 0.8))
    df = df.withColumns({
        "pressure": F.when(c("n_spans") > 0, span_pressure).when(_yes(gold_pressure), None).otherwise(False), "recoverable": F.coalesce("wide_hit", F.lit(True)), "context_failed": c("recall_ok") & c("oracle_ok") & ~c("answer_ok") & ~c("wrongful"),
        "generation_failed": (_yes(c("oracle_answered")) & ~c("oracle_ok")) | (c("no_answer") & ~c("abstained")) | c("wrongful"), "noise_heavy": _yes((c("density") < DENSE) & (c("context_precision") < PRECISE)),
        "gap": ~c("no_answer") & _yes(~c("gold_in_corpus")), "mode": F.when(_yes(c("oracle_faithfulness") >= FAITHFUL), F.when((c("oracle_mode") == "hop_binding") & ~c("multi_hop"), "misinterpretation").otherwise(c("oracle_mode"))),
        "hop_counts": c("multi_hop") & _yes((c("oracle_fn") == 0) & (c("oracle_fp") > 0)),
    })
    success = F.when(c("no_answer"), c("abstained")).when(~_yes(c("has_truth")), None).otherwise(c("recall_ok") & c("answer_ok") & c("grounded"))
    ungrounded = c("context_failed") & ~c("noise_heavy") & _yes(c("faithfulness") < FAITHFUL)
    middle = c("gold_position").between(*MIDDLE)
    return df.withColumns({"success": success, "ungrounded": ungrounded, "middle": middle})


MODES = {"contradiction": "generation_contradiction", "numerical_error": "generation_numerical_error", "misinterpretation": "generation_misinterpretation", "hop_binding": "generation_hop_binding_error", "chronological_error": "generation_chronological_error"}

Rule = tuple[str, Column, Column]


def _rules() -> dict[str, list[Rule]]:
    c, yes, no = F.col, F.lit(True), F.lit(False)
    oversized = _yes(c("oversized") > 0)
    chunk_scope = ~(c("recall_ok") & ~c("context_failed"))
    measured_gap = c("missed_in_corpus")
    not_bridge = ~_yes(c("qtype") == "bridge")
    over = ("chunking_overchunking", oversized & chunk_scope, yes)
    mismatch = ("chunking_context_mismatch", ~oversized & _yes(c("split_spans") > 0) & chunk_scope & ~(c("any_missed") & _yes(c("pressure")) & c("recoverable")), yes)
    retrieval: list[Rule] = [
        ("retrieval_incomplete_enumeration", c("any_missed") & _yes(c("top_k") > 0) & F.coalesce(c("pressure"), yes) & c("recoverable"), _yes(c("pressure")) & _yes(c("qtype") == "aggregation")),
        ("retrieval_missing_bridge_dependency", ~not_bridge & c("any_missed") & _yes((c("recall_at_k") >= 0) & (c("recall_at_k") < 1)), no),
        ("retrieval_rank_fusion_loss", c("advantage"), yes),
        ("retrieval_duplicate_crowding", ~c("advantage") & c("crowded"), yes),
        ("retrieval_rerank_candidate_miss", ~c("upstream") & c("window_missed"), yes),
        ("retrieval_reranker_ineffective", c("cut_by_rerank") & ~c("upstream") & ~c("window_missed") & c("not_lifted"), yes),
        ("retrieval_reranker_demotion", c("cut_by_rerank") & ~c("upstream") & ~c("window_missed") & c("rerank_lost"), yes),
        ("retrieval_low_rank", c("rankable") & ~c("upstream") & ~c("cut_by_rerank") & ~c("window_missed"), ~_yes(c("reranked"))),
        over,
        mismatch,
        ("retrieval_lexical_mismatch", _yes(c("lexical_hits_gold")) & ~c("rank_scope"), yes),
        ("retrieval_semantic_mismatch", not_bridge & ~c("rank_scope") & _yes(~c("lexical_hits_gold")) & F.coalesce(measured_gap, yes), _yes(measured_gap)),
        ("retrieval_missing_gold", not_bridge & c("any_missed") & F.coalesce(measured_gap, yes), _yes(measured_gap)),
        ("retrieval_failure", yes, no),
    ]
    reasoned = c("mode").isin(list(MODES))
    reasoning = [(label, _yes(c("mode") == mode), yes) for mode, label in MODES.items()]
    unmoded = c("mode").isNull() & _yes(c("oracle_faithfulness") >= FAITHFUL) & c("multi_hop")
    evidence = _yes(reasoned) | (c("mode").isNull() & c("hop_counts"))
    gold_wrong = _yes((c("oracle_faithfulness") >= FAITHFUL) & (c("oracle_relevancy") >= RELEVANT)) & ~evidence
    generation: list[Rule] = [
        ("generation_wrongful_abstention", c("wrongful"), yes),
        ("generation_abstention_failure", ~_yes(c("answer_blank")) & c("expects_abstention") & ~c("abstained"), yes),
        ("bad_gold_answer", ~c("oracle_ok") & gold_wrong, yes),
        *reasoning,
        ("generation_hop_binding_error", unmoded & (c("oracle_tp").isNull() | c("hop_counts")), c("oracle_tp").isNotNull()),
        ("generation_hallucination", _yes(c("oracle_faithfulness") < FAITHFUL), yes),
        ("generation_partial_answer", F.when(c("oracle_tp").isNotNull(), (c("oracle_fn") > 0) & (c("oracle_tp") > 0)).otherwise(_yes(c("oracle_relevancy") < RELEVANT)), c("oracle_tp").isNotNull()),
        ("generation_failure", yes, no),
    ]
    long_ = _yes(c("context_chars") >= LONG_CONTEXT)
    context: list[Rule] = [
        ("bad_gold_answer", ~c("oracle_ok") & _yes((c("faithfulness") >= FAITHFUL) & (c("relevancy") >= RELEVANT)), yes),
        over,
        mismatch,
        ("chunking_underchunking", c("context_failed") & c("noise_heavy"), yes),
        ("too_long_context", c("ungrounded") & long_ & _yes(~c("middle")), yes),
        ("lost_in_the_middle", c("ungrounded") & long_ & _yes(c("middle")), yes),
        ("context_noise_interference", c("context_failed") & ~c("noise_heavy") & c("verified"), yes),
        ("reranker_low_precision", c("context_failed") & _yes(c("reranked")) & ~c("noise_heavy") & _yes(c("context_precision") < PRECISE) & F.coalesce(c("promoted") > 0, yes), c("promoted").isNotNull()),
        ("context_failure", yes, no),
    ]
    return {"retrieval": retrieval, "generation": generation, "context": context}


_FOUND = "struct<label:string,confirmed:boolean>"


def _found(label: str, confirmed: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), confirmed.alias("confirmed"))


def _slot(rules: list[Rule]) -> Column:
    """The first confirmed label in order, else the first that applies."""
    hits = F.filter(F.array(*(F.when(a, _found(label, _yes(k))) for label, a, k in rules)), lambda x: x.isNotNull())
    sure = F.filter(hits, lambda x: x["confirmed"])
    return F.coalesce(F.get(sure, F.lit(0)), F.get(hits, F.lit(0)))


def group_of(label: Column) -> Column:
    """The group of a label: A retrieval, B generation, C context, D data."""
    return (
        F.when(label.isin("bad_gold_answer", "bad_gold_chunk", "corpus_gap", "corpus_gap_partial_hop"), "D")
        .when(label.startswith("chunking_") | label.startswith("reranker_") | label.startswith("retrieval_"), "A")
        .when(label.startswith("generation_"), "B")
        .otherwise("C")
    )


def diagnose(records: DataFrame) -> DataFrame:
    """(probe_id, ord, label, confirmed, grp, severity): the findings of every record, none for successes."""
    c = F.col
    p = predicates(records)
    rules = _rules()
    none = F.lit(None).cast(_FOUND)
    gold_wrong = _yes((c("oracle_faithfulness") >= FAITHFUL) & (c("oracle_relevancy") >= RELEVANT)) & ~(_yes(c("mode").isin(list(MODES))) | (c("mode").isNull() & c("hop_counts")))
    gold_error = ~c("gap") & ~c("oracle_ok") & gold_wrong
    mislabel = ~c("gap") & _yes(c("oracle_answered")) & ~c("oracle_ok") & c("answer_ok") & c("faithfulness").isNotNull()
    other_evidence = ~c("gap") & ~c("recall_ok") & c("answer_ok") & c("oracle_ok") & c("verified")
    short = _yes((c("recall_at_k") >= 0) & (c("recall_at_k") < 1))
    fixable = ~c("no_answer") & ~_yes(c("gold_all_absent"))
    many = F.array(
        F.when(mislabel & ~c("verified"), _found("bad_gold_chunk", F.lit(False))),
        F.when(short & ~mislabel & fixable, _slot(rules["retrieval"])),
        F.when(short & c("gap") & ~c("multi_hop"), _found("corpus_gap", F.lit(True))),
        F.when(short & c("gap") & c("multi_hop"), _found("corpus_gap_partial_hop", F.lit(True))),
        F.when(c("generation_failed"), _slot(rules["generation"])),
        F.when(c("context_failed"), _slot(rules["context"])),
        F.when(~c("no_answer") & _yes(c("has_truth")) & c("recall_ok") & c("answer_ok") & ~c("grounded"), _found("generation_parametric_overreliance", F.lit(True))),
        F.when(~_yes(c("answer_blank")) & c("expects_abstention") & ~c("abstained"), _found("generation_abstention_failure", F.lit(True))),
    )
    found = (
        F.when(F.coalesce(c("success"), F.lit(True)), F.array().cast(f"array<{_FOUND}>"))
        .when(gold_error, F.array(_found("bad_gold_answer", F.lit(True))))
        .when(mislabel & c("verified"), F.array(_found("bad_gold_chunk", F.lit(True))))
        .when(other_evidence, F.array().cast(f"array<{_FOUND}>"))
        .otherwise(F.filter(many, lambda x: x.isNotNull()))
    )
    del none
    out = p.select("probe_id", found.alias("_f"))
    # The first finding of a label stays.
    out = out.select("probe_id", F.posexplode(F.filter("_f", lambda x, i: F.array_position(F.transform("_f", lambda y: y["label"]), x["label"]) == i + 1)).alias("_i", "_x"))
    label = F.col("_x.label")
    out = out.select("probe_id", "_i", label.alias("label"), F.col("_x.confirmed").alias("confirmed"), group_of(label).alias("grp"), F.when(label.isin(CRITICAL), "critical").otherwise("warning").alias("severity"))
    place = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("grp"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("g"), F.when(F.col("severity") == "critical", 0).otherwise(1).alias("s"), "_i", "label", "confirmed", "grp", "severity")))
    return out.groupBy("probe_id").agg(ordered.alias("_o")).select("probe_id", F.posexplode("_o").alias("ord", "_x")).select("probe_id", "ord", "_x.label", "_x.confirmed", "_x.grp", "_x.severity")


#: Thresholds of the labels of foreign logs. Fixed values.
EXT_FAITH, EXT_RELEVANT, EXT_CORRECT, EXT_PRECISE, EXT_OVERLAP = 0.5, 0.5, 0.5, 0.34, 0.6


def replay(records: DataFrame) -> DataFrame:
    """(log_id, label, confirmed) of rows of a foreign log.

    Reads abstains, f1, overlap (with gold contexts), context_precision,
    faithfulness, relevancy, correctness, context_chars; null where not measured.
    """
    c = F.col
    overlap_ok, precise = c("overlap") >= EXT_OVERLAP, c("context_precision") >= EXT_PRECISE
    measured = c("overlap").isNotNull() | c("context_precision").isNotNull()
    # Whether evidence arrived trusts the overlap; the quality of the search trusts the worse of both.
    reached = F.coalesce(overlap_ok, precise)
    failed = measured & (_yes(~overlap_ok) | _yes(~precise))
    right = _yes(c("correctness") >= EXT_CORRECT) | _yes(c("f1") >= PASS)
    low_faith, answers = _yes(c("faithfulness") < EXT_FAITH), F.coalesce(c("relevancy") >= EXT_RELEVANT, F.lit(True))
    silent = F.when(right | ~measured, F.array().cast(f"array<{_FOUND}>")).when(reached, F.array(_found("ext_wrongful_abstention", F.lit(True)))).otherwise(F.array(_found("ext_retrieval_starved_abstention", F.lit(True))))
    spoken = F.array(
        F.when(failed, _found("ext_retrieval_irrelevant", F.lit(True))),
        F.when(_yes(c("relevancy") < EXT_RELEVANT), _found("ext_answer_off_topic", ~failed)),
        F.when(low_faith & answers, _found("ext_generation_hallucination", _yes(overlap_ok))),
        F.when(low_faith & _yes(c("context_chars") > LONG_CONTEXT), _found("ext_context_overflow", F.lit(True))),
        F.when(_yes(c("correctness") < EXT_CORRECT) & _yes(c("faithfulness") >= EXT_FAITH) & answers, _found("ext_grounded_but_wrong", ~failed)),
    )
    found = F.when(c("abstains"), silent).otherwise(F.filter(spoken, lambda x: x.isNotNull()))
    return records.select("log_id", F.explode(found).alias("x")).select("log_id", "x.label", "x.confirmed")
