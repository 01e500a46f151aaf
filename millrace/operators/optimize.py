"""Decisions over findings: candidate values, action ranking, conflicts, judgement of trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Fixed values.
#: Floors of metrics, least composite of the gate, and its least recall.
GATE_SCORE, GATE_RECALL, MIN_DELTA = 90, 0.6, 0.02
FLOORS = {"faithfulness": 0.5, "answer_relevancy": 0.5, "context_recall": 0.45, "context_precision": 0.45, "context_utilization": 0.4}
#: A metric that must stay under its bound.
CEILINGS = {"noise_sensitivity": 0.6}
MARGIN, MARGIN_PROBES = 0.2, 2
TIER = {"A": 0, "C": 1, "B": 2, "D": 3}
#: Fixed values. Labels: (group, status, target metric, prescriptions in order), a prescription being (action, path, value, re-indexes, executable, topics it is for).
INC, DEC, UP = "increase", "decrease", "upgrade"
NO_TOPIC, TOPIC = ("none",), ("spread", "concentrated")
RULES = {
    "retrieval_low_rank": ("A", "ready", "context_precision", [("enable_reranker", "reranker.enabled", "true", False, True, ())]),
    "retrieval_rank_fusion_loss": ("A", "ready", "context_recall", [("rebalance_hybrid_weight", "retriever.hybrid_dense_weight", "shift_to_favored_channel", False, True, ()), ("enable_reranker", "reranker.enabled", "true", False, True, ())]),
    "retrieval_duplicate_crowding": ("A", "ready", "context_recall", [("enable_mmr", "retriever.mmr", "true", False, True, ())]),
    "retrieval_rerank_candidate_miss": ("A", "ready", "context_recall", [("widen_rerank_candidates", "reranker.candidate_count", INC, False, True, ())]),
    "retrieval_reranker_demotion": ("A", "ready", "context_recall", [("disable_reranker", "reranker.enabled", "false", False, True, ()), ("swap_reranker_model", "reranker_model", UP, False, False, ())]),
    "retrieval_reranker_ineffective": ("A", "draft", "context_recall", [("swap_reranker_model", "reranker_model", UP, False, True, ())]),
    "retrieval_lexical_mismatch": ("A", "ready", "context_recall", [("enable_hybrid", "retriever.search_type", "hybrid", False, True, ())]),
    "retrieval_semantic_mismatch": ("A", "ready", "context_recall", [("swap_embedding_model", "embedding_model", "sentence-transformers/all-MiniLM-L6-v2", True, True, TOPIC), ("shrink_chunk_size", "chunk_size", DEC, True, True, NO_TOPIC), ("switch_to_recursive_sentence", "chunker.strategy", "recursive_sentence", True, True, NO_TOPIC), ("switch_to_markdown_recursive", "chunker.strategy", "markdown_recursive", True, True, NO_TOPIC)]),
    "retrieval_missing_gold": ("A", "ready", "context_recall", [("increase_top_k", "top_k", INC, False, True, ()), ("increase_chunk_overlap", "chunk_overlap", INC, True, True, ()), ("increase_chunk_size", "chunk_size", INC, True, True, ()), ("expand_query", "query_rewrite", "expand", False, False, ())]),
    "retrieval_incomplete_enumeration": ("A", "ready", "context_recall", [("dynamic_top_k", "top_k", INC, False, True, ()), ("enable_mmr", "retriever.mmr", "true", False, True, ()), ("enable_adaptive_retrieval", "adaptive_retrieval", "true", False, False, ())]),
    "retrieval_missing_bridge_dependency": ("A", "draft", "context_recall", [("enable_query_decomposition", "query_rewrite", "decompose", False, True, ()), ("enable_query_decomposition", "max_hops", INC, False, True, ()), ("enable_query_decomposition", "sub_query_generator_prompt", "bridge_entity_aware", False, True, ()), ("expand_bridge_entity_query", "bridge_entity_expansion", "true", False, True, ())]),
    "chunking_context_mismatch": ("A", "ready", "context_recall", [("increase_chunk_overlap", "chunk_overlap", INC, True, True, ()), ("increase_chunk_size", "chunk_size", INC, True, True, ()), ("switch_to_recursive_sentence", "chunker.strategy", "recursive_sentence", True, True, ()), ("switch_to_markdown_recursive", "chunker.strategy", "markdown_recursive", True, True, ())]),
    "chunking_overchunking": ("A", "ready", "context_recall", [("increase_chunk_size", "chunk_size", INC, True, True, ())]),
    "chunking_underchunking": ("A", "ready", "context_precision", [("decrease_chunk_size", "chunk_size", DEC, True, True, ())]),
    "reranker_low_precision": ("A", "draft", "context_precision", [("swap_reranker_model", "reranker_model", UP, False, True, ()), ("tighten_reranker_threshold", "reranker_threshold", INC, False, True, ())]),
    "generation_hallucination": ("B", "ready", "faithfulness", [("lower_temperature", "generation.temperature", DEC, False, True, ()), ("strengthen_abstention", "generation.abstention_strict", "true", False, True, ()), ("require_citation", "generation.require_citation", "true", False, True, ()), ("upgrade_generation_model", "generation.model", UP, False, True, ())]),
    "generation_partial_answer": ("B", "ready", "answer_relevancy", [("completeness_prompt", "generation.completeness_mode", "true", False, True, ()), ("checklist_review_step", "answer_checklist_review", "true", False, False, ())]),
    "generation_contradiction": ("B", "draft", "faithfulness", [("llm_verification_pass", "verifier_on", "true", False, True, ()), ("llm_verification_pass", "verifier_type", "faithfulness", False, True, ())]),
    "generation_misinterpretation": ("B", "ready", "answer_relevancy", [("restate_question", "generation.restate_question", "true", False, True, ())]),
    "generation_abstention_failure": ("B", "ready", "faithfulness", [("strengthen_abstention", "generation.abstention_strict", "true", False, True, ()), ("require_citation", "generation.require_citation", "true", False, True, ())]),
    "generation_wrongful_abstention": ("B", "ready", "answer_relevancy", [("relax_abstention", "generation.abstention_relaxed", "true", False, True, ())]),
    "generation_parametric_overreliance": ("B", "ready", "faithfulness", [("strengthen_abstention", "generation.abstention_strict", "true", False, True, ()), ("require_citation", "generation.require_citation", "true", False, True, ()), ("lower_temperature", "generation.temperature", DEC, False, True, ())]),
    "generation_numerical_error": ("B", "draft", "faithfulness", [("require_numeric_citation", "numeric_citation_required", "true", False, True, ()), ("enable_calculation_check", "calculation_check", "true", False, True, ())]),
    "generation_chronological_error": ("B", "draft", "answer_relevancy", [("enable_chronology_check", "chronology_check", "true", False, True, ())]),
    "generation_hop_binding_error": ("B", "draft", "answer_relevancy", [("force_hop_evidence_binding", "answer_format", "cot_chained", False, True, ()), ("force_hop_evidence_binding", "require_hop_citation", "true", False, True, ()), ("enable_bridge_entity_verifier", "bridge_entity_verifier", "true", False, True, ())]),
    "too_long_context": ("C", "ready", "noise_sensitivity", [("decrease_top_k", "top_k", DEC, False, True, ()), ("context_compression", "context_compression", "true", False, True, ()), ("shrink_chunk_size", "chunk_size", DEC, True, True, ())]),
    "lost_in_the_middle": ("C", "ready", "context_utilization", [("decrease_top_k", "top_k", DEC, False, True, ()), ("reorder_context_edges", "context_ordering", "most_relevant_edges", False, False, ())]),
    "context_noise_interference": ("C", "ready", "noise_sensitivity", [("context_compression", "context.compression.enabled", "true", False, True, ()), ("enable_mmr", "retriever.mmr", "true", False, True, ()), ("enable_noise_filter", "noise_filter", "true", False, False, ()), ("strict_conflict_prompt", "conflict_resolution_prompt", "prefer_high_confidence_evidence", False, False, ())]),
    "corpus_gap": ("D", "manual", None, [("locate_missing_evidence", None, None, False, False, ()), ("collect_and_reindex", None, None, False, False, ())]),
    "corpus_gap_partial_hop": ("D", "manual", None, [("locate_missing_hop", None, None, False, False, ()), ("collect_bridge_docs", None, None, False, False, ())]),
    "bad_gold_answer": ("D", "manual", None, [("regenerate_probe", None, None, False, False, ())]),
    "bad_gold_chunk": ("D", "manual", None, [("relabel_gold_chunk", None, None, False, False, ())]),
}
#: A signal of a finding that says that it could not be measured.
UNMEASURED = "unmeasured"
PRESCRIPTION = "label string, grp string, status string, metric string, ord int, action string, path string, value string, reindex boolean, ready boolean, topics array<string>"


def prescription_rows() -> list[tuple]:
    """The rules as rows: a row per label and patched path, manual steps without a path."""
    return [(label, g, status, metric, n, *p[:5], list(p[5])) for label, (g, status, metric, all_) in RULES.items() for n, p in enumerate(all_, 1)]


def prescriptions(df: DataFrame) -> DataFrame:
    """The prescription table as a DataFrame of ``df``'s session; a fixed table of a few dozen rows."""
    return F.broadcast(df.sparkSession.createDataFrame(prescription_rows(), PRESCRIPTION))


def applicable(findings: DataFrame, consume: bool = False) -> DataFrame:
    """The executable prescriptions of the ready labels that ``findings`` has, a row per patch.

    If ``consume``, those for other topics than the label's ``topic_cluster``
    (its first measured one) leave, unless that leaves the label none: a signal
    prefers prescriptions and blocks no label. Not measured means that all are for it.
    """
    p = prescriptions(findings).filter("status = 'ready' and ready")
    if not consume:
        return p.join(F.broadcast(findings.select("label").distinct()), "label", "left_semi")  # at most one row a label
    measured = F.when(F.col("topic_cluster") != UNMEASURED, F.col("topic_cluster"))
    signal = findings.groupBy("label").agg(F.min(F.struct("probe_id", measured.alias("t"))).alias("_any"), F.min(F.when(measured.isNotNull(), F.struct("probe_id", measured.alias("t"))))["t"].alias("signal"))
    p = p.join(F.broadcast(signal.select("label", "signal")), "label")
    fits = (F.size("topics") == 0) | F.col("signal").isNull() | F.array_contains("topics", F.col("signal"))
    p = p.withColumn("_fits", fits).withColumn("_some", F.bool_or("_fits").over(W.Window.partitionBy("label")))
    return p.filter("_fits or not _some").drop("_fits", "_some", "signal")


def supports(findings: DataFrame, consume: bool = False) -> DataFrame:
    """(action, path, value, reindex, label, grp, metric, probe_id, confidence): what each finding speaks for."""
    f = findings.select("probe_id", "label", F.when(F.col("confirmed"), 1.0).otherwise(0.5).alias("confidence"))
    return f.join(F.broadcast(applicable(findings, consume)), "label").select("action", "path", "value", "reindex", "label", "grp", "metric", "probe_id", "confidence")


def actions(found: DataFrame) -> DataFrame:
    """Per action its labels, probes, metrics and score: over distinct probes the best confidence, by cost (3 where it re-indexes, else 1).

    Probes are counted per action first, so no action's probes meet in a list;
    labels and metrics are a few dozen.
    """
    per = found.groupBy("action", "path", "value", "reindex", "probe_id").agg(F.max("confidence").alias("c"), F.min(_tier(F.col("grp"))).alias("tier"))
    labels = found.groupBy("action", "path", "value").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("metric")).alias("metrics"))
    out = per.groupBy("action", "path", "value", "reindex").agg(F.count("*").alias("probes"), F.sum("c").alias("support"), F.min("tier").alias("tier"))
    cost = F.when(F.col("reindex"), 3).otherwise(1)
    return out.join(labels, ["action", "path", "value"]).withColumn("cost", cost).withColumn("score", F.col("support") / cost).withColumn("grounded", F.lit(0))


def grounded(acts: DataFrame, values: DataFrame) -> DataFrame:
    """``acts`` (a row per action, not per value) with the values to try: measured ones (path, label, place, value) in the order of labels and places, else the rule's own.

    A measured value drives out guesses. ``grounded`` counts the labels of an
    action that have one; ``provenance`` names the labels of each value.
    """
    v = acts.select("action", "path", F.explode("labels").alias("label")).join(values, ["path", "label"])
    each = v.groupBy("action", "path", values["value"]).agg(F.min(F.struct("label", "place")).alias("_o"), F.array_sort(F.collect_set("label")).alias("by"))
    tried = each.groupBy("action", "path").agg(F.array_sort(F.collect_list(F.struct("_o", "value", "by"))).alias("_v"))
    n = v.groupBy("action", "path").agg(F.count_distinct("label").alias("_n"))
    out = acts.drop("grounded").join(tried, ["action", "path"], "left").join(n, ["action", "path"], "left")
    rule = F.array(F.col("value"))
    return out.withColumn("values", F.coalesce(F.col("_v")["value"], rule)).withColumn("provenance", F.coalesce(F.transform("_v", lambda x: F.struct(x["value"].alias("value"), x["by"].alias("labels"))), F.transform(rule, lambda x: F.struct(x.alias("value"), F.col("labels").alias("labels"))))).withColumn("grounded", F.coalesce("_n", F.lit(0))).drop("_v", "_n")


def opposition(acts: DataFrame) -> DataFrame:
    """(action, path, value, opposed_by): the other actions on an action's path."""
    a = acts.select("action", "path", "value")
    b = acts.select(F.col("action").alias("_a"), "path", F.col("value").alias("_v"))
    pairs = a.join(b, "path").filter("action <> _a or value <> _v")
    return pairs.groupBy("action", "path", "value").agg(F.array_sort(F.collect_set(F.concat_ws("=", "_a", "_v"))).alias("opposed_by"))


def keep_guard(acts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``acts`` with ``reason``: keep_protected_axis where undoing a kept change has no more support than (action, required) asks; a tie keeps."""
    out = acts.join(F.broadcast(thresholds.select("action", "required")), "action", "left")  # one row a kept action
    return out.withColumn("reason", F.when(F.col("required").isNotNull() & (F.col("support") <= F.col("required")), "keep_protected_axis")).drop("required")


def untried(values: DataFrame, attempts: DataFrame, no_progress: DataFrame) -> DataFrame:
    """Candidate values (action, baseline, value, effective) without those that failed from this very baseline (attempts: action, baseline, value) or lead to a configuration (effective) measured without progress."""
    return values.join(attempts, ["action", "baseline", "value"], "left_anti").join(no_progress.select("effective"), "effective", "left_anti")


def split(findings: DataFrame, per: list[str]) -> DataFrame:
    """(*per, mode, actionable, manual): manual if a confirmed finding has no executable rule by nature, else apply if a rule is ready for a confirmed one, else skipped."""
    status = F.broadcast(prescriptions(findings).select("label", "status").distinct())  # one row a label
    f = findings.join(status, "label")
    manual, ready = F.col("status") == "manual", (F.col("status") == "ready") & F.col("confirmed")
    mode = F.when(F.bool_or(manual & F.col("confirmed")), "manual").when(F.bool_or(ready), "apply").otherwise("skipped")
    return f.groupBy(*per).agg(mode.alias("mode"), F.count_if(ready).alias("actionable"), F.count_if(manual).alias("manual"))


#: The checks of an action in order; the first that fails is its reason.
CHECKS = ["in_catalog", "mappable", "backend_supports", "capable", "available", "prerequisite_met", "has_candidates"]


def eligibility(checks: dict[str, Column]) -> Column:
    """The first failing check of an action by name, null if it is eligible; a check that isn't known passes."""
    return F.coalesce(*(F.when(~F.coalesce(checks[c], F.lit(True)), c) for c in CHECKS if c in checks), F.lit(None).cast("string"))


def _tier(group: Column) -> Column:
    return reduce(lambda c, kv: c.when(group == kv[0], kv[1]), TIER.items(), F.when(F.lit(False), 9)).otherwise(9)


def choose(ranked: DataFrame) -> DataFrame:
    """Each path's winner, or ``deferred`` where the runner-up is too near, ranked by tier, score, measured values, cost and name.

    Actions of one path oppose each other. A better tier wins, then a measured
    value; else the best must lead by 20 % of its score and by two probes.
    """
    w = W.Window.partitionBy("path").orderBy("tier", F.col("grounded") == 0, F.desc("score"), "action", "value")
    nxt = {c: F.lead(c).over(w) for c in ("score", "probes", "tier", "grounded")}
    r = ranked.withColumns({"_r": F.row_number().over(w), **{f"_{c}": x for c, x in nxt.items()}}).filter("_r = 1")
    alike = (F.col("_tier") == F.col("tier")) & ((F.col("_grounded") > 0) == (F.col("grounded") > 0))
    close = F.col("_score").isNotNull() & alike & ((F.col("score") <= 0) | (F.col("score") - F.col("_score") < MARGIN * F.col("score")) | (F.col("probes") - F.col("_probes") < MARGIN_PROBES))
    r = r.withColumn("state", F.when(close, "deferred").otherwise("eligible"))
    place = F.row_number().over(W.Window.orderBy(F.col("state") != "eligible", "tier", F.desc("score"), F.desc("grounded"), "cost", "action"))  # one row per path
    return r.withColumn("place", place).select("place", "action", "path", "value", "state", "tier", "score", "probes", "labels")


def gate(composite: Column, recall: Column, passed: Column) -> Column:
    """Whether a result may serve: a composite of 90 (else the evaluation's own verdict) and no recall under 0.6."""
    return F.coalesce(composite >= GATE_SCORE, passed, F.lit(False)) & F.coalesce(recall >= GATE_RECALL, F.lit(True))


def verdict(before: Column, after: Column, metrics: dict[str, Column]) -> Column:
    """Keep or roll back a trial: no metric of it beyond its floor, then an improvement of at least 0.02.

    Metrics that aren't measured break nothing; without both scores there is no judgement.
    """
    broken = F.lit(False)
    for name, now in metrics.items():
        bad = now < FLOORS[name] if name in FLOORS else now > CEILINGS[name] if name in CEILINGS else F.lit(False)
        broken = broken | F.coalesce(bad, F.lit(False))
    gain = after - before
    better = (gain > 0) & ((gain > MIN_DELTA) | (F.abs(gain - MIN_DELTA) <= 1e-12))
    return F.when(before.isNull() | after.isNull(), "unjudgeable").when(broken, "rollback").when(better, "keep").otherwise("rollback")


def apportion(weights: DataFrame, key: str, weight: str, total: int, order: str) -> DataFrame:
    """Whole shares of ``total`` by largest remainder, ties by ``order``: (key, share)."""
    everything = W.Window.partitionBy()
    w = weights.withColumn("_raw", F.col(weight) / F.sum(weight).over(everything) * total).withColumn("_floor", F.floor(F.round("_raw", 9)))
    left = F.lit(total) - F.sum("_floor").over(everything)
    place = F.row_number().over(W.Window.orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), order))
    return w.select(key, (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("bigint").alias("share"))


def knee(values: DataFrame, value: str, step: float = 2.0, most: int = 3) -> DataFrame:
    """The largest value reached without a jump beyond ``step`` per probe, and up to ``most`` next values.

    ``values`` has a row per probe with the value that it needs. Distinct
    values with cumulative counts are enough: the scan stops at the first gap
    that is larger than ``step`` for each probe gained.
    """
    d = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = W.Window.orderBy("v")  # one row per distinct value of a small setting
    d = d.withColumn("_gap", (F.col("v") - F.lag("v").over(w)) / F.col("n"))
    first = F.min(F.when(F.col("_gap") > step, F.col("v"))).over(W.Window.partitionBy())
    d = d.withColumn("_below", F.col("v") < F.coalesce(first, F.lit(2**62)))
    d = d.withColumn("_k", F.max(F.when(F.col("_below"), F.col("v"))).over(W.Window.partitionBy()))
    out = d.filter(F.col("v") >= F.col("_k")).withColumn("candidate_no", F.row_number().over(w)).filter(F.col("candidate_no") <= most)
    return out.select("candidate_no", F.col("v").alias("candidate"), (F.col("v") == F.col("_k")).alias("is_knee"))


def prescreen(docs: DataFrame, spans: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """Candidate (size, overlap) by gold spans that lie in one fixed chunk, then fewest characters, then size.

    Whether a span lies in some chunk of the closed form is arithmetic: the
    last chunk that starts at or before it must reach its end. No chunk is made.
    """
    cfg = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in configs))).alias("c")
    step = F.col("size") - F.col("overlap")
    last = lambda: F.ceil(F.greatest(F.lit(0), F.col("n") - F.col("size")) / step)
    s = spans.join(docs, "doc_id").select("*", cfg).select("*", "c.*")
    i = F.least(F.floor(F.col("s_start") / step), last())
    inside = F.least(i * step + F.col("size"), F.col("n")) >= F.col("s_end")
    contained = s.groupBy("size", "overlap").agg(F.count_if(inside).alias("contained"))
    d = docs.select("n", cfg).select("n", "c.*")
    chars = last() * F.col("size") + (F.col("n") - last() * step)
    t = d.groupBy("size", "overlap").agg(F.sum(F.when(last() == 0, F.least("n", "size")).otherwise(chars)).alias("chars"), F.sum(last() + 1).alias("chunks"), F.sum("n").alias("all"))
    out = contained.filter("contained > 0").join(t, ["size", "overlap"])
    place = F.row_number().over(W.Window.orderBy(F.desc("contained"), "chars", "size"))
    return out.select("size", "overlap", "contained", F.col("chunks").cast("bigint").alias("chunks"), F.round(F.col("chars") / F.col("all"), 6).alias("duplication"), place.alias("place"))


# Kinds of questions of a test set and their shares; a smaller set has the first kind only.
KINDS, LEAST_MIXED = {"synthesised": 0.75, "persona": 0.2, "no_answer": 0.05}, 8


def budget(n: Column) -> Column:
    """array of struct(kind, share): ``n`` cut by largest remainder, ties in the order of kinds."""
    raw = F.array(*(F.struct((F.floor(F.round(n * x, 9))).cast("bigint").alias("whole"), F.round(n * x - F.floor(F.round(n * x, 9)), 9).alias("rest"), F.lit(k).alias("kind"), F.lit(i).alias("i")) for i, (k, x) in enumerate(KINDS.items())))
    left = n - F.aggregate(raw, F.lit(0).cast("bigint"), lambda s, x: s + x["whole"])
    order = F.transform(F.array_sort(F.transform(raw, lambda x: F.struct((-x["rest"]).alias("r"), x["i"].alias("i")))), lambda x: x["i"])
    mixed = F.transform(raw, lambda x: F.struct(x["kind"].alias("kind"), (x["whole"] + F.when(F.array_position(order, x["i"]) <= left, 1).otherwise(0)).cast("bigint").alias("share")))
    only = F.transform(raw, lambda x: F.struct(x["kind"].alias("kind"), F.when(x["i"] == 0, n).otherwise(0).cast("bigint").alias("share")))
    return F.when(n < LEAST_MIXED, only).otherwise(mixed)


def even_places(n: Column, m: int) -> Column:
    """Array of ``m`` places from 0 to n - 1, spread evenly, halves to the even neighbour; all of fewer."""
    every = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(m)).cast("int") - 1), lambda i: i.cast("bigint"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / float(max(1, m - 1)), 0).cast("bigint"))
    return F.when(n <= m, F.when(n > 0, every)).otherwise(spread)


def config_diff(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(*keys, key, before, after): the entries that differ between two maps of a row; a missing entry is null."""
    names = F.explode(F.array_distinct(F.concat(F.map_keys(before), F.map_keys(after)))).alias("key")
    out = df.select(*keys, names, before, after).select(*keys, "key", F.try_element_at(F.col(before), F.col("key")).alias("before"), F.try_element_at(F.col(after), F.col("key")).alias("after"))
    return out.filter(~F.col("before").eqNullSafe(F.col("after")))
