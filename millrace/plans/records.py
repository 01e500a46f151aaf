"""Queries over evaluation records: findings, reports, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnose, optimize, report
from ..runtime import table
from .registry import query

#: Records of the tests: a row per log whose signals are arithmetic on its number, in words that Spark and DuckDB share.
RECORD = {
    "probe_id": "CAST(log_id AS VARCHAR(20))", "qtype": "CASE log_id % 6 WHEN 0 THEN 'bridge' WHEN 1 THEN 'aggregation' WHEN 2 THEN 'comparison' ELSE 'single' END", "answer_exists": "log_id % 19 <> 3", "has_truth": "log_id % 23 <> 5",
    "recall_at_k": "CASE WHEN log_id % 29 = 0 THEN -1.0 ELSE least(1.0, (log_id % 7) / 4.0) END", "top_k": "5", "n_spans": "log_id % 6", "n_gold": "log_id % 5", "missed": "CASE WHEN log_id % 29 = 0 OR (log_id % 7) >= 4 THEN 0 ELSE 1 + log_id % 3 END",
    "f1": "(log_id % 11) / 10.0", "oracle_f1": "(log_id % 13) / 12.0", "oracle_answered": "log_id % 9 <> 1", "answer_blank": "log_id % 31 = 4", "marked_abstention": "log_id % 8 = 2", "judged_abstention": "CASE log_id % 10 WHEN 1 THEN true WHEN 2 THEN false END",
    "faithfulness": "CASE WHEN log_id % 6 = 5 THEN NULL ELSE (log_id % 14) / 13.0 END", "relevancy": "CASE WHEN log_id % 7 = 6 THEN NULL ELSE (log_id % 15) / 14.0 END", "context_precision": "CASE WHEN log_id % 8 = 7 THEN NULL ELSE (log_id % 10) / 9.0 END",
    "correctness": "CASE WHEN log_id % 5 = 4 THEN NULL ELSE (log_id % 12) / 11.0 END", "degraded": "log_id % 17 = 2", "tp": "CASE WHEN log_id % 4 = 3 THEN NULL ELSE log_id % 5 END", "fp": "CASE WHEN log_id % 4 = 3 THEN NULL ELSE log_id % 3 END", "fn": "CASE WHEN log_id % 4 = 3 THEN NULL ELSE log_id % 2 END",
    "oracle_faithfulness": "CASE WHEN log_id % 7 = 1 THEN NULL ELSE (log_id % 16) / 15.0 END", "oracle_relevancy": "CASE WHEN log_id % 9 = 2 THEN NULL ELSE (log_id % 18) / 17.0 END", "oracle_correctness": "CASE WHEN log_id % 6 = 1 THEN NULL ELSE (log_id % 21) / 20.0 END", "oracle_degraded": "log_id % 26 = 3",
    "oracle_tp": "CASE WHEN log_id % 5 = 1 THEN NULL ELSE log_id % 4 END", "oracle_fp": "CASE WHEN log_id % 5 = 1 THEN NULL ELSE log_id % 3 END", "oracle_fn": "CASE WHEN log_id % 5 = 1 THEN NULL ELSE log_id % 2 END",
    "oracle_mode": "CASE log_id % 12 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'numerical_error' WHEN 2 THEN 'misinterpretation' WHEN 3 THEN 'hop_binding' WHEN 4 THEN 'chronological_error' END",
    "gold_in_corpus": "CASE log_id % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END", "gold_all_absent": "log_id % 39 = 0", "missed_in_corpus": "CASE log_id % 11 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END", "lexical_hits_gold": "CASE log_id % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "wide_hit": "CASE log_id % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END", "reranked": "log_id % 3 = 0", "mmr": "log_id % 21 = 0", "search_mode": "CASE WHEN log_id % 2 = 0 THEN 'hybrid' ELSE 'vector' END",
    "fused_rank": "CASE WHEN log_id % 4 = 2 THEN NULL ELSE 1 + log_id % 37 END", "dense_rank": "CASE WHEN log_id % 6 = 2 THEN NULL ELSE 1 + log_id % 33 END", "lexical_rank": "CASE WHEN log_id % 7 = 2 THEN NULL ELSE 1 + log_id % 41 END", "pre_rank": "CASE WHEN log_id % 5 = 2 THEN NULL ELSE 1 + log_id % 19 END",
    "pre_visible": "log_id % 9 <> 6", "window": "20", "redundant": "log_id % 3", "projected_rank": "1 + log_id % 17", "oversized": "CASE WHEN log_id % 15 = 0 THEN 1 ELSE 0 END", "split_spans": "CASE WHEN log_id % 10 = 3 THEN 1 ELSE 0 END",
    "density": "CASE WHEN log_id % 8 = 1 THEN NULL ELSE (log_id % 20) / 19.0 END", "context_chars": "(log_id % 24) * 500", "gold_position": "CASE WHEN log_id % 6 = 0 THEN NULL ELSE (log_id % 9) / 8.0 END", "promoted": "CASE WHEN log_id % 7 = 3 THEN NULL ELSE log_id % 3 END",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the tests."""
    ids = table(spark, sf_dir, "rag_logs").select("log_id").distinct()
    return ids.select(*(F.expr(v.replace("VARCHAR(20)", "STRING")).alias(k) for k, v in RECORD.items()))


_R = "r AS (SELECT " + ", ".join(f"{v} AS \"{k}\"" for k, v in RECORD.items()) + " FROM (SELECT DISTINCT log_id FROM rag_logs))"


def _ok(lex: str, sem: str, ac: str, deg: str, faith: str) -> str:
    return f"CASE WHEN coalesce({deg}, false) AND NOT ({lex} >= 1.0 AND coalesce({faith} >= 0.7, false)) AND coalesce({ac} < 0.5, false) THEN false WHEN {sem} IS NULL THEN {lex} >= 0.5 WHEN {sem} < 0.3 THEN false ELSE 0.4 * {lex} + 0.6 * least(1.0, {sem}) >= 0.5 END"


def _sem(ac: str, deg: str, tp: str, fn: str, faith: str) -> str:
    return f"greatest(CASE WHEN coalesce({deg}, false) THEN NULL ELSE {ac} END, CASE WHEN {tp} + {fn} > 0 AND {tp} / CAST({tp} + {fn} AS DOUBLE) >= 0.8 AND {faith} >= 0.7 THEN {tp} / CAST({tp} + {fn} AS DOUBLE) END)"


_P = f"""
{_R}, a AS (SELECT *, {_sem('correctness', 'degraded', 'tp', 'fn', 'faithfulness')} AS sem, {_sem('oracle_correctness', 'oracle_degraded', 'oracle_tp', 'oracle_fn', 'oracle_faithfulness')} AS osem FROM r),
b AS (SELECT *, recall_at_k >= 1 AS rok, {_ok('f1', 'sem', 'correctness', 'degraded', 'faithfulness')} AS aok, {_ok('oracle_f1', 'osem', 'oracle_correctness', 'oracle_degraded', 'oracle_faithfulness')} AS ook,
  CASE WHEN answer_blank THEN false ELSE coalesce(judged_abstention, marked_abstention) END AS abst, coalesce(faithfulness >= 0.7, true) AS gr, coalesce(faithfulness >= 0.7, false) AS ver, NOT answer_exists AS noans, qtype IN ('bridge', 'comparison', 'aggregation') AS hop, missed > 0 AS miss,
  coalesce(missed > 0 AND fused_rank > 5, false) AS beyond, coalesce(missed > 0 AND fused_rank > 5 AND fused_rank <= 20, false) AS rankable, reranked AND pre_visible AS seen, reranked AND pre_visible AND NOT mmr AS cut FROM a),
d AS (SELECT *, cut AND miss AND coalesce(pre_rank <= 5, false) AS lost, cut AND miss AND coalesce(pre_rank > 5, false) AS notlift, seen AND rankable AND pre_rank IS NULL AS winmiss, search_mode = 'hybrid' AND beyond AND (coalesce(dense_rank <= 5, false) OR coalesce(lexical_rank <= 5, false)) AS adv, coalesce(redundant > 0 AND projected_rank <= 5, false) AS crowd,
  noans OR (gold_all_absent AND NOT aok) AS expct FROM b),
e AS (SELECT *, lost OR notlift OR rankable OR adv AS scope, adv OR crowd AS ups, rok AND NOT aok AND NOT expct AND marked_abstention AND abst AS wrongful, CASE WHEN n_spans > 0 THEN n_spans >= 2 AND n_spans >= 4 WHEN n_gold >= 4 THEN NULL ELSE false END AS press, coalesce(wide_hit, true) AS recov,
  CASE WHEN oracle_faithfulness >= 0.7 THEN CASE WHEN oracle_mode = 'hop_binding' AND NOT hop THEN 'misinterpretation' ELSE oracle_mode END END AS mode, hop AND coalesce(oracle_fn = 0 AND oracle_fp > 0, false) AS hopc, NOT noans AND coalesce(NOT gold_in_corpus, false) AS gap, coalesce(density < 0.2 AND context_precision < 0.7, false) AS noise FROM d),
p AS (SELECT *, rok AND ook AND NOT aok AND NOT wrongful AS ctx, (oracle_answered AND NOT ook) OR (noans AND NOT abst) OR wrongful AS gen, CASE WHEN noans THEN abst WHEN NOT has_truth THEN NULL ELSE rok AND aok AND gr END AS success, gold_position BETWEEN 0.25 AND 0.75 AS mid,
  coalesce(oracle_faithfulness >= 0.7 AND oracle_relevancy >= 0.7, false) AND NOT (mode IS NOT NULL OR hopc) AS gw FROM e)
"""


def _s(*rules: tuple[str, str, str]) -> str:
    """A slot in SQL: the first confirmed of (label, applies, confirmed), else the first that applies."""
    items = ", ".join(f"CASE WHEN {a} THEN {{'l': '{label}', 'c': coalesce({k}, false)}} END" for label, a, k in rules)
    return f"coalesce(list_filter([{items}], lambda x: x IS NOT NULL AND x.c)[1], list_filter([{items}], lambda x: x IS NOT NULL)[1])"


_CHUNKING = [("chunking_overchunking", "oversized > 0 AND NOT (rok AND NOT ctx)", "true"), ("chunking_context_mismatch", "oversized = 0 AND split_spans > 0 AND NOT (rok AND NOT ctx) AND NOT (miss AND coalesce(press, false) AND recov)", "true")]
_RET = _s(
    ("retrieval_incomplete_enumeration", "miss AND coalesce(press, true) AND recov", "coalesce(press, false) AND qtype = 'aggregation'"), ("retrieval_missing_bridge_dependency", "qtype = 'bridge' AND miss AND recall_at_k >= 0 AND recall_at_k < 1", "false"), ("retrieval_rank_fusion_loss", "adv", "true"), ("retrieval_duplicate_crowding", "NOT adv AND crowd", "true"),
    ("retrieval_rerank_candidate_miss", "NOT ups AND winmiss", "true"), ("retrieval_reranker_ineffective", "cut AND NOT ups AND NOT winmiss AND notlift", "true"), ("retrieval_reranker_demotion", "cut AND NOT ups AND NOT winmiss AND lost", "true"), ("retrieval_low_rank", "rankable AND NOT ups AND NOT cut AND NOT winmiss", "NOT reranked"), *_CHUNKING,
    ("retrieval_lexical_mismatch", "coalesce(lexical_hits_gold, false) AND NOT scope", "true"), ("retrieval_semantic_mismatch", "qtype <> 'bridge' AND NOT scope AND coalesce(NOT lexical_hits_gold, false) AND coalesce(missed_in_corpus, true)", "missed_in_corpus"), ("retrieval_missing_gold", "qtype <> 'bridge' AND miss AND coalesce(missed_in_corpus, true)", "missed_in_corpus"), ("retrieval_failure", "true", "false"),
)
_GEN = _s(
    ("generation_wrongful_abstention", "wrongful", "true"), ("generation_abstention_failure", "NOT answer_blank AND expct AND NOT abst", "true"), ("bad_gold_answer", "NOT ook AND gw", "true"), *((v, f"coalesce(mode = '{k}', false)", "true") for k, v in diagnose.MODES.items()),
    ("generation_hop_binding_error", "mode IS NULL AND coalesce(oracle_faithfulness >= 0.7, false) AND hop AND (oracle_tp IS NULL OR hopc)", "oracle_tp IS NOT NULL"), ("generation_hallucination", "coalesce(oracle_faithfulness < 0.7, false)", "true"), ("generation_partial_answer", "CASE WHEN oracle_tp IS NOT NULL THEN oracle_fn > 0 AND oracle_tp > 0 ELSE coalesce(oracle_relevancy < 0.7, false) END", "oracle_tp IS NOT NULL"), ("generation_failure", "true", "false"),
)
_CTX = _s(
    ("bad_gold_answer", "NOT ook AND coalesce(faithfulness >= 0.7 AND relevancy >= 0.7, false)", "true"), *_CHUNKING, ("chunking_underchunking", "ctx AND noise", "true"), ("too_long_context", "ctx AND NOT noise AND coalesce(faithfulness < 0.7, false) AND context_chars >= 6000 AND coalesce(NOT mid, false)", "true"), ("lost_in_the_middle", "ctx AND NOT noise AND coalesce(faithfulness < 0.7, false) AND context_chars >= 6000 AND coalesce(mid, false)", "true"),
    ("context_noise_interference", "ctx AND NOT noise AND ver", "true"), ("reranker_low_precision", "ctx AND reranked AND NOT noise AND coalesce(context_precision < 0.7, false) AND coalesce(promoted > 0, true)", "promoted IS NOT NULL"), ("context_failure", "true", "false"),
)
_F = f"""
{_P}, mk AS (SELECT *, NOT gap AND oracle_answered AND NOT ook AND aok AND faithfulness IS NOT NULL AS mis, recall_at_k >= 0 AND recall_at_k < 1 AS short FROM p WHERE success IS NOT NULL AND NOT success),
ff AS (SELECT probe_id, CASE WHEN NOT gap AND NOT ook AND gw THEN [{{'l': 'bad_gold_answer', 'c': true}}] WHEN mis AND ver THEN [{{'l': 'bad_gold_chunk', 'c': true}}] WHEN NOT gap AND NOT rok AND aok AND ook AND ver THEN [] ELSE list_filter([
  CASE WHEN mis AND NOT ver THEN {{'l': 'bad_gold_chunk', 'c': false}} END, CASE WHEN short AND NOT mis AND NOT noans AND NOT gold_all_absent THEN {_RET} END, CASE WHEN short AND gap AND NOT hop THEN {{'l': 'corpus_gap', 'c': true}} END, CASE WHEN short AND gap AND hop THEN {{'l': 'corpus_gap_partial_hop', 'c': true}} END,
  CASE WHEN gen THEN {_GEN} END, CASE WHEN ctx THEN {_CTX} END, CASE WHEN NOT noans AND has_truth AND rok AND aok AND NOT gr THEN {{'l': 'generation_parametric_overreliance', 'c': true}} END, CASE WHEN NOT answer_blank AND expct AND NOT abst THEN {{'l': 'generation_abstention_failure', 'c': true}} END], lambda x: x IS NOT NULL) END AS f FROM mk),
fu AS (SELECT probe_id, unnest(f) AS x, unnest(range(0, len(f))) AS i FROM ff), fd AS (SELECT probe_id, x.l AS label, x.c AS confirmed, i FROM fu QUALIFY row_number() OVER (PARTITION BY probe_id, x.l ORDER BY i) = 1),
fg AS (SELECT *, CASE WHEN label IN ('bad_gold_answer', 'bad_gold_chunk', 'corpus_gap', 'corpus_gap_partial_hop') THEN 'D' WHEN label LIKE 'chunking\\_%' ESCAPE '\\' OR label LIKE 'reranker\\_%' ESCAPE '\\' OR label LIKE 'retrieval\\_%' ESCAPE '\\' THEN 'A' WHEN label LIKE 'generation\\_%' ESCAPE '\\' THEN 'B' ELSE 'C' END AS grp,
  CASE WHEN label IN ({', '.join(repr(x) for x in diagnose.CRITICAL)}) THEN 'critical' ELSE 'warning' END AS severity FROM fd),
findings AS (SELECT probe_id, row_number() OVER (PARTITION BY probe_id ORDER BY CASE grp WHEN 'D' THEN 0 WHEN 'A' THEN 1 WHEN 'C' THEN 2 ELSE 3 END, CASE severity WHEN 'critical' THEN 0 ELSE 1 END, i) - 1 AS ord, label, confirmed, grp, severity FROM fg)
"""


@query("WITH" + _F + "SELECT probe_id, ord, label, confirmed, grp, severity FROM findings")
def dx_s02_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every record: slots, additive labels, order."""
    return diagnose.diagnose(records(spark, sf_dir))


@query("WITH" + _P + "SELECT count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE NOT success) AS failed, count(*) FILTER (WHERE success IS NULL) AS unjudged, count(*) FILTER (WHERE ctx) AS context_failed, count(*) FILTER (WHERE gen) AS generation_failed, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE scope) AS rank_scope, count(*) FILTER (WHERE wrongful) AS wrongful FROM p")
def pc_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-conditions of the labels, counted."""
    p = diagnose.predicates(records(spark, sf_dir))
    n = F.count_if
    return p.agg(n("success").alias("passed"), n(~F.col("success")).alias("failed"), n(F.col("success").isNull()).alias("unjudged"), n("context_failed").alias("context_failed"), n("generation_failed").alias("generation_failed"), n("gap").alias("gaps"), n("rank_scope").alias("rank_scope"), n("wrongful").alias("wrongful"))


@query("WITH" + _F + ", w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY probe_id) AS w FROM findings) SELECT label, confirmed, count(*) AS findings, round(sum(w), 3) AS weight FROM w GROUP BY 1, 2")
def agg07_label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by label, a probe counting as one."""
    return report.label_weights(diagnose.diagnose(records(spark, sf_dir)))


_GOLD = "('bad_gold_answer', 'bad_gold_chunk')"


@query("WITH" + _F + f""", bad AS (SELECT DISTINCT probe_id FROM findings WHERE label IN {_GOLD}), k AS (SELECT p.*, EXISTS (SELECT 1 FROM findings f WHERE f.probe_id = p.probe_id) AS found FROM p WHERE probe_id NOT IN (SELECT probe_id FROM bad)),
m AS (SELECT qtype, count(*) AS probes, avg(faithfulness) AS fa, avg(relevancy) AS re, avg(correctness) AS co, avg(CASE WHEN recall_at_k >= 0 THEN recall_at_k END) AS rc, avg(CASE WHEN has_truth THEN f1 END) AS f,
 avg(CASE WHEN NOT answer_exists THEN CASE WHEN found THEN 0.0 ELSE 1.0 END WHEN has_truth AND recall_at_k >= 0 THEN least(1.0, recall_at_k) * CASE WHEN sem IS NULL THEN f1 ELSE 0.4 * f1 + 0.6 * least(1.0, sem) END END) AS rel FROM k GROUP BY 1),
q AS (SELECT *, (0.30 * fa + 0.25 * co + 0.20 * re) / 0.75 AS quality FROM m)
SELECT qtype, probes, round(rc, 6) AS mean_recall, round(f, 6) AS mean_f1, round(quality, 6) AS quality, round(rel, 6) AS reliability, round(2 / (1 / greatest(quality, 1e-6) + 1 / greatest(rel, 1e-6)), 6) AS composite FROM q""")
def agg08_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and reliability axes and their harmonic mean per question type; probes with a wrong gold stay out."""
    r = records(spark, sf_dir)
    f = diagnose.diagnose(r)
    seen = f.groupBy("probe_id").agg(F.bool_or(F.col("label").isin("bad_gold_answer", "bad_gold_chunk")).alias("bad"))
    p = diagnose.predicates(r).join(seen, "probe_id", "left").filter(~F.coalesce("bad", F.lit(False)))
    c = F.col
    answer = diagnose.blend(c("f1"), c("answer_semantic"))
    reliable = F.when(c("no_answer"), F.when(c("bad").isNotNull(), 0.0).otherwise(1.0)).when(c("has_truth") & (c("recall_at_k") >= 0), F.least(F.lit(1.0), c("recall_at_k")) * answer)
    m = p.groupBy("qtype").agg(F.count("*").alias("probes"), F.avg("faithfulness").alias("fa"), F.avg("relevancy").alias("re"), F.avg("correctness").alias("co"), F.avg(F.when(c("recall_at_k") >= 0, c("recall_at_k"))).alias("rc"), F.avg(F.when(c("has_truth"), c("f1"))).alias("f"), F.avg(reliable).alias("rel"))
    m = m.withColumn("quality", report.weighted({"faithfulness": c("fa"), "answer_correctness": c("co"), "response_relevancy": c("re")}))
    return m.select("qtype", "probes", F.round("rc", 6).alias("mean_recall"), F.round("f", 6).alias("mean_f1"), F.round("quality", 6).alias("quality"), F.round("rel", 6).alias("reliability"), F.round(report.harmonic([c("quality"), c("rel")]), 6).alias("composite"))


_quoted = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else f"[{', '.join(map(_quoted, x))}]::VARCHAR[]" if isinstance(x, list) else f"'{x}'"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in optimize.prescription_rows()) + ") t(label, grp, status, metric, ord, action, path, value, reindex, ready, topics))"
_PRESC = _RULES + ", pr AS (SELECT * FROM rules WHERE status = 'ready' AND ready)"
_ACT = _F + ", " + _PRESC + """, su AS (SELECT action, path, value, reindex, f.label, pr.grp, probe_id, CASE WHEN confirmed THEN 1.0 ELSE 0.5 END AS conf FROM findings f JOIN pr ON pr.label = f.label),
pp AS (SELECT action, path, value, reindex, probe_id, max(conf) AS c, min(CASE grp WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'B' THEN 2 ELSE 3 END) AS tier FROM su GROUP BY 1, 2, 3, 4, 5),
ac AS (SELECT action, path, value, count(*) AS probes, sum(c) AS support, min(tier) AS tier, CASE WHEN reindex THEN 3 ELSE 1 END AS cost, sum(c) / CASE WHEN reindex THEN 3 ELSE 1 END AS score, reindex AS reindex_ FROM pp GROUP BY 1, 2, 3, reindex)
"""


@query("WITH" + _ACT + "SELECT action, path, value, probes, tier, cost, round(score, 6) AS score, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM su WHERE su.action = ac.action AND su.path = ac.path AND su.value = ac.value) AS labels FROM ac")
def opt06_action_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by the probes that speak for them."""
    a = optimize.actions(optimize.supports(diagnose.diagnose(records(spark, sf_dir))))
    return a.select("action", "path", "value", "probes", "tier", "cost", F.round("score", 6).alias("score"), F.array_join("labels", ",").alias("labels"))


@query("WITH" + _ACT + """, rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS s2, lead(probes) OVER w AS p2, lead(tier) OVER w AS t2 FROM ac WINDOW w AS (PARTITION BY path ORDER BY tier, score DESC, action, value)),
b2 AS (SELECT *, CASE WHEN s2 IS NOT NULL AND t2 = tier AND (score <= 0 OR score - s2 < 0.2 * score OR probes - p2 < 2) THEN 'deferred' ELSE 'eligible' END AS state FROM rk WHERE r = 1)
SELECT row_number() OVER (ORDER BY state <> 'eligible', tier, score DESC, cost, action) AS place, action, path, value, state, tier, round(score, 6) AS score, probes FROM b2""")
def opt11_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per path, deferred where the next is too near, in the order of choice."""
    a = optimize.actions(optimize.supports(diagnose.diagnose(records(spark, sf_dir))))
    return optimize.choose(a).select("place", "action", "path", "value", "state", "tier", F.round("score", 6).alias("score"), "probes")


@query("WITH" + _F + ", " + _PRESC + """, t AS (SELECT label, probe_id, CASE probe_id::INT % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'spread' WHEN 2 THEN 'unmeasured' END AS topic FROM findings),
sg AS (SELECT label, arg_min(topic, probe_id) FILTER (WHERE topic <> 'unmeasured') AS signal FROM t GROUP BY 1),
k AS (SELECT pr.*, len(topics) = 0 OR signal IS NULL OR list_contains(topics, signal) AS fits FROM pr JOIN sg USING (label)), m AS (SELECT *, bool_or(fits) OVER (PARTITION BY label) AS any_ FROM k)
SELECT label, ord, action, path, value FROM m WHERE fits OR NOT any_""")
def opt04_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prescriptions of each label that was found, for its topic where one was measured."""
    f = diagnose.diagnose(records(spark, sf_dir))
    n = F.pmod(F.col("probe_id").cast("int"), F.lit(4))
    f = f.withColumn("topic_cluster", F.when(n == 0, "none").when(n == 1, "spread").when(n == 2, "unmeasured"))
    return optimize.applicable(f, consume=True).select("label", "ord", "action", "path", "value")


@query("WITH" + _ACT + "SELECT a.action, a.path, a.value, string_agg(b.action || '=' || b.value, ',' ORDER BY b.action || '=' || b.value) AS opposed_by FROM ac a JOIN ac b ON a.path = b.path AND (a.action <> b.action OR a.value <> b.value) GROUP BY 1, 2, 3")
def opt07_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which actions pull at the same path."""
    a = optimize.actions(optimize.supports(diagnose.diagnose(records(spark, sf_dir))))
    return optimize.opposition(a).withColumn("opposed_by", F.array_join("opposed_by", ","))


@query("WITH" + _ACT + ", th AS (SELECT action, max(support) AS required FROM ac WHERE reindex_ GROUP BY 1) SELECT action, path, value, CASE WHEN support <= required THEN 'keep_protected_axis' END AS reason FROM ac LEFT JOIN th USING (action)")
def opt08_keep_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions against a guard that asks of those that re-index more support than they have."""
    a = optimize.actions(optimize.supports(diagnose.diagnose(records(spark, sf_dir))))
    guard = a.filter("reindex").groupBy("action").agg(F.max("support").alias("required"))
    return optimize.keep_guard(a, guard).select("action", "path", "value", "reason")


@query("WITH" + _ACT + "SELECT action, path, value, CASE WHEN NOT path LIKE '%.%' THEN 'mappable' WHEN action LIKE '%model%' THEN 'capable' WHEN probes < 2 THEN 'has_candidates' END AS reason FROM ac")
def opt09_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that an action fails (checks over its own columns stand for a backend's)."""
    a = optimize.actions(optimize.supports(diagnose.diagnose(records(spark, sf_dir))))
    checks = {"has_candidates": F.col("probes") >= 2, "mappable": F.col("path").contains("."), "capable": ~F.col("action").contains("model")}
    return a.select("action", "path", "value", optimize.eligibility(checks).alias("reason"))


@query("WITH " + _RULES + "SELECT label, grp, status, metric, ord, action, path, value, reindex, ready FROM rules")
def opt27_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table."""
    return optimize.prescriptions(table(spark, sf_dir, "region")).drop("topics")


@query("WITH" + _F + ", " + _RULES + """, st AS (SELECT label, any_value(status) AS status FROM rules GROUP BY 1)
SELECT probe_id, CASE WHEN bool_or(status = 'manual' AND confirmed) THEN 'manual' WHEN bool_or(status = 'ready' AND confirmed) THEN 'apply' ELSE 'skipped' END AS mode, count(*) FILTER (WHERE status = 'ready' AND confirmed) AS actionable, count(*) FILTER (WHERE status = 'manual') AS manual FROM findings JOIN st USING (label) GROUP BY 1""")
def opt28_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings leave to a person and what to the rules, per probe."""
    return optimize.split(diagnose.diagnose(records(spark, sf_dir)), ["probe_id"])


@query("WITH " + _R + """ SELECT CAST(fused_rank AS INT) AS fused_rank, count(*) AS n FROM r WHERE fused_rank IS NOT NULL GROUP BY 1""")
def opt13_rank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many probes need which rank: the input of the knee."""
    return records(spark, sf_dir).filter("fused_rank is not null").groupBy(F.col("fused_rank").cast("int").alias("fused_rank")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, CASE WHEN before IS NULL THEN 'unjudgeable' WHEN value < 0.45 THEN 'rollback' WHEN value - before > 0 AND (value - before > 0.02 OR abs(value - before - 0.02) <= 1e-12) THEN 'keep' ELSE 'rollback' END AS verdict, round(value - before, 6) AS delta FROM e""")
def opt21_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials judged against the one before: a floor, then an improvement (events stand for trials)."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(w).alias("before"))
    v = optimize.verdict(F.col("before"), F.col("value"), {"context_precision": F.col("value")})
    return e.select("event_id", v.alias("verdict"), F.round(F.col("value") - F.col("before"), 6).alias("delta"))


@query("WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, n * 1000.0 / sum(n) OVER () AS raw FROM s), f AS (SELECT *, floor(round(raw, 9)) AS fl FROM r), k AS (SELECT *, row_number() OVER (ORDER BY round(raw - fl, 9) DESC, event_type) AS p, 1000 - sum(fl) OVER () AS rest FROM f) SELECT event_type, CAST(fl + CASE WHEN p <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM k")
def top04_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand seats by largest remainder."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return optimize.apportion(s, "event_type", "n", 1000, "event_type")


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS q50, quantile_disc(l_quantity, 0.85) AS q85, quantile_disc(l_quantity, 0.95) AS q95 FROM lineitem GROUP BY 1")
def top07_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY l_quantity)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p(0.5).alias("q50"), p(0.85).alias("q85"), p(0.95).alias("q95"))


@query("""WITH p AS (SELECT * FROM (VALUES ('view', 0.1), ('click', 0.2), ('cl', 0.5), ('purchase', 1.0), ('p', 0.7)) t(prefix, price)), u AS (SELECT event_type, count(*) AS calls, sum(value) AS tokens FROM events GROUP BY 1),
m AS (SELECT event_type, calls, tokens, price, row_number() OVER (PARTITION BY event_type ORDER BY length(prefix) DESC NULLS LAST) AS r FROM u LEFT JOIN p ON starts_with(event_type, prefix)), k AS (SELECT * FROM m WHERE r = 1)
SELECT coalesce(event_type, '(all)') AS event_type, sum(calls) AS calls, round(sum(tokens), 4) AS tokens, round(coalesce(sum(tokens * price), 0), 4) AS cost, sum(CASE WHEN price IS NULL THEN calls ELSE 0 END) AS unpriced FROM k GROUP BY ROLLUP(event_type)""")
def agg28_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by kind and in all, priced by the longest prefix (events stand for calls).

    Events are summed per kind first; only the few kinds meet the price list.
    """
    prices = spark.createDataFrame([("view", 0.1), ("click", 0.2), ("cl", 0.5), ("purchase", 1.0), ("p", 0.7)], "prefix string, price double")
    u = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("tokens"))
    m = u.join(F.broadcast(prices), F.col("event_type").startswith(F.col("prefix")), "left").groupBy("event_type", "calls", "tokens").agg(F.max_by("price", F.length("prefix")).alias("price"))
    out = m.rollup("event_type").agg(F.sum("calls").alias("calls"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.coalesce(F.sum(F.col("tokens") * F.col("price")), F.lit(0.0)), 4).alias("cost"), F.sum(F.when(F.col("price").isNull(), F.col("calls")).otherwise(0)).alias("unpriced"))
    return out.withColumn("event_type", F.coalesce("event_type", F.lit("(all)")))
