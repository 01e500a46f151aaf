"""Lookups, means, samples and decisions that are one or two relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..operators import diagnose, intervals, optimize, report
from ..runtime import table
from .logs import LOGS_SQL, logs
from .records import _F, _R, records
from .registry import query

_CTX_SQL = "WITH " + LOGS_SQL + ", x AS (SELECT log_id, unnest(contexts) AS c, unnest(range(0, len(contexts))) AS i FROM l WHERE len(contexts) > 0)"


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("log_id", F.posexplode("contexts").alias("i", "c"))


@query(_CTX_SQL + ", k AS (SELECT chunk_id, min(doc_id) AS doc_id, min(length(text)) AS chars FROM kg_nodes WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT log_id, i, c.chunk_id AS chunk_id, k.doc_id, k.chars FROM x JOIN k ON x.c.chunk_id = k.chunk_id")
def jn01_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined to the current chunks, whose payload counts; results without a chunk drop out."""
    k = table(spark, sf_dir, "kg_nodes").filter("chunk_id is not null").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).alias("chars"))
    x = _contexts(spark, sf_dir).select("log_id", "i", F.col("c.chunk_id").alias("chunk_id"))
    return x.join(k, "chunk_id").select("log_id", "i", "chunk_id", "doc_id", "chars")


@query(_CTX_SQL + ", g AS (SELECT DISTINCT log_id, c.chunk_id AS id FROM x WHERE c.chunk_id IS NOT NULL), k AS (SELECT DISTINCT chunk_id FROM kg_nodes) SELECT log_id, count(*) AS gold, count(k.chunk_id) AS present, bool_and(k.chunk_id IS NOT NULL) AS all_present, bool_or(k.chunk_id IS NULL) AS any_absent FROM g LEFT JOIN k ON g.id = k.chunk_id GROUP BY 1")
def jn10_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a log's chunk ids the corpus has."""
    g = _contexts(spark, sf_dir).select("log_id", F.col("c.chunk_id").alias("chunk_id")).filter("chunk_id is not null").distinct()
    k = table(spark, sf_dir, "kg_nodes").select("chunk_id").distinct().withColumn("_in", F.lit(True))
    inside = F.coalesce("_in", F.lit(False))
    return g.join(k, "chunk_id", "left").groupBy("log_id").agg(F.count("*").alias("gold"), F.count_if(inside).alias("present"), F.bool_and(inside).alias("all_present"), F.bool_or(~inside).alias("any_absent"))


@query(_CTX_SQL + ", o AS (SELECT x.log_id, i, (length(c.text) - length(replace(c.text, truth, ''))) // length(truth) AS times, strpos(c.text, truth) - 1 AS found_at FROM x JOIN l USING (log_id) WHERE length(truth) BETWEEN 2 AND 50 AND c.text IS NOT NULL) SELECT log_id, i, times, found_at FROM o WHERE times = 1")
def jn18_answer_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts in which the truth (2 to 50 characters) occurs exactly once, and where."""
    x = logs(spark, sf_dir).filter(F.length("truth").between(2, 50)).select("log_id", "truth", F.posexplode("contexts").alias("i", "c")).select("log_id", "truth", "i", F.col("c.text").alias("t")).filter("t is not null")
    times = F.floor((F.length("t") - F.length(F.replace("t", "truth"))) / F.length("truth"))
    return x.select("log_id", "i", times.alias("times"), (F.expr("locate(truth, t)") - 1).alias("found_at")).filter("times = 1")


@query(_CTX_SQL + ", r AS (SELECT log_id, i, coalesce(c.chunk_id, '') AS chunk_id, row_number() OVER (PARTITION BY log_id, coalesce(c.chunk_id, '') ORDER BY i) AS n FROM x) SELECT log_id, i, chunk_id FROM r WHERE n = 1 OR chunk_id = ''")
def ddp05_first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results once per chunk id, the first staying; results without an id all stay."""
    x = _contexts(spark, sf_dir).select("log_id", "i", F.coalesce("c.chunk_id", F.lit("")).alias("chunk_id"))
    n = F.row_number().over(W.Window.partitionBy("log_id", "chunk_id").orderBy("i"))
    return x.withColumn("n", n).filter("n = 1 or chunk_id = ''").drop("n")


@query(_CTX_SQL + r", f AS (SELECT log_id, arg_min(c.text, i) AS answer, min(i) AS found_at FROM x WHERE trim(c.text, E' \t\n\r') <> '' GROUP BY 1) SELECT log_id, substring(sha256(answer), 1, 16) AS answer, found_at, (SELECT count(*) FROM x y WHERE y.log_id = f.log_id) AS citations FROM f")
def ret15_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first context with text as an answer, and the number of citations."""
    x = _contexts(spark, sf_dir)
    full = F.btrim("c.text", F.lit(" \t\n\r")) != ""
    out = x.groupBy("log_id").agg(F.min_by(F.when(full, F.col("c.text")), F.when(full, F.col("i"))).alias("a"), F.min(F.when(full, F.col("i"))).alias("found_at"), F.count("*").alias("citations"))
    return out.filter("found_at is not null").select("log_id", F.substring(F.sha2("a", 256), 1, 16).alias("answer"), "found_at", "citations")


@query(_CTX_SQL + ", n AS (SELECT log_id, count(*) AS n, coalesce(sum(length(c.text)), 0) AS chars FROM x GROUP BY 1), h AS (SELECT log_id, i / CAST(n - 1 AS DOUBLE) AS p FROM x JOIN n USING (log_id) JOIN l USING (log_id) WHERE n >= 3 AND list_contains(l.gold, x.c.text)), b AS (SELECT log_id, arg_min(p, least(p, 1 - p) * 1000 + p) AS position FROM h GROUP BY 1) SELECT n.log_id, n.n AS contexts, chars, round(position, 6) AS position FROM n LEFT JOIN b USING (log_id)")
def met16_context_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all contexts, and the place of the gold one nearest to an edge (three contexts at least)."""
    x = logs(spark, sf_dir).select("log_id", "gold", F.size("contexts").alias("n"), F.posexplode("contexts").alias("i", "c"))
    p = F.when((F.col("n") >= 3) & F.array_contains("gold", F.col("c.text")), F.col("i") / (F.col("n") - 1))
    out = x.withColumn("p", p).groupBy("log_id").agg(F.count("*").alias("contexts"), F.coalesce(F.sum(F.length("c.text")), F.lit(0)).alias("chars"), F.min_by("p", F.least("p", 1 - F.col("p")) * 1000 + F.col("p")).alias("position"))
    return out.withColumn("position", F.round("position", 6))


@query("SELECT DISTINCT chunk_id, CASE WHEN length(s) > 180 THEN rtrim(substring(s, 1, 179)) || '…' ELSE s END AS preview FROM (SELECT chunk_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS s FROM chunk_rows WHERE text IS NOT NULL)")
def txt18_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line previews of chunks."""
    return table(spark, sf_dir, "chunk_rows").filter("text is not null").select("chunk_id", T.preview(F.col("text")).alias("preview")).distinct()


@query("SELECT count(*) AS drafts, count(*) FILTER (WHERE coalesce(start_pos >= 0 AND end_pos > start_pos, false)) AS valid, count(*) FILTER (WHERE coalesce(raw_start >= 0 AND raw_end > raw_start, false)) AS raw_valid, count(*) FILTER (WHERE coalesce(raw_start <= start_pos AND raw_end >= end_pos, false)) AS raw_contains FROM (SELECT DISTINCT doc_id, draft_no, start_pos, end_pos, raw_start, raw_end FROM chunk_drafts)")
def flt01_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid spans, and original spans that contain the trimmed ones."""
    d = table(spark, sf_dir, "chunk_drafts").select("doc_id", "draft_no", "start_pos", "end_pos", "raw_start", "raw_end").distinct()
    c = F.col
    contains = F.coalesce((c("raw_start") <= c("start_pos")) & (c("raw_end") >= c("end_pos")), F.lit(False))
    return d.agg(F.count("*").alias("drafts"), F.count_if(intervals.valid(c("start_pos"), c("end_pos"))).alias("valid"), F.count_if(intervals.valid(c("raw_start"), c("raw_end"))).alias("raw_valid"), F.count_if(contains).alias("raw_contains"))


@query("WITH " + _R + " SELECT qtype, round(avg(faithfulness), 5) AS faithfulness, round(avg(CASE WHEN recall_at_k >= 0 THEN recall_at_k END), 5) AS mean_recall, round(avg(CASE WHEN has_truth THEN f1 END), 5) AS mean_f1, round(avg(CASE WHEN has_truth AND oracle_answered THEN oracle_f1 END), 5) AS mean_oracle_f1, count(*) FILTER (WHERE has_truth AND oracle_answered) AS oracle_measured, round(coalesce((0.30 * avg(faithfulness) + 0.25 * avg(correctness) + 0.20 * avg(relevancy)) / 0.75, 0), 5) AS overall FROM r GROUP BY 1")
def agg04_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over measured rows, and the overall score."""
    c = F.col
    m = diagnose.complete(records(spark, sf_dir)).groupBy("qtype").agg(
        F.avg("faithfulness").alias("fa"), F.avg("correctness").alias("co"), F.avg("relevancy").alias("re"), F.avg(F.when(c("recall_at_k") >= 0, c("recall_at_k"))).alias("rc"), F.avg(F.when(c("has_truth"), c("f1"))).alias("f"),
        F.avg(F.when(c("has_truth") & c("oracle_answered"), c("oracle_f1"))).alias("o"), F.count_if(c("has_truth") & c("oracle_answered")).alias("oracle_measured"),
    )
    total = report.overall({"faithfulness": c("fa"), "answer_correctness": c("co"), "response_relevancy": c("re"), "context_recall": F.lit(None).cast("double")}, c("rc"), c("f"))
    return m.select("qtype", F.round("fa", 5).alias("faithfulness"), F.round("rc", 5).alias("mean_recall"), F.round("f", 5).alias("mean_f1"), F.round("o", 5).alias("mean_oracle_f1"), "oracle_measured", F.round(total, 5).alias("overall"))


@query("WITH" + _F + ", k AS (SELECT p.probe_id, has_truth, ook, oracle_answered, EXISTS (SELECT 1 FROM findings f WHERE f.probe_id = p.probe_id) AS found FROM p) SELECT count(*) AS judged, round(avg(CASE WHEN ook OR (NOT oracle_answered AND NOT found) THEN 1.0 ELSE 0.0 END), 6) AS oracle_accuracy FROM k WHERE has_truth")
def agg06_oracle_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of probes whose oracle passes; successes without an oracle answer count as passing."""
    r = records(spark, sf_dir)
    f = diagnose.diagnose(r).select("probe_id").distinct().withColumn("_f", F.lit(True))
    p = diagnose.predicates(r).filter("has_truth").join(f, "probe_id", "left")
    ok = F.col("oracle_ok") | (~F.col("oracle_answered") & F.col("_f").isNull())
    return p.agg(F.count("*").alias("judged"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("oracle_accuracy"))


@query("WITH " + _R + ' SELECT search_mode, count(*) AS probes, count(*) FILTER (WHERE reranked) AS applied, count(*) FILTER (WHERE reranked AND pre_visible) AS visible, count(*) FILTER (WHERE mmr) AS with_mmr, round(avg(context_chars), 4) AS mean_chars, count(*) FILTER (WHERE degraded) AS degraded FROM r GROUP BY 1')
def agg09_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ran, by search mode."""
    n = F.count_if
    return records(spark, sf_dir).groupBy("search_mode").agg(F.count("*").alias("probes"), n("reranked").alias("applied"), n(F.col("reranked") & F.col("pre_visible")).alias("visible"), n("mmr").alias("with_mmr"), F.round(F.avg("context_chars"), 4).alias("mean_chars"), n("degraded").alias("degraded"))


@query("WITH" + _F + ", o AS (SELECT probe_id, string_agg(label, ' > ' ORDER BY ord) AS labels, bool_or(confirmed) AS any_confirmed, count(*) AS n FROM findings GROUP BY 1) SELECT p.probe_id, qtype, coalesce(labels, '') AS labels, coalesce(n, 0) AS n, coalesce(any_confirmed, false) AS any_confirmed FROM p LEFT JOIN o USING (probe_id) WHERE success IS NOT NULL AND NOT success")
def sup22_failed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed questions with their ordered reasons."""
    r = records(spark, sf_dir)
    o = diagnose.diagnose(r).groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l"), F.bool_or("confirmed").alias("any_confirmed"), F.count("*").alias("n"))
    p = diagnose.predicates(r).filter("not success").select("probe_id", "qtype").join(o, "probe_id", "left")
    return p.select("probe_id", "qtype", F.coalesce(F.array_join("l.label", " > "), F.lit("")).alias("labels"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("any_confirmed", F.lit(False)).alias("any_confirmed"))


@query("SELECT doc_id, max_by(title, crawled_at) AS title, count(*) AS deliveries FROM source_docs WHERE title IS NOT NULL GROUP BY 1")
def agg24_last_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their last title."""
    return table(spark, sf_dir, "source_docs").filter("title is not null").groupBy("doc_id").agg(F.max_by("title", "crawled_at").alias("title"), F.count("*").alias("deliveries"))


@query("WITH e AS (SELECT event_type, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT event_type AS action, count(*) AS tries, count(*) FILTER (WHERE d >= 0.02) AS kept, count(*) FILTER (WHERE d < 0.02) AS rolled_back, round(max(d), 6) AS best_delta FROM e GROUP BY 1")
def agg29_action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries, verdicts and best gain of each action (events stand for trials)."""
    w = W.Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") - F.lag("value").over(w)).alias("d"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return e.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("tries"), yes(F.col("d") >= 0.02).alias("kept"), yes(F.col("d") < 0.02).alias("rolled_back"), F.round(F.max("d"), 6).alias("best_delta"))


@query("WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings) SELECT label, count(*) AS n, min(vec_id) AS first_id, round(avg(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) AS mean_norm FROM v GROUP BY 1")
def agg19_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors."""
    from ..functions import vectors as V

    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, lang FROM documents WHERE lang IS NOT NULL), w AS (SELECT doc_id, lang, i, n FROM d WHERE n <= 20 OR i IN (SELECT unnest(list_transform(range(0, 20), lambda j: j * d.n // 20)))) SELECT lang, doc_id, i, n FROM w")
def top03_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of each language at an even stride (a sampling operator)."""
    w = W.Window.partitionBy("lang")
    d = table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "lang")
    d = d.withColumn("i", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(w))
    # i is j·n div 20 of some j exactly if its own j, the least with j·n >= 20·i, gives it back.
    j = F.ceil(F.col("i") * 20 / F.col("n"))
    return d.filter((F.col("n") <= 20) | ((F.floor(j * F.col("n") / 20) == F.col("i")) & (j < 20))).select("lang", "doc_id", "i", "n")


@query("WITH " + _R + ", q AS (SELECT CAST(fused_rank AS INT) AS v, count(*) AS n FROM r WHERE fused_rank IS NOT NULL GROUP BY 1), g AS (SELECT v, (v - lag(v) OVER (ORDER BY v)) / CAST(n AS DOUBLE) AS gap FROM q), s AS (SELECT min(v) FILTER (WHERE gap > 2.0) AS stop FROM g), k AS (SELECT max(v) AS knee FROM g, s WHERE v < coalesce(stop, 1000000000)) SELECT candidate_no, candidate, candidate = knee AS is_knee FROM (SELECT row_number() OVER (ORDER BY v) AS candidate_no, v AS candidate FROM q, k WHERE v >= knee), k WHERE candidate_no <= 3")
def top08_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knee of required ranks and the next candidates."""
    need = records(spark, sf_dir).filter("fused_rank is not null").select(F.col("fused_rank").cast("int").alias("v"))
    return optimize.knee(need, "v")


@query("WITH e AS (SELECT user_id AS run_id, max(value) * 100 AS composite, avg(value) AS recall FROM events GROUP BY 1) SELECT run_id, composite >= 90 AND recall >= 0.6 AS serve, CASE WHEN composite < 90 THEN 'composite_below_threshold' WHEN recall < 0.6 THEN 'recall_below_floor' ELSE 'passed' END AS reason FROM e")
def opt01_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate to serving (events stand for reports)."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.max("value") * 100).alias("c"), F.avg("value").alias("r"))
    reason = F.when(F.col("c") < optimize.GATE_SCORE, "composite_below_threshold").when(F.col("r") < optimize.GATE_RECALL, "recall_below_floor").otherwise("passed")
    return e.select("run_id", optimize.gate(F.col("c"), F.col("r"), F.lit(None).cast("boolean")).alias("serve"), reason.alias("reason"))


@query("WITH e AS (SELECT sha256(event_type || ':' || CAST(user_id % 20 AS VARCHAR)) AS fingerprint, value FROM events) SELECT substring(fingerprint, 1, 12) AS fingerprint, count(*) AS tries, round(max(value), 6) AS best, round(max(value) - min(value), 6) AS spread, count(*) >= 2 AND max(value) - min(value) < 0.02 AS no_progress FROM e GROUP BY 1")
def opt22_measured_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score, spread and lack of progress of each configuration (events stand for trials)."""
    e = table(spark, sf_dir, "events").select(F.substring(F.sha2(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")), 256), 1, 12).alias("fingerprint"), "value")
    spread = F.max("value") - F.min("value")
    return e.groupBy("fingerprint").agg(F.count("*").alias("tries"), F.round(F.max("value"), 6).alias("best"), F.round(spread, 6).alias("spread"), ((F.count("*") >= 2) & (spread < optimize.MIN_DELTA)).alias("no_progress"))
