"""Queries over external logs: intake, capability, answer matching, replay labels, records and their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diagnose
from ..runtime import table
from .registry import query

_SPACE_IN, _PUNCT = T.AS_SPACE.replace("'", "''"), T.PUNCTUATION.replace("'", "''")
LOGS_SQL = "l AS (SELECT log_id, any_value(app_id) AS app_id, min(question) AS question, min(answer) AS answer, min(ground_truth) AS truth, any_value(contexts) AS contexts, any_value(gold_contexts) AS gold, any_value(config) AS config, min(feedback) AS feedback, min(latency_ms) AS latency_ms FROM rag_logs GROUP BY log_id)"
#: The characters of a normal answer, for the SQL of answer matching.
CHARS_SQL = f"""norm(x) AS trim(regexp_replace(translate(lower(translate(coalesce(x, ''), '{_SPACE_IN}', '{" " * len(T.AS_SPACE)}')), '{_PUNCT}', ''), '[ \\t\\n\\r]+', ' ', 'g'))"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log once."""
    d = table(spark, sf_dir, "rag_logs")
    return d.groupBy("log_id").agg(*(F.min(c).alias(a) for c, a in (("question", "question"), ("answer", "answer"), ("ground_truth", "truth"), ("feedback", "feedback"), ("latency_ms", "latency_ms"))), *(F.any_value(c).alias(a) for c, a in (("app_id", "app_id"), ("contexts", "contexts"), ("gold_contexts", "gold"), ("config", "config"))))


@query("WITH " + LOGS_SQL + """ SELECT app_id, count(*) AS records, count(*) FILTER (WHERE len(contexts) > 0) AS with_contexts, count(*) FILTER (WHERE len(list_filter(contexts, lambda c: c.score IS NOT NULL)) > 0) AS with_scores,
count(*) FILTER (WHERE cardinality(config) > 0) AS with_config, count(*) FILTER (WHERE feedback IS NOT NULL) AS with_feedback, count(*) FILTER (WHERE coalesce(truth, '') <> '') AS with_truth, count(*) FILTER (WHERE len(gold) > 0) AS with_gold,
CASE WHEN 2 * count(*) FILTER (WHERE len(contexts) > 0) >= count(*) THEN 'triad' ELSE 'qa_only' END AS tier FROM l GROUP BY app_id""")
def agg01_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be diagnosed from each application's log."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    with_contexts = n(F.size("contexts") > 0)
    return logs(spark, sf_dir).groupBy("app_id").agg(
        F.count("*").alias("records"), with_contexts.alias("with_contexts"), n(F.exists("contexts", lambda x: x["score"].isNotNull())).alias("with_scores"), n(F.size("config") > 0).alias("with_config"),
        n(F.col("feedback").isNotNull()).alias("with_feedback"), n(F.col("truth") != "").alias("with_truth"), n(F.size("gold") > 0).alias("with_gold"), F.when(2 * with_contexts >= F.count("*"), "triad").otherwise("qa_only").alias("tier"),
    )


@query("WITH " + LOGS_SQL + """, c AS (SELECT app_id, list_sort(list_transform(map_entries(config), lambda e: e.key || '=' || coalesce(e.value, ''))) AS c FROM l WHERE cardinality(config) > 0)
SELECT app_id, count(DISTINCT c) AS n_configs, CASE WHEN count(DISTINCT c) = 1 THEN array_to_string(min(c), ';') ELSE '' END AS config FROM c GROUP BY 1""")
def agg02_representative_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration that stands for a log, only if all its records agree."""
    flat = F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    c = logs(spark, sf_dir).filter(F.size("config") > 0).select("app_id", flat.alias("c")).groupBy("app_id", "c").agg(F.lit(1).alias("_"))
    return c.groupBy("app_id").agg(F.count("*").alias("n_configs"), F.when(F.count("*") == 1, F.array_join(F.min("c"), ";")).otherwise("").alias("config"))


@query("WITH " + LOGS_SQL + """, x AS (SELECT log_id, unnest(contexts) AS c FROM l) SELECT log_id, count(*) AS n, count(*) FILTER (WHERE trim(c.text) <> '') AS kept, round(max(c.score), 6) AS best, count(*) FILTER (WHERE c.chunk_id IS NULL) AS without_id, sum(length(c.text)) FILTER (WHERE trim(c.text) <> '') AS chars FROM x GROUP BY 1""")
def prj04_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of each log with blank texts dropped."""
    x = logs(spark, sf_dir).select("log_id", F.explode("contexts").alias("c"))
    kept = F.trim("c.text") != ""
    return x.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.round(F.max("c.score"), 6).alias("best"), F.count_if(F.col("c.chunk_id").isNull()).alias("without_id"), F.sum(F.when(kept, F.length("c.text"))).alias("chars"))


@query("WITH " + LOGS_SQL + """ SELECT log_id, CASE WHEN question IS NULL OR trim(question, E' \\t\\n\\r') = '' THEN 'no question' WHEN answer IS NULL OR trim(answer, E' \\t\\n\\r') = '' THEN 'no answer' END AS reason FROM l WHERE question IS NULL OR answer IS NULL OR trim(question, E' \\t\\n\\r') = '' OR trim(answer, E' \\t\\n\\r') = ''""")
def prj06_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that lack a required field."""
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c), F.lit(" \t\n\r")) == "")
    return logs(spark, sf_dir).withColumn("reason", F.when(blank("question"), "no question").when(blank("answer"), "no answer")).filter("reason is not null").select("log_id", "reason")


@query("WITH " + LOGS_SQL + """, q AS (SELECT lower(regexp_replace(trim(question), '\\s+', ' ', 'g')) AS q, truth, row_number() OVER (PARTITION BY lower(regexp_replace(trim(question), '\\s+', ' ', 'g')) ORDER BY log_id DESC) AS r FROM l WHERE truth IS NOT NULL AND question IS NOT NULL),
k AS (SELECT q, truth FROM q WHERE r = 1)
SELECT l.log_id, coalesce(l.truth, k.truth) AS truth, CASE WHEN l.truth IS NULL AND k.truth IS NOT NULL THEN 'filled' WHEN l.truth <> k.truth THEN 'conflict' WHEN k.truth IS NULL THEN 'unmatched' ELSE 'kept' END AS state FROM l LEFT JOIN k ON lower(regexp_replace(trim(l.question), '\\s+', ' ', 'g')) = k.q""".replace("\\\\s", "\\s"))
def jn02_fill_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths from a golden set (last duplicate wins) fill logs that have none; others are kept and compared."""
    d = logs(spark, sf_dir).withColumn("q", F.lower(F.regexp_replace(F.trim("question"), "\\s+", " ")))
    golden = d.filter("truth is not null and q is not null").groupBy("q").agg(F.max_by("truth", "log_id").alias("gold_truth"))
    out = d.join(golden, "q", "left")
    state = F.when(F.col("truth").isNull() & F.col("gold_truth").isNotNull(), "filled").when(F.col("truth") != F.col("gold_truth"), "conflict").when(F.col("gold_truth").isNull(), "unmatched").otherwise("kept")
    return out.select("log_id", F.coalesce("truth", "gold_truth").alias("truth"), state.alias("state"))


_MATCH_SQL = "WITH " + LOGS_SQL + f""", n AS (SELECT log_id, trim(regexp_replace(translate(lower(translate(coalesce(answer, ''), '{_SPACE_IN}', '{" " * len(T.AS_SPACE)}')), '{_PUNCT}', ''), '[ \\t\\n\\r]+', ' ', 'g')) AS a,
trim(regexp_replace(translate(lower(translate(truth, '{_SPACE_IN}', '{" " * len(T.AS_SPACE)}')), '{_PUNCT}', ''), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM l WHERE truth IS NOT NULL),
c AS (SELECT log_id, a, t, string_split(replace(a, ' ', ''), '') AS p, string_split(replace(t, ' ', ''), '') AS r, length(replace(a, ' ', '')) AS np, length(replace(t, ' ', '')) AS nr FROM n),
s AS (SELECT *, CASE WHEN np = 0 OR nr = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(r), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) END AS same FROM c),
w AS (SELECT log_id, max(list_sum(list_transform(list_distinct(r), lambda x: least(len(list_filter(p[CAST(b + 1 AS BIGINT) : CAST(b + nr AS BIGINT)], lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) / CAST(nr AS DOUBLE)) AS best
  FROM (SELECT *, unnest(list_distinct(list_append(range(0, np - nr + 1, greatest(1, nr // 8)), np - nr))) AS b FROM s WHERE nr >= 30 AND np >= nr * 1.3) GROUP BY log_id)
"""


@query(_MATCH_SQL + """SELECT log_id, a = t AS exact, round(CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (np + nr) END, 6) AS f1, round(CASE WHEN nr = 0 THEN 0.0 ELSE same / CAST(nr AS DOUBLE) END, 6) AS recall,
round(CASE WHEN nr = 0 THEN 0.0 WHEN nr <= 10 THEN CASE WHEN same / CAST(nr AS DOUBLE) >= 0.9 THEN greatest(2.0 * same / (np + nr), same / CAST(nr AS DOUBLE)) WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (np + nr) END
WHEN w.best IS NOT NULL THEN greatest(2.0 * same / (np + nr), w.best) WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (np + nr) END, 6) AS match FROM s LEFT JOIN w USING (log_id)""")
def met06_answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match, character F1, recall and the mended match of every answer with its truth."""
    d = logs(spark, sf_dir).filter("truth is not null")
    both = F.struct(T.normal_answer(F.col("answer")).alias("a"), T.normal_answer(F.col("truth")).alias("t"), T.answer_chars(F.col("answer")).alias("p"), T.answer_chars(F.col("truth")).alias("r"))

    def scores(s: F.Column) -> F.Column:
        p, r = s["p"], s["r"]
        return F.struct((s["a"] == s["t"]).alias("exact"), F.round(T.char_f1(p, r), 6).alias("f1"), F.round(T.char_recall(p, r), 6).alias("recall"), F.round(T.answer_match(p, r), 6).alias("match"))

    return d.select("log_id", T.let(both, scores).alias("s")).select("log_id", "s.*")


_ABSTAIN_SQL = "(" + " OR ".join("contains(lower(answer), '" + m.replace("'", "''") + "')" for m in T.ABSTAINS + T.ABSTAINS_MORE) + ")"


@query("WITH " + LOGS_SQL + f""" SELECT app_id, count(*) AS n, count(*) FILTER (WHERE answer IS NULL OR trim(answer, E' \\t\\n\\r\u3000') = '' OR {_ABSTAIN_SQL}) AS abstained FROM l GROUP BY 1""")
def flt06_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that abstain, by application."""
    return logs(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("n"), F.count_if(T.abstains(F.col("answer"), more=True)).alias("abstained"))


#: Judge scores are inputs of the engine; in these queries they are arithmetic on the log's number.
SIGNALS = {
    "overlap": "CASE WHEN log_id % 4 = 0 THEN NULL ELSE (log_id % 11) / 10.0 END", "context_precision": "CASE WHEN log_id % 5 = 0 THEN NULL ELSE (log_id % 7) / 6.0 END", "faithfulness": "CASE WHEN log_id % 6 = 0 THEN NULL ELSE (log_id % 9) / 8.0 END",
    "relevancy": "CASE WHEN log_id % 7 = 0 THEN NULL ELSE (log_id % 13) / 12.0 END", "correctness": "CASE WHEN log_id % 3 = 0 THEN NULL ELSE (log_id % 10) / 9.0 END", "f1": "(log_id % 17) / 16.0", "context_chars": "(log_id % 23) * 600",
}
_SIG_SQL = ", ".join(f"{v} AS {k}" for k, v in SIGNALS.items())


@query("WITH " + LOGS_SQL + f""", r AS (SELECT log_id, (answer IS NULL OR trim(answer, E' \\t\\n\\r\u3000') = '' OR {_ABSTAIN_SQL}) AS abstains, {_SIG_SQL} FROM l),
p AS (SELECT *, (overlap IS NOT NULL OR context_precision IS NOT NULL) AS measured, coalesce(overlap >= 0.6, context_precision >= 0.34) AS reached, (coalesce(overlap < 0.6, false) OR coalesce(context_precision < 0.34, false)) AS failed, (coalesce(correctness >= 0.5, false) OR f1 >= 0.5) AS correct FROM r)
SELECT log_id, 'ext_wrongful_abstention' AS label, true AS confirmed FROM p WHERE abstains AND NOT correct AND measured AND reached
UNION ALL SELECT log_id, 'ext_retrieval_starved_abstention', true FROM p WHERE abstains AND NOT correct AND measured AND NOT reached
UNION ALL SELECT log_id, 'ext_retrieval_irrelevant', true FROM p WHERE NOT abstains AND failed
UNION ALL SELECT log_id, 'ext_answer_off_topic', NOT failed FROM p WHERE NOT abstains AND relevancy < 0.5
UNION ALL SELECT log_id, 'ext_generation_hallucination', coalesce(overlap >= 0.6, false) FROM p WHERE NOT abstains AND faithfulness < 0.5 AND coalesce(relevancy >= 0.5, true)
UNION ALL SELECT log_id, 'ext_context_overflow', true FROM p WHERE NOT abstains AND faithfulness < 0.5 AND context_chars > 6000
UNION ALL SELECT log_id, 'ext_grounded_but_wrong', NOT failed FROM p WHERE NOT abstains AND correctness < 0.5 AND faithfulness >= 0.5 AND coalesce(relevancy >= 0.5, true)""")
def dx_x_replay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven labels of foreign logs."""
    return diagnose.replay(logs(spark, sf_dir).select("log_id", T.abstains(F.col("answer"), more=True).alias("abstains"), *(F.expr(v).alias(k) for k, v in SIGNALS.items())))
