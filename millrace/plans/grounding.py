"""Queries that join evidence, retrieval and findings: covers, quotes, misses, hashed vectors, the search path, reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import hashed
from ..functions import text as T
from ..operators import diagnose, grounding, optimize, retrieval
from ..runtime import table
from .evidence import _places, _spans
from .logs import LOGS_SQL, logs
from .records import _F, _RULES, records
from .registry import query

_SENTENCE_SQL = r"""unnest(string_split(regexp_replace(text, '([.!?。？！\n])[ \t\n\r\f\x0B]+', E'\\1\x01', 'g'), chr(1)))"""


@query()
def jn06_minimal_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stand for each gold span, anew for these chunks."""
    c = _places(spark, sf_dir).select(F.format_string("%05d", "draft_no").alias("chunk_id"), "doc_id", "c_start", "c_end")
    return grounding.minimal_cover(_spans(spark, sf_dir), c)


@query("""WITH d AS (SELECT DISTINCT doc_id, draft_no, text, start_pos, end_pos FROM chunk_drafts WHERE doc_id IS NOT NULL AND length(text) > 60), b AS (SELECT doc_id, arg_max(content, (ingested_at, content)) AS content FROM raw_docs GROUP BY 1),
q AS (SELECT d.*, content, CASE WHEN draft_no % 3 = 0 THEN substring(text, 11, 40) WHEN draft_no % 3 = 1 THEN substring(content, start_pos + 6, 30) ELSE 'nowhere to be found' END AS quote FROM d JOIN b USING (doc_id)),
p AS (SELECT *, strpos(text, quote) AS own, strpos(substring(content, start_pos + 1, end_pos - start_pos), quote) AS near FROM q), r AS (SELECT *, CASE WHEN length(quote) = 0 THEN NULL WHEN own > 0 THEN start_pos + own - 1 WHEN near > 0 THEN start_pos + near - 1 END AS at_ FROM p)
SELECT doc_id, draft_no, CAST(coalesce(at_, start_pos) AS INT) AS start, CAST(CASE WHEN at_ IS NULL THEN end_pos ELSE at_ + length(quote) END AS INT) AS "end", CASE WHEN at_ IS NULL THEN 'chunk_fallback' ELSE 'exact' END AS quality FROM r""")
def jn08_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes of drafts and of their documents stand, and how well that is known."""
    d = table(spark, sf_dir, "chunk_drafts").filter("doc_id is not null and length(text) > 60").select("doc_id", "draft_no", "text", "start_pos", "end_pos").distinct()
    b = table(spark, sf_dir, "raw_docs").groupBy("doc_id").agg(F.max(F.struct("ingested_at", "content"))["content"].alias("content"))
    n = F.col("draft_no") % 3
    q = d.join(b, "doc_id").withColumn("quote", F.when(n == 0, F.substring("text", 11, 40)).when(n == 1, F.expr("substring(content, start_pos + 6, 30)")).otherwise("nowhere to be found"))
    return q.select("doc_id", "draft_no", grounding.quote_span(F.col("quote"), F.col("text"), F.col("start_pos"), F.col("content"), F.col("end_pos")).alias("s")).select("doc_id", "draft_no", "s.*")


@query("WITH " + LOGS_SQL + """, g AS (SELECT log_id, gold, list_transform(coalesce(contexts, []), lambda c: coalesce(c.text, '')) AS t FROM l WHERE len(gold) > 0)
SELECT log_id, len(gold) AS n_gold, len(list_filter(gold, lambda g: len(list_filter(t, lambda x: contains(x, g))) = 0)) AS n_missed, round(1 - len(list_filter(gold, lambda g: len(list_filter(t, lambda x: contains(x, g))) = 0)) / len(gold), 6) AS recall FROM g""")
def jn09_missed_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold paragraphs that no retrieved context holds, and the recall that follows."""
    g = logs(spark, sf_dir).filter(F.size("gold") > 0).select("log_id", "gold", F.transform(F.coalesce("contexts", F.array().cast("array<struct<text:string,chunk_id:string,score:double,rank_no:int,source_doc:string>>")), lambda c: F.coalesce(c["text"], F.lit(""))).alias("t"))
    out = F.filter("gold", lambda x: ~F.exists("t", lambda y: F.contains(y, x)))
    return g.select("log_id", F.size("gold").alias("n_gold"), F.size(out).alias("n_missed"), F.round(1 - F.size(out) / F.size("gold"), 6).alias("recall"))


@query("WITH " + LOGS_SQL + """, c AS (SELECT log_id, unnest(contexts).chunk_id AS chunk_id, unnest(range(1, len(contexts) + 1)) AS place FROM l WHERE len(contexts) > 0), k AS (SELECT chunk_id, min(text) AS text FROM kg_nodes WHERE text IS NOT NULL GROUP BY 1)
SELECT log_id, count(*) AS n_contexts, sha256(string_agg(text, chr(10) ORDER BY place)) AS hash FROM c JOIN k USING (chunk_id) GROUP BY 1""")
def jn19_oracle_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of given chunks in their order; those that the index hasn't are left out."""
    c = logs(spark, sf_dir).filter(F.size("contexts") > 0).select("log_id", F.posexplode("contexts").alias("place", "c")).select("log_id", "place", "c.chunk_id")
    k = table(spark, sf_dir, "kg_nodes").filter("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    t = c.join(k, "chunk_id").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return t.select("log_id", F.size("t").alias("n_contexts"), F.sha2(F.array_join(F.col("t")["text"], "\n"), 256).alias("hash"))


@query()
def met29_gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each gold paragraph the retrieved contexts cover."""
    l = logs(spark, sf_dir).select("log_id", "gold", F.transform("contexts", lambda c: c["text"]).alias("t"))  # noqa: E741
    return grounding.gold_coverage(l.filter(F.size("gold") > 0), "log_id", "gold", "t")


@query("WITH " + LOGS_SQL + """, c AS (SELECT log_id, list_transform(contexts, lambda x: coalesce(x.chunk_id, '')) AS ids, config IS NULL AS mmr FROM l WHERE len(contexts) > 0),
f AS (SELECT log_id, mmr, ids[1:2] AS final, list_reverse(ids) AS before FROM c) SELECT log_id, CASE WHEN NOT mmr THEN len(list_filter(final, lambda x: NOT coalesce(list_contains(before[1:len(final)], x), false))) END AS n_promoted FROM f""")
def met19_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker (standing for it: the list turned round) newly brought into the first two; null where MMR made the cut."""
    f = logs(spark, sf_dir).filter(F.size("contexts") > 0).select("log_id", F.transform("contexts", lambda c: F.coalesce(c["chunk_id"], F.lit(""))).alias("ids"), F.col("config").isNull().alias("mmr"))
    p = grounding.promoted(F.slice("ids", 1, 2), F.reverse("ids"), F.col("mmr"))
    raw = F.filter(p, lambda x: x.isNotNull())
    return f.select("log_id", F.when(p.isNotNull(), F.size(raw)).alias("n_promoted"))


@query()
def ret04_sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse vector of every node."""
    k = table(spark, sf_dir, "kg_nodes").filter("text is not null").select("chunk_id", "text").distinct()
    return k.select("chunk_id", hashed.sparse_vector(F.col("text")).alias("v")).select("chunk_id", "v.*")


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = logs(spark, sf_dir).filter("question is not null").select(F.col("log_id").alias("query_id"), "question")
    c = retrieval.spread(table(spark, sf_dir, "kg_nodes").filter("text is not null").select("chunk_id", "text"), "chunk_id").groupBy("chunk_id").agg(F.min("text").alias("chunk_text"))
    return q.withColumn("embedding", hashed.dense_vector(F.col("question"))), c.withColumn("embedding", hashed.dense_vector(F.col("chunk_text")))


@query()
def ret11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions of the logs against all nodes by both channels, hashed vectors and keywords, fused, and cut by MMR."""
    q, c = _channels(spark, sf_dir)
    return retrieval.search(q, c, 5, mmr_weight=0.7)


@query("WITH d AS (SELECT doc_id, " + _SENTENCE_SQL + " AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n, sha256(string_agg(s, '|' ORDER BY s)) AS hash FROM d WHERE length(s) > 0 GROUP BY 1")
def txt15_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut behind marks that white space follows, by pattern alone."""
    s = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.filter(T.rough_sentences(F.col("text")), lambda x: x != "").alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join(F.array_sort("s"), "|"), 256).alias("hash"))


@query("WITH " + LOGS_SQL + """, d AS (SELECT log_id, list_transform(contexts, lambda c: coalesce(c.source_doc, '')) AS d FROM l WHERE len(contexts) > 0)
SELECT log_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS docs FROM d""")
def set05_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a log's contexts, each at its first place."""
    return logs(spark, sf_dir).filter(F.size("contexts") > 0).select("log_id", F.array_join(F.array_distinct(F.transform("contexts", lambda c: F.coalesce(c["source_doc"], F.lit("")))), ",").alias("docs"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, n, k, kind, n * share AS raw FROM n, (VALUES (0, 'synthesised', 0.75), (1, 'persona', 0.2), (2, 'no_answer', 0.05)) t(k, kind, share)),
f AS (SELECT *, floor(round(raw, 9)) AS fl FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(raw - fl, 9) DESC, k) AS place, n - sum(fl) OVER (PARTITION BY user_id) AS rest FROM f)
SELECT user_id, kind, CAST(CASE WHEN n < 8 THEN CASE WHEN k = 0 THEN n ELSE 0 END ELSE fl + CASE WHEN place <= rest THEN 1 ELSE 0 END END AS BIGINT) AS share FROM p""")
def top05_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test set's size cut into kinds of questions, for sets of many sizes."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(optimize.budget(F.col("n"))).alias("b")).select("user_id", "b.*")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), i AS (SELECT user_id, n, unnest(range(0, least(n, 7))) AS i FROM n)
SELECT user_id, CAST(i AS INT) AS i, CAST(CASE WHEN n <= 7 THEN i ELSE round_even(i * (n - 1) / 6.0, 0) END AS BIGINT) AS place FROM i""")
def top02_even_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven places spread evenly over a list, halves to the even neighbour."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.posexplode(optimize.even_places(F.col("n"), 7)).alias("i", "place"))


@query("WITH " + LOGS_SQL + """, t AS (SELECT app_id, count(*) AS calls, sum(latency_ms) FILTER (WHERE latency_ms >= 0) AS ms FROM l GROUP BY 1) SELECT app_id, calls, coalesce(ms, 0) AS ms, round(CASE WHEN sum(ms) OVER () > 0 THEN coalesce(ms, 0) / sum(ms) OVER () ELSE 0 END, 6) AS share FROM t""")
def agg10_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spent in each application, and its share of all; latencies that weren't measured (null, -1) count nothing."""
    t = logs(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), F.lit(0)).alias("ms"))
    total = t.agg(F.sum("ms").alias("_all"))  # one row
    return t.crossJoin(F.broadcast(total)).select("app_id", "calls", "ms", F.round(F.when(F.col("_all") > 0, F.col("ms") / F.col("_all")).otherwise(0.0), 6).alias("share"))


@query("WITH" + _F + "SELECT label, min(probe_id) AS first_probe, count(DISTINCT probe_id) AS probes, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE NOT confirmed) AS tentative FROM findings GROUP BY 1")
def agg27_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per label: its first probe, and how many confirm it."""
    f = diagnose.diagnose(records(spark, sf_dir)).groupBy("label", "probe_id").agg(F.count_if("confirmed").alias("c"), F.count_if(~F.col("confirmed")).alias("t"))
    return f.groupBy("label").agg(F.min("probe_id").alias("first_probe"), F.count("*").alias("probes"), F.sum("c").alias("confirmed"), F.sum("t").alias("tentative"))


@query("WITH" + _F + ", " + LOGS_SQL.replace("l AS", "lg AS", 1) + """, dc AS (SELECT DISTINCT CAST(log_id AS VARCHAR) AS probe_id, unnest(contexts).source_doc AS doc FROM lg), lp AS (SELECT DISTINCT label, probe_id FROM findings)
SELECT label, count(DISTINCT lp.probe_id) AS probes, count(DISTINCT doc) AS documents FROM lp LEFT JOIN dc USING (probe_id) GROUP BY 1""")
def agg26_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the probes of each label touched."""
    f = diagnose.diagnose(records(spark, sf_dir)).select("label", "probe_id").distinct()
    d = logs(spark, sf_dir).select(F.col("log_id").cast("string").alias("probe_id"), F.explode("contexts").alias("c")).select("probe_id", F.col("c.source_doc").alias("doc")).filter("doc is not null").distinct()
    n = f.groupBy("label").agg(F.count("*").alias("probes"))
    docs = f.join(d, "probe_id").select("label", "doc").distinct().groupBy("label").agg(F.count("*").alias("documents"))
    return n.join(docs, "label", "left").select("label", "probes", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("WITH " + _RULES + "SELECT path, count(DISTINCT action) AS actions, string_agg(DISTINCT action, ',' ORDER BY action) AS names FROM rules WHERE path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT action) > 1")
def agg32_competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that more than one action patches."""
    r = optimize.prescriptions(table(spark, sf_dir, "region")).filter("path is not null").select("path", "action").distinct()
    return r.groupBy("path").agg(F.count("*").alias("actions"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("names")).filter("actions > 1")


@query("WITH " + LOGS_SQL + """, e AS (SELECT app_id, min(log_id) AS a, max(log_id) AS b FROM l WHERE cardinality(config) > 0 GROUP BY 1), x AS (SELECT e.app_id, unnest(map_entries(config)) AS kv FROM e JOIN l ON l.log_id = e.a AND l.app_id = e.app_id),
y AS (SELECT e.app_id, unnest(map_entries(config)) AS kv FROM e JOIN l ON l.log_id = e.b AND l.app_id = e.app_id) SELECT coalesce(x.app_id, y.app_id) AS app_id, coalesce(x.kv.key, y.kv.key) AS key, x.kv.value AS before, y.kv.value AS after FROM x FULL JOIN y ON x.app_id = y.app_id AND x.kv.key = y.kv.key WHERE x.kv.value IS DISTINCT FROM y.kv.value""")
def opt25_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between the first and the last configuration of each application."""
    c = logs(spark, sf_dir).filter(F.size("config") > 0).groupBy("app_id").agg(F.min_by("config", "log_id").alias("a"), F.max_by("config", "log_id").alias("b"))
    return optimize.config_diff(c, ["app_id"], "a", "b")


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS tried FROM events GROUP BY 1) SELECT user_id, failures, tried FROM u WHERE failures >= 2""")
def opt24_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed twice and is left alone (events stand for trials)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count("*").alias("tried")).filter("failures >= 2")


@query("""WITH t AS (SELECT user_id, event_id, event_type, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS base FROM events), k AS (SELECT user_id, any_value(base) AS base, max([value, -event_id]) FILTER (WHERE event_type <> 'error') AS best, count(DISTINCT event_type) AS settings FROM t GROUP BY 1)
SELECT user_id, settings, CASE WHEN best IS NOT NULL AND best[1] - base >= 0.02 THEN CAST(-best[2] AS BIGINT) END AS winner FROM k""")
def opt33_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial of a sweep if it beats its baseline, the first (events stand for trials, errors for those that didn't complete)."""
    e = table(spark, sf_dir, "events")
    done = F.when(F.col("event_type") != "error", F.struct("value", (-F.col("event_id")).alias("id")))
    k = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("base"), F.max(done).alias("best"), F.count_distinct("event_type").alias("settings"))
    return k.select("user_id", "settings", F.when(F.col("best.value") - F.col("base") >= optimize.MIN_DELTA, -F.col("best.id")).alias("winner"))


@query("WITH " + LOGS_SQL + """, p AS (SELECT log_id, unnest(contexts).text AS question, unnest(range(0, len(contexts))) AS i FROM l WHERE len(contexts) > 0) SELECT log_id || '_q' || i AS probe_id, length(question) AS n FROM p WHERE length(trim(question, E' \\t\\n\\r')) > 0""")
def sup08_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given texts as probes: blank ones are dropped, the others keep the number of their place."""
    p = logs(spark, sf_dir).filter(F.size("contexts") > 0).select("log_id", F.posexplode("contexts").alias("i", "c")).select("log_id", "i", F.col("c.text").alias("question"))
    return p.filter(F.length(F.btrim("question", F.lit(" \t\n\r"))) > 0).select(F.concat("log_id", F.lit("_q"), "i").alias("probe_id"), F.length("question").alias("n"))


@query("WITH " + LOGS_SQL + " SELECT app_id, count(*) AS records, coalesce(bool_and(len(list_filter(contexts, lambda c: c.score IS NULL)) = 0), true) AS complete FROM l WHERE len(contexts) > 0 GROUP BY 1")
def sup13_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all records of an application were scored."""
    l = logs(spark, sf_dir).filter(F.size("contexts") > 0)  # noqa: E741
    return l.groupBy("app_id").agg(F.count("*").alias("records"), F.bool_and(~F.exists("contexts", lambda c: c["score"].isNull())).alias("complete"))


@query("SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS pending, max(event_id) AS last FROM events GROUP BY 1")
def sup18_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest pending item and the latest of all (events stand for the history)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("pending"), F.max("event_id").alias("last"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS p FROM n) SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY p) AS top FROM r WHERE p <= 3 GROUP BY 1""")
def sup21_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent kinds as text."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = n.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))), 1, 3).alias("s"))
    return s.select("user_id", F.array_join(F.transform("s", lambda x: F.concat(x["event_type"], F.lit("="), (-x["m"]).cast("string"))), ", ").alias("top"))


@query("WITH" + _F + ", ba AS (SELECT label, probe_id, probe_id::INT % 2 AS half FROM findings) SELECT DISTINCT x.label, x.probe_id FROM ba x WHERE half = 0 AND NOT EXISTS (SELECT 1 FROM ba y WHERE y.half = 1 AND y.label = x.label AND y.probe_id::INT = x.probe_id::INT + 1)")
def set06_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that were found before and not after (even probes stand for before, the next odd one for after)."""
    b = diagnose.diagnose(records(spark, sf_dir)).select("label", F.col("probe_id").cast("int").alias("p")).distinct()
    before, after = b.filter("p % 2 = 0"), b.filter("p % 2 = 1").select("label", (F.col("p") - 1).alias("p"))
    return before.join(after, ["label", "p"], "left_anti").select("label", F.col("p").cast("string").alias("probe_id"))
