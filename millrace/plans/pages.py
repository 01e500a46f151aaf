"""Page-text queries, judged metrics, and report aggregates over the remaining tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import judged, preprocess
from ..runtime import table
from .corpus import CHUNKS_SQL, chunks
from .registry import query

_PAGES_SQL = "pg AS (SELECT doc_id, unnest(string_split(text, E'\\n\\n')) AS page, unnest(range(0, len(string_split(text, E'\\n\\n')))) AS page_no FROM documents WHERE text IS NOT NULL)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.pages_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'([A-Za-z])-\n([a-z])', '\1\2', 'g'), E'([가-힣])\n([가-힣])', '\1 \2', 'g'), E'([가-힣])\n([가-힣])', '\1 \2', 'g'), '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), E'[ \t]+(\n|$)', '\1', 'g'), E'\n{3,}', E'\n\n', 'g')) AS hash FROM documents WHERE text IS NOT NULL""")
def txt02_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after clean-up."""
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(preprocess.clean_body(F.col("text")), 256).alias("hash"))


@query("WITH " + _PAGES_SQL + r""", ls AS (SELECT doc_id, page_no, list_filter(string_split(page, E'\n'), lambda x: trim(x, E' \t\n\r') <> '') AS l FROM pg), n AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT doc_id, 'first' AS place, l[1] AS x FROM ls WHERE len(l) > 0 UNION ALL SELECT doc_id, 'last', l[-1] FROM ls WHERE len(l) > 1),
c AS (SELECT doc_id, place, lower(trim(regexp_replace(x, '[0-9]+', '#', 'g'), E' \t\n\r')) AS line, count(*) AS cnt FROM e WHERE length(x) <= 80 GROUP BY 1, 2, 3)
SELECT doc_id, place, line, cnt AS pages FROM c JOIN n USING (doc_id) WHERE cnt >= greatest(3, floor(pages * 0.6))""")
def txt04_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running headers and footers."""
    return preprocess.repeated_lines(_pages(spark, sf_dir), "doc_id")


@query("WITH " + _PAGES_SQL + ", s AS (SELECT doc_id, page_no, length(page) AS n, sum(length(page) + 2) OVER (PARTITION BY doc_id ORDER BY page_no) - 2 AS e FROM pg) SELECT doc_id, page_no, e - n AS page_start, e AS page_end FROM s")
def txt06_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of pages in their assembled document."""
    return preprocess.spans(_pages(spark, sf_dir), "doc_id")


@query("WITH" + CHUNKS_SQL + ", " + _PAGES_SQL + """, sp AS (SELECT doc_id, page_no, sum(length(page) + 2) OVER (PARTITION BY doc_id ORDER BY page_no) - 2 - length(page) AS page_start FROM pg)
SELECT c.doc_id, c.draft_no, max(page_no) AS page_no FROM chunks c LEFT JOIN sp ON sp.doc_id = c.doc_id AND page_start <= c.start_pos GROUP BY 1, 2""")
def txt08_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which each chunk starts."""
    c = chunks(spark, sf_dir).select("doc_id", "draft_no", "start_pos")
    return preprocess.page_of(c, preprocess.spans(_pages(spark, sf_dir), "doc_id"), "doc_id", "start_pos").select("doc_id", "draft_no", "page_no")


@query(r"""SELECT doc_id, CASE WHEN lower(trim(metadata['document_type'], E' \t\n\r')) IN ('math', 'finance_table', 'policy', 'other') THEN lower(trim(metadata['document_type'], E' \t\n\r')) ELSE 'general' END AS document_type, length(trim(coalesce(content, ''), E' \t\n\r')) < 50 * 3 AS scanned FROM (SELECT DISTINCT ON (doc_id) * FROM raw_docs ORDER BY doc_id, ingested_at DESC)""")
def txt11_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared document types, and whether three pages with so little text would be images."""
    d = table(spark, sf_dir, "raw_docs").groupBy("doc_id").agg(F.max_by(F.struct("metadata", "content"), "ingested_at").alias("d")).select("doc_id", "d.*")
    return d.select("doc_id", preprocess.document_type(F.col("metadata")["document_type"]).alias("document_type"), preprocess.is_scanned(F.col("content"), F.lit(3)).alias("scanned"))


_VERDICTS = "v AS (SELECT log_id, coalesce(c.rank_no, i) AS rank, (log_id * 7 + i * 3) % 5 < 3 AS verdict FROM (SELECT log_id, unnest(any_value(contexts)) AS c, unnest(range(1, len(any_value(contexts)) + 1)) AS i FROM rag_logs WHERE len(contexts) > 0 GROUP BY log_id))"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "rag_logs").filter(F.size("contexts") > 0).groupBy("log_id").agg(F.any_value("contexts").alias("c")).select("log_id", F.posexplode("c").alias("i", "c"))
    return d.select("log_id", F.coalesce("c.rank_no", F.col("i") + 1).alias("rank"), F.expr("(log_id * 7 + (i + 1) * 3) % 5 < 3").alias("verdict"))


@query("WITH " + _VERDICTS + ", u AS (SELECT log_id, verdict, rank FROM v), p AS (SELECT log_id, CAST(verdict AS INT) AS x, sum(CAST(verdict AS INT)) OVER w / row_number() OVER w * CAST(verdict AS INT) AS p FROM u WINDOW w AS (PARTITION BY log_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) SELECT log_id, round(avg(x), 6) AS faithfulness, round(sum(p) / (sum(x) + 1e-10), 6) AS context_precision FROM p GROUP BY 1")
def met24_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faithfulness and average precision from verdicts (arithmetic stand-ins for a judge's)."""
    v = _verdicts(spark, sf_dir)
    out = judged.faithfulness(v, "log_id").join(judged.context_precision(v, "log_id"), "log_id")
    return out.select("log_id", F.round("faithfulness", 6).alias("faithfulness"), F.round("context_precision", 6).alias("context_precision"))


@query("""WITH r AS (SELECT DISTINCT log_id, CASE WHEN log_id % 5 = 0 THEN NULL ELSE log_id % 4 END AS tp, CASE WHEN log_id % 5 = 0 THEN NULL ELSE log_id % 3 END AS fp, CASE WHEN log_id % 5 = 0 THEN NULL ELSE log_id % 2 END AS fn, CASE WHEN log_id % 7 = 0 THEN NULL ELSE (log_id % 11 - 2) / 10.0 END AS cs FROM rag_logs),
f AS (SELECT log_id, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + 0.5 * (fp + fn)) WHEN tp IS NOT NULL THEN 0.0 END AS fa, CASE WHEN cs IS NOT NULL THEN greatest(cs, 0) END AS n FROM r)
SELECT log_id, round(CASE WHEN fa IS NULL THEN n WHEN n IS NULL THEN fa ELSE 0.75 * fa + 0.25 * n END, 6) AS correctness FROM f""")
def met25_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer correctness from claim counts and a similarity."""
    r = table(spark, sf_dir, "rag_logs").select("log_id").distinct()
    e = F.expr
    tp, fp, fn = (e(f"CASE WHEN log_id % 5 = 0 THEN NULL ELSE log_id % {k} END") for k in (4, 3, 2))
    return r.select("log_id", F.round(judged.correctness(tp, fp, fn, e("CASE WHEN log_id % 7 = 0 THEN NULL ELSE (log_id % 11 - 2) / 10.0D END")), 6).alias("correctness"))


@query("""WITH k AS (SELECT DISTINCT doc_id, draft_no, text FROM chunk_drafts WHERE doc_id IS NOT NULL AND length(text) >= 3), p AS (SELECT a.doc_id, a.draft_no, a.text AS x, b.text AS y FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.draft_no = a.draft_no + 1),
b AS (SELECT doc_id, draft_no, regexp_replace(x, '[ \\t\\n\\r]+', '', 'g') AS x, regexp_replace(y, '[ \\t\\n\\r]+', '', 'g') AS y FROM p),
g AS (SELECT doc_id, draft_no, list_distinct(list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: substring(x, i, 3))) AS gx, list_distinct(list_transform(range(1, greatest(length(y) - 2, 1) + 1), lambda i: substring(y, i, 3))) AS gy FROM b)
SELECT doc_id, draft_no, round(len(list_intersect(gx, gy)) / CAST(len(list_distinct(list_concat(gx, gy))) AS DOUBLE), 6) AS similarity FROM g""")
def met21_neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-triple Jaccard of neighbouring drafts."""
    k = table(spark, sf_dir, "chunk_drafts").filter((F.col("doc_id").isNotNull()) & (F.length("text") >= 3)).select("doc_id", "draft_no", "text").distinct()
    b = k.select("doc_id", (F.col("draft_no") - 1).alias("draft_no"), F.col("text").alias("other"))
    return k.join(b, ["doc_id", "draft_no"]).select("doc_id", "draft_no", F.round(judged.trigram_jaccard(F.col("text"), F.col("other")), 6).alias("similarity"))


@query("""WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events) SELECT user_id, count(*) AS snapshots, round(max(delta), 6) AS best_gain, round(min(delta), 6) AS worst_loss, round(max_by(value, event_id), 6) AS latest FROM s GROUP BY 1""")
def agg30_snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score deltas of consecutive snapshots (events stand for snapshots of a run)."""
    w = W.Window.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("value") - F.lag("value").over(w)).alias("delta"))
    return s.groupBy("user_id").agg(F.count("*").alias("snapshots"), F.round(F.max("delta"), 6).alias("best_gain"), F.round(F.min("delta"), 6).alias("worst_loss"), F.round(F.max_by("value", "event_id"), 6).alias("latest"))


_LABELS = ["click", "error", "purchase", "signup", "view"]


@query("WITH e AS (SELECT user_id % 50 AS run_id, event_type, count(*) AS n, max(value) AS best FROM events GROUP BY 1, 2) SELECT run_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{x}' THEN n ELSE 0 END) AS BIGINT) AS n_{x}" for x in _LABELS) + ", round(max(best), 6) AS best FROM e GROUP BY 1")
def snk11_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per label for each run, for all labels that there are; the driver sees the labels, at most ``spark.sql.pivotMaxValues`` of them, beyond which Spark refuses."""
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 50).withColumn("label", F.concat(F.lit("n_"), F.col("event_type")))
    n = e.groupBy("run_id").pivot("label").agg(F.count("event_id")).fillna(0)
    return n.join(e.groupBy("run_id").agg(F.round(F.max("value"), 6).alias("best")), "run_id")


@query("""WITH c AS (SELECT chunk_id, list_sort(list_distinct(list_filter(entities, lambda x: x IS NOT NULL AND x <> ''))) AS e FROM (SELECT DISTINCT chunk_id, entities FROM kg_nodes WHERE len(entities) > 0)), x AS (SELECT DISTINCT chunk_id, unnest(e) AS entity FROM c),
nodes AS (SELECT count(DISTINCT entity) AS entities, count(*) AS mentions FROM x), co AS (SELECT count(*) AS pairs FROM (SELECT DISTINCT a.entity, b.entity FROM x a JOIN x b ON a.chunk_id = b.chunk_id AND a.entity < b.entity)) SELECT entities, mentions, pairs FROM nodes, co""")
def agg23_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, mentions and distinct co-occurring pairs of the knowledge graph."""
    k = table(spark, sf_dir, "kg_nodes").filter(F.size("entities") > 0).select("chunk_id", F.explode("entities").alias("entity")).filter("entity is not null and entity <> ''").distinct()
    pairs = k.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("e")).select(F.posexplode("e").alias("i", "a"), "e").select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    counts = k.agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("mentions"))
    return counts.crossJoin(pairs.distinct().agg(F.count("*").alias("pairs")))


@query("""SELECT doc_id, substring(sha1(string_agg(chunk_id || ':' || substring(sha256(text), 1, 16), '|' ORDER BY chunk_id, substring(sha256(text), 1, 16))), 1, 12) AS fingerprint, count(*) AS chunks FROM (SELECT DISTINCT doc_id, chunk_id, text FROM chunk_rows WHERE chunk_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1""")
def idn_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document's chunks in an index."""
    c = table(spark, sf_dir, "chunk_rows").filter("chunk_id is not null and text is not null").select("doc_id", "chunk_id", F.xxhash64("text").alias("_t"), F.substring(F.sha2("text", 256), 1, 16).alias("h")).distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "h"))), lambda x: F.concat(x["chunk_id"], F.lit(":"), x["h"])), "|")
    return c.groupBy("doc_id").agg(F.substring(F.sha1(joined), 1, 12).alias("fingerprint"), F.count("*").alias("chunks"))
