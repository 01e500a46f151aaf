"""Corpus queries: chunks, deduplication, page text, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..operators import chunking
from ..runtime import table
from .registry import query

_BLANKS = "'" + chunking.BLANKS + "'"
#: Chunks of 512 characters with 50 shared, as DuckDB makes them; a prefix of other queries' SQL.
CHUNKS_SQL = f"""
doc_ AS (SELECT doc_id, source, length(text) AS whole, length(text) - length(ltrim(text, {_BLANKS})) AS ahead, trim(text, {_BLANKS}) AS t FROM documents WHERE length(trim(text, {_BLANKS})) > 0),
win_ AS (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(0, length(t) - 512) / 462.0) AS BIGINT))) * 462 AS pos FROM doc_),
piece_ AS (SELECT *, substring(t, CAST(pos + 1 AS BIGINT), 512) AS piece FROM win_),
cut_ AS (SELECT *, ahead + pos + length(piece) - length(ltrim(piece, {_BLANKS})) AS start_pos, trim(piece, {_BLANKS}) AS chunk_text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS draft_no, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM piece_ WHERE length(trim(piece, {_BLANKS})) > 0),
chunks AS (SELECT doc_id, source, draft_no, CASE WHEN draft_no = 0 THEN 0 ELSE ahead + pos END AS raw_start, CASE WHEN following IS NULL THEN whole ELSE ahead + greatest(pos + 512, following) END AS raw_end, chunk_text, start_pos, start_pos + length(chunk_text) AS end_pos FROM cut_)
"""
TOKENS_SQL = "'[가-힣]+|[a-z][a-z0-9_+./-]*|[0-9]+(/[0-9]+)?'"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of all documents."""
    return chunking.fixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


@query("WITH" + CHUNKS_SQL + "SELECT doc_id, draft_no, raw_start, raw_end, start_pos, end_pos, substring(sha256(chunk_text), 1, 16) AS hash FROM chunks")
def chk01_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size chunks with exact coordinates."""
    return chunks(spark, sf_dir).select("doc_id", "draft_no", "raw_start", "raw_end", "start_pos", "end_pos", F.substring(F.sha2("chunk_text", 256), 1, 16).alias("hash"))


@query("WITH" + CHUNKS_SQL + r""", h AS (SELECT *, sha256(chunk_text) AS text_hash FROM chunks),
k2 AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id, draft_no) AS r, count(*) OVER (PARTITION BY text_hash) - 1 AS n_twins FROM h),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY draft_no) - 1 AS chunk_index FROM k2 WHERE r = 1)
SELECT v.doc_id || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(3, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0') AS chunk_id, v.doc_id, chunk_index, start_pos, end_pos, n_twins FROM v""")
def ddp03_chunk_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks deduplicated within and across documents, renumbered, with the number of their dropped twins."""
    keep, twins = chunking.dedup(chunks(spark, sf_dir), ["doc_id", "draft_no"])
    n = twins.groupBy("text_hash").agg(F.count("*").alias("n_twins"))
    out = chunking.number(keep, "doc_id", ["draft_no"]).join(n, "text_hash", "left")
    return out.select("chunk_id", "doc_id", "chunk_index", "start_pos", "end_pos", F.coalesce("n_twins", F.lit(0)).alias("n_twins"))


@query("WITH" + CHUNKS_SQL + r""", h AS (SELECT *, sha256(chunk_text) AS text_hash FROM chunks), k2 AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id, draft_no) AS r FROM h)
SELECT t.doc_id, t.raw_start, t.raw_end, s.doc_id AS kept_doc_id, s.draft_no AS kept_draft_no FROM k2 t JOIN k2 s ON s.text_hash = t.text_hash AND s.r = 1 WHERE t.r > 1""")
def ddp04_twin_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the dropped twins of a chunk stood before trimming, a row each; a text's survivor is one row, so Spark can split its twins."""
    keep, twins = chunking.dedup(chunks(spark, sf_dir), ["doc_id", "draft_no"])
    keep = keep.select("text_hash", F.col("doc_id").alias("kept_doc_id"), F.col("draft_no").alias("kept_draft_no"))
    return twins.join(keep, "text_hash").select("doc_id", "raw_start", "raw_end", "kept_doc_id", "kept_draft_no")


@query("""SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n_copies, count(*) - 1 AS skipped FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def ddp01_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content: the first in order survives."""
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("hash", F.sha2("text", 256))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).withColumn("skipped", F.col("n_copies") - 1)


@query("""SELECT doc_key, count(DISTINCT sha256(text)) AS n_hashes, count(*) AS n_rows FROM documents WHERE text IS NOT NULL AND doc_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1""")
def ddp02_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that came with different contents: these fail, the rest go on."""
    d = table(spark, sf_dir, "documents").filter("text is not null and doc_key is not null")
    # Distinct hashes first, so that a hot key is pre-aggregated before it meets in one task.
    per = d.groupBy("doc_key", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return per.groupBy("doc_key").agg(F.count("*").alias("n_hashes"), F.sum("n").alias("n_rows")).filter("n_hashes > 1")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS hash, revision, doc_key FROM documents WHERE text IS NOT NULL AND doc_key IS NOT NULL),
old AS (SELECT DISTINCT doc_key, hash FROM h WHERE revision = 0)
SELECT h.doc_id, h.doc_key, CASE WHEN old.hash IS NOT NULL THEN 'reused' ELSE 'computed' END AS state FROM h LEFT JOIN old ON h.doc_key = old.doc_key AND h.hash = old.hash WHERE h.revision > 0""")
def ddp06_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental indexing: what an earlier run of the same content made is reused, the rest computed."""
    h = table(spark, sf_dir, "documents").filter("text is not null and doc_key is not null").select("doc_id", F.sha2("text", 256).alias("hash"), "revision", "doc_key")
    old = h.filter("revision = 0").select("doc_key", "hash").distinct().withColumn("_was", F.lit(True))
    return h.filter("revision > 0").join(old, ["doc_key", "hash"], "left").select("doc_id", "doc_key", F.when(F.col("_was"), "reused").otherwise("computed").alias("state"))


@query("""WITH d AS (SELECT DISTINCT doc_id, draft_no, start_pos, end_pos, raw_start, raw_end FROM chunk_drafts WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, draft_no, coalesce(raw_start, start_pos) AS s, coalesce(raw_end, end_pos) AS e FROM d)
SELECT doc_id, draft_no, CASE WHEN lag(s) OVER w IS NULL THEN 0 ELSE s END AS raw_start, greatest(e, lead(s) OVER w) AS raw_end FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY draft_no)""")
def chk07_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spans of drafts without gaps."""
    d = table(spark, sf_dir, "chunk_drafts").filter("doc_id is not null").select("doc_id", "draft_no", "start_pos", "end_pos", "raw_start", "raw_end").distinct()
    d = d.select("doc_id", "draft_no", F.coalesce("raw_start", "start_pos").alias("raw_start"), F.coalesce("raw_end", "end_pos").alias("raw_end"))
    return chunking.seal(d, ["doc_id"], "draft_no")


@query("WITH" + CHUNKS_SQL + f""", k AS (SELECT doc_id, source, chunk_text, len(regexp_extract_all(lower(chunk_text), {TOKENS_SQL})) AS t, sha256(chunk_text) AS h FROM chunks)
SELECT coalesce(source, '') AS source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(greatest(1, t)) AS tokens, round(avg(greatest(1, t)), 4) AS avg_tokens, round(median(greatest(1, t)), 4) AS median_tokens, round(1 - count(DISTINCT h) / count(*), 6) AS duplicate_ratio FROM k GROUP BY 1""")
def agg13_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, chunks, tokens and the share of duplicate chunks."""
    c = chunks(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", T.token_count(F.col("chunk_text")).alias("t"), F.xxhash64("chunk_text").alias("h"))
    return c.groupBy("source").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("t").alias("tokens"), F.round(F.avg("t"), 4).alias("avg_tokens"),
        F.round(F.median("t"), 4).alias("median_tokens"), F.round(1 - F.count_distinct("h") / F.count("*"), 6).alias("duplicate_ratio"),
    )


@query(f"""WITH c AS (SELECT DISTINCT chunk_id, doc_id, title, text FROM chunk_rows), k AS (SELECT *, greatest(1, len(regexp_extract_all(lower(coalesce(text, '')), {TOKENS_SQL}))) AS t FROM c)
SELECT doc_id, max(coalesce(title, '')) AS title, count(*) AS chunks, sum(t) AS tokens, round(avg(t), 4) AS avg_tokens FROM k GROUP BY 1""")
def agg14_document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: chunks and tokens."""
    c = table(spark, sf_dir, "chunk_rows").select("chunk_id", "doc_id", "title", "text").distinct()
    t = T.token_count(F.col("text"))
    return c.groupBy("doc_id").agg(F.max(F.coalesce("title", F.lit(""))).alias("title"), F.count("*").alias("chunks"), F.sum(t).alias("tokens"), F.round(F.avg(t), 4).alias("avg_tokens"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, length(text) AS n FROM chunk_rows WHERE text IS NOT NULL),
g AS (SELECT min(n) AS lo, max(n) AS hi, least(12, greatest(4, CAST(round(sqrt(count(*))) AS INT))) AS bins FROM c),
k AS (SELECT lo, bins, greatest(1, CAST(ceil((hi - lo + 1) / CAST(bins AS DOUBLE)) AS INT)) AS width FROM g),
b AS (SELECT unnest(range(0, bins)) AS bin, lo, width FROM k)
SELECT bin, lo + bin * width AS from_chars, lo + (bin + 1) * width - 1 AS to_chars, count(c.n) AS chunks FROM b LEFT JOIN c ON c.n >= lo + bin * width AND c.n < lo + (bin + 1) * width GROUP BY 1, 2, 3""")
def agg15_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive histogram of chunk lengths: bins by the root of the count, whole widths."""
    c = table(spark, sf_dir, "chunk_rows").filter("text is not null").select("chunk_id", F.length("text").alias("n")).distinct()
    g = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.least(F.lit(12), F.greatest(F.lit(4), F.round(F.sqrt(F.count("*"))).cast("int"))).alias("bins"))
    g = g.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.col("bins")).cast("int")))
    binned = c.crossJoin(F.broadcast(g)).groupBy(F.floor((F.col("n") - F.col("lo")) / F.col("width")).cast("int").alias("bin")).agg(F.count("*").alias("chunks"))
    bins = g.select("lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return bins.join(binned, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("from_chars"), (F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("to_chars"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), {TOKENS_SQL}) AS l FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(l) AS term, unnest(range(0, len(l))) AS pos FROM l),
f AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents, min([doc_id, pos]) AS first FROM t WHERE length(term) >= 2 GROUP BY 1) SELECT term, n, documents FROM f ORDER BY n DESC, first LIMIT 50""")
def agg17_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent terms, of equals the one that comes first in the order of documents."""
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).filter(F.length("term") >= 2)
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    out = per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"), F.min(F.struct("doc_id", "pos")).alias("_first"))
    return out.orderBy(F.desc("n"), "_first").limit(50).drop("_first")


@query(f"""WITH k AS (SELECT DISTINCT chunk_id, text FROM kg_nodes WHERE text IS NOT NULL), t AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), {TOKENS_SQL}))) AS term, text FROM k),
c AS (SELECT chunk_id, term, len(list_filter(regexp_extract_all(lower(text), {TOKENS_SQL}), lambda x: x = term)) AS n FROM t WHERE length(term) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, term) AS place FROM c)
SELECT chunk_id, term, n, place FROM r WHERE place <= 8""")
def agg22_node_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight keywords of each node."""
    k = table(spark, sf_dir, "kg_nodes").filter("text is not null").select("chunk_id", "text").distinct()
    t = k.select("chunk_id", F.explode(T.tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 2).groupBy("chunk_id", "term").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("chunk_id").orderBy(F.desc("n"), "term")
    return t.withColumn("place", F.row_number().over(w)).filter("place <= 8")


@query("""WITH c AS (SELECT DISTINCT chunk_id, length(text) AS n, sha256(text) AS h FROM chunk_rows WHERE text IS NOT NULL)
SELECT count(*) AS chunks, min(n) AS shortest, max(n) AS longest, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.9), 4) AS p90, count(*) FILTER (WHERE n < 200) AS short_chunks, count(*) FILTER (WHERE n > 1500) AS long_chunks, count(*) - count(DISTINCT h) AS duplicates FROM c""")
def agg18_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statistics with an interpolated ninetieth percentile."""
    c = table(spark, sf_dir, "chunk_rows").filter("text is not null").select("chunk_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).distinct()
    return c.agg(
        F.count("*").alias("chunks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.percentile("n", F.lit(0.9)), 4).alias("p90"),
        F.count_if(F.col("n") < 200).alias("short_chunks"), F.count_if(F.col("n") > 1500).alias("long_chunks"), (F.count("*") - F.count_distinct("h")).alias("duplicates"),
    )
