"""Streaming, greedy chunkers and other queries that are more than one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, preprocess
from ..sources import readers
from ..streaming import progress
from ..runtime import table
from .registry import query

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.event_stream(spark, sf_dir, _EVENTS).withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream with a watermark (an extension: the pipeline has no event time)."""
    w = progress.windowed(_stream(spark, sf_dir), "at", "1 hour", "event_type", "value")
    out = progress.drain(w.select(F.unix_timestamp(F.col("w.start")).alias("hour_at"), "event_type", "n", F.round("total", 4).alias("total")), "windows")
    return out


@query("WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT * FROM e")
def str_snapshots_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a run counted once per key, from a stream."""
    s = _stream(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return progress.drain(s, "snapshots")


@query()
def chk02_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks at preferred separators."""
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "recursive")


@query()
def chk03_recursive_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks at sentence ends first."""
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "recursive_sentence")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("ingested_at", "content", F.col("metadata")["document_type"].alias("declared"))).alias("d")
    d = table(spark, sf_dir, "raw_docs").groupBy("doc_id").agg(last).select("doc_id", "d.content", preprocess.document_type(F.col("d.declared")).alias("kind"))
    return d.withColumn("content", preprocess.normalise_document(F.col("content")))


@query()
def chk04_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of markdown headings, over normalised documents."""
    return chunking.chunk(_normalised(spark, sf_dir), "doc_id", "content", "markdown", kind="kind")


@query()
def chk05_markdown_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks within the sections of markdown headings, over normalised documents."""
    return chunking.chunk(_normalised(spark, sf_dir), "doc_id", "content", "markdown_recursive", kind="kind")


@query()
def txt01_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised documents by hash."""
    d = table(spark, sf_dir, "raw_docs").select("doc_id", "content").distinct()
    return d.select("doc_id", F.sha2(preprocess.normalise_document(F.col("content")), 256).alias("hash"))


@query()
def src05_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their overlapping drafts."""
    p = table(spark, sf_dir, "chunk_drafts").filter("text is not null and start_pos is not null").select("doc_id", F.col("start_pos").alias("char_start"), F.col("draft_no").alias("seq"), "text").distinct()
    return readers.stitch(p, "doc_id")


@query("SELECT doc_id, text, length(text) AS n FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def src06_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-five documents in order (the limit is the reader's feature)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return readers.first_documents(d, "doc_id", "doc_id", 25).withColumn("n", F.length("text"))


@query("""WITH r AS (SELECT DISTINCT log_id, raw_json FROM rag_logs) SELECT count(*) AS n, count(*) FILTER (WHERE raw_json IS NULL) AS missing, count(*) FILTER (WHERE raw_json IS NOT NULL AND NOT json_valid(raw_json)) AS broken FROM r""")
def src09_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines that aren't JSON: collected, not fatal."""
    r = table(spark, sf_dir, "rag_logs").select("log_id", "raw_json").distinct()
    parsed = F.try_parse_json("raw_json")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("raw_json").isNull()).alias("missing"), F.count_if(F.col("raw_json").isNotNull() & parsed.isNull()).alias("broken"))
