"""The queries of this package over the test tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import boilerplate, bpe, mixing, neardup, pairs, pii, sentences, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of pages and chunks that aren't body."""
    return _not_body(spark, sf_dir).select("item_id", "line_no").distinct()


def _not_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.not_body(table(spark, sf_dir, "source_docs"), table(spark, sf_dir, "chunk_rows"))


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' bodies, each page once, in its latest delivery."""
    docs = table(spark, sf_dir, "source_docs")
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("crawled_at", "text"))["text"].alias("text"))
    return boilerplate.bodies(docs, "doc_id", _not_body(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return splitting.split_tables(*(table(spark, sf_dir, t) for t in ("raw_docs", "chunk_drafts", "chunk_rows", "size_limits")), with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut."""
    return _pieces(spark, sf_dir, with_text=False).filter("n_pieces > 1 and piece_no = 0").select("item_kind", "item_id", "draft_no")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, of cut and uncut items."""
    return _pieces(spark, sf_dir, with_text=True).select("item_kind", "item_id", "draft_no", "piece_no", "n_pieces", "start_pos", "end_pos", "piece_size", F.col("piece_section").alias("section"), F.col("piece_text").alias("text"))


def _grouped(spark: SparkSession, sf_dir: str, count_links: bool) -> DataFrame:
    rows = [table(spark, sf_dir, t).select(F.col("chunk_id").alias("record_id"), "text") for t in ("chunk_rows", "kg_nodes")]
    return neardup.group(rows[0].unionByName(rows[1]), count_links=count_links)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one group."""
    return neardup.pairs(_grouped(spark, sf_dir, count_links=False))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's group and its number of links."""
    return _grouped(spark, sf_dir, count_links=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal information in the logs."""
    return pii.find(table(spark, sf_dir, "rag_logs"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs with placeholders, each log once, in its latest delivery."""
    last = F.max(F.struct("arrived_at", "question", "answer", "contexts")).alias("d")
    logs = table(spark, sf_dir, "rag_logs").groupBy("log_id").agg(last).select("log_id", "d.question", "d.answer", "d.contexts")
    out = pii.redact_columns(logs, ["question", "answer", "contexts"])
    return out.withColumn("contexts", F.transform("contexts", lambda x: x["text"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective pairs with their defect."""
    return pairs.found(table(spark, sf_dir, "rag_logs"))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of each pair."""
    return pairs.label(table(spark, sf_dir, "rag_logs")).select("log_id", F.array_join("defects", ",").alias("defects"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary())


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(bpe.count_tokens(docs, bpe.vocabulary()), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.split(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """All queries of the package by name."""
    return {f.__name__: f for f in (p1_found, p1_bodies, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_redacted, p5_found, p5_labels, p6_ids, p7_mix, p7_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {}
