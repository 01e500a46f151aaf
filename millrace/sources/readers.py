"""Sources by type: text files, JSON corpora, log lines, question sets, block trees, overlapping pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..runtime import cut

#: Tried in turn on a file's bytes. Fixed values.
ENCODINGS = ["utf-8-sig", "cp949"]
#: Keys of a question set's fields, the first present one counting. Fixed values.
QUESTION_KEYS, TRUTH_KEYS, EVIDENCE_KEYS = ["question", "q", "query"], ["ground_truth", "gold_answer", "answer", "answers"], ["gold_contexts", "gold_context", "evidence", "contexts", "context"]
CORPUS = "id string, text string, source string, metadata map<string,string>, document_type string, retrieval_profile string"
LOG = "question string, contexts string, answer string, config map<string,string>, latency_ms int, feedback string, timestamp string, ground_truth string, gold_contexts array<string>, _corrupt_record string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, format, content) of text files: UTF-8 with or without mark, else cp949, else UTF-8 with replacements."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: bytes) -> str:
            for e in ENCODINGS:
                try:
                    return b.decode(e)
                except UnicodeDecodeError:
                    pass
            return b.decode("utf-8", "replace")

        for s in batches:
            yield s.map(one)

    files = spark.read.format("binaryFile").load(path)
    return files.select(doc_id(F.col("path")).alias("doc_id"), F.col("path").alias("source"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("format"), decode("content").alias("content"))


def doc_id(*parts: "F.Column") -> "F.Column":
    """uuid5 of the parts joined by ``|`` in the URL name space, as built-in expressions."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(F.concat_ws("|", *parts), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents. A missing text or a repeated id is an error when the plan runs."""
    d = spark.read.schema(CORPUS).json(path, multiLine=True)
    n = F.count("id").over(W.Window.partitionBy("id"))
    checked = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text in document "), F.coalesce("id", F.lit("?"))))).when(F.col("id").isNotNull() & (n > 1), F.raise_error(F.concat(F.lit("repeated id "), F.col("id")))).otherwise(F.col("text"))
    return d.withColumn("text", checked)


def log_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of a JSON log: broken or incomplete lines are kept apart as they are, not fatal."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).filter(F.trim("line") != "")
    d = raw.select("line", F.from_json("line", LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("line", "r.*")
    whole = F.col("_corrupt_record").isNull() & (F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    return d.filter(whole).drop("_corrupt_record", "line"), d.filter(~whole).select("line")


def _first(have: set[str], keys: list[str], kind: str) -> "F.Column":
    own = [F.col(k).cast(kind) for k in keys if k in have]
    return F.coalesce(*own) if own else F.lit(None).cast(kind)


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth, gold_contexts) of a question set by extension: .json, .jsonl or .csv; the last of a question counts."""
    if path.endswith(".csv"):
        d = spark.read.csv(path, header=True)
    else:
        d = spark.read.json(path, multiLine=path.endswith(".json"))
    have = set(d.columns)
    evidence = next((k for k in EVIDENCE_KEYS if k in have), None)
    contexts = F.lit(None).cast("array<string>") if evidence is None else F.col(evidence) if dict(d.dtypes)[evidence].startswith("array") else F.array(F.col(evidence))
    d = d.select(_first(have, QUESTION_KEYS, "string").alias("question"), _first(have, TRUTH_KEYS, "string").alias("ground_truth"), contexts.alias("gold_contexts"), F.monotonically_increasing_id().alias("_n"))
    key = F.lower(F.regexp_replace(F.trim("question"), "\\s+", " "))
    return d.filter(F.trim("question") != "").groupBy(key.alias("_q")).agg(F.max_by(F.struct("question", "ground_truth", "gold_contexts"), "_n").alias("r")).select("r.*")


def stitch(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text): overlapping pieces (char_start, seq, text) laid onto a buffer of spaces; later pieces overwrite.

    A document is one group of a Pandas function, as its text is one value anyhow.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        buffer = [" "] * int(max((s + len(t) for s, t in zip(pdf["char_start"], pdf["text"])), default=0))
        for s, t in zip(pdf["char_start"], pdf["text"]):
            buffer[s : s + len(t)] = t
        return pd.DataFrame({key: pdf[key].iloc[:1], "text": "".join(buffer)})

    kind = dict(pieces.dtypes)[key]
    return pieces.groupBy(key).applyInPandas(one, f"`{key}` {kind}, text string")


def first_documents(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The rows of the first ``n`` documents in order of appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias("_at")).orderBy("_at").limit(n)
    return rows.join(first, key, "left_semi")


#: Prefixes of block types. Fixed values.
BLOCKS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "to_do": "- [ ] ", "quote": "> "}


def block_tree(blocks: DataFrame) -> DataFrame:
    """(page_id, content) of a table of blocks (page_id, block_id, parent_id, pos, type, text) in pre-order.

    Paths grow level by level in a join per level, until a level is empty;
    each level is cut, so that a deep tree makes no long plan. Blocks that
    hang under each other in a ring belong to no page and come never up.
    """
    prefix = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BLOCKS.items() for x in kv)), F.col("type")), F.lit(""))
    b = blocks.select("page_id", "block_id", "parent_id", F.format_string("%08d", "pos").alias("_p"), F.concat(prefix, F.coalesce("text", F.lit(""))).alias("line"))
    level = b.filter("parent_id is null").withColumn("path", F.col("_p"))
    done = level
    while True:
        level = b.join(level.select(F.col("block_id").alias("parent_id"), F.col("path").alias("_up")), "parent_id").withColumn("path", F.concat_ws("/", "_up", "_p")).drop("_up")
        level = cut(level)
        if level.isEmpty():
            break
        done = done.unionByName(level)
    lines = done.filter(F.trim("line") != "").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("l"))
    return lines.select("page_id", F.array_join("l.line", "\n").alias("content"))


#: Readers by source type; others are added here.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"file": text_files, "json_corpus": json_corpus, "qa_set": question_set}


def read(spark: SparkSession, source_type: str, path: str) -> tuple[DataFrame | None, str | None]:
    """(documents, error): an unknown source type is an error state, not an exception."""
    reader = READERS.get(source_type)
    if reader is None:
        return None, f"unknown source type: {source_type}"
    return reader(spark, path), None
