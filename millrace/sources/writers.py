"""Sinks: idempotent upserts by key, deletions by scope, versioned slots, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame | None, new: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """The table after writing ``new`` over ``old`` by key; rows without a vector are skipped; of equal keys one stays."""
    if vector:
        new = new.filter(F.size(vector) > 0)
    new = new.dropDuplicates([key])
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(table: DataFrame, docs: DataFrame, scope: str | None = None) -> DataFrame:
    """The table without the chunks of ``docs`` (doc_id), within a scope if one is given."""
    gone = docs.select("doc_id").distinct()
    if scope is None:
        return table.join(gone, "doc_id", "left_anti")
    inside = F.col("retrieval_scope_id") == scope
    return table.filter(~inside | inside.isNull()).unionByName(table.filter(inside).join(gone, "doc_id", "left_anti"))


def check_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """``df``, whose plan fails on a vector of another length."""
    n = F.size(vector)
    return df.withColumn(vector, F.when(n != dimension, F.raise_error(F.concat(F.lit(f"vector of {dimension} expected, not "), n.cast("string")))).otherwise(F.col(vector)))


def write_slot(df: DataFrame, root: str, protected: str | None) -> str:
    """Write into the slot (a or b) that isn't protected, and return its name: a baseline is never overwritten."""
    slot = "b" if protected == "a" else "a"
    df.write.mode("overwrite").parquet(f"{root}/{slot}")
    return slot


def read_slot(spark: SparkSession, root: str, slot: str) -> DataFrame:
    """A slot's table."""
    return spark.read.parquet(f"{root}/{slot}")


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunks as JSON lines: vectors stay, sparse vectors don't."""
    df.drop("sparse_vector", "sparse").write.mode("overwrite").json(path)


def write_log(merged: DataFrame, broken: DataFrame, path: str) -> None:
    """A merged log as JSON lines; lines that couldn't be read pass through as they were."""
    merged.select(F.to_json(F.struct(*merged.columns)).alias("value")).unionByName(broken.select(F.col("line").alias("value"))).write.mode("overwrite").text(path)
