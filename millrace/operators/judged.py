"""Metrics from judge verdicts, which are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import let


def faithfulness(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, faithfulness): the share of true verdicts."""
    return verdicts.groupBy(key).agg(F.avg(F.col("verdict").cast("int")).alias("faithfulness"))


def context_precision(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, context_precision): average precision of useful contexts in rank order."""
    w = W.Window.partitionBy(key).orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)
    v = F.col("verdict").cast("int")
    at = verdicts.withColumn("_p", F.sum(v).over(w) / F.row_number().over(W.Window.partitionBy(key).orderBy("rank")) * v)
    return at.groupBy(key).agg((F.sum("_p") / (F.sum(v) + 1e-10)).alias("context_precision"))


def correctness(tp: Column, fp: Column, fn: Column, cosine: Column) -> Column:
    """Three quarters of the factual F1 and a quarter of the similarity, renormalised over what is measured."""
    factual = F.when(tp + fp + fn > 0, tp / (tp + 0.5 * (fp + fn))).when(tp.isNotNull(), F.lit(0.0))
    near = F.greatest(cosine, F.lit(0.0))
    near = F.when(cosine.isNotNull(), near)
    return F.when(factual.isNull(), near).when(near.isNull(), factual).otherwise(0.75 * factual + 0.25 * near)


def trigrams(text: Column) -> Column:
    """Distinct character triples without white space; a shorter text is its own one, a blank text has none."""

    def of(t: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
        return F.filter(F.array_distinct(own), lambda g: g != "")

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\n\r]+", ""), of)


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct character triples; 0 where a text has none."""

    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), of)
