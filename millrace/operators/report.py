"""Report aggregates: means over measured rows, weighted label counts, composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Weights of the overall score. Fixed values.
WEIGHTS = {"faithfulness": 0.30, "context_recall": 0.25, "answer_correctness": 0.25, "response_relevancy": 0.20}
EPS = 1e-6


def weighted(values: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the values that aren't null, their weights renormalised; null without any."""
    total = sum((F.when(values[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items() if k in values), F.lit(0.0))
    top = sum((F.coalesce(values[k] * w, F.lit(0.0)) for k, w in weights.items() if k in values), F.lit(0.0))
    return F.when(total > 0, top / total)


def overall(ragas: dict[str, Column], recall: Column, f1: Column) -> Column:
    """The weighted mean of the judged metrics, else the mean of recall and F1, else null."""
    parts = F.filter(F.array(recall, f1), lambda x: x.isNotNull())
    fallback = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))
    return F.coalesce(weighted(ragas), fallback)


def harmonic(parts: list[Column]) -> Column:
    """Harmonic mean of the parts that aren't null, each at least EPS; null without any."""
    own = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, F.size(own) / F.aggregate(own, F.lit(0.0), lambda s, x: s + 1 / F.greatest(x, F.lit(EPS))))


def label_weights(findings: DataFrame) -> DataFrame:
    """(label, confirmed, findings, weight): each probe counts as one, shared by its findings."""
    w = F.lit(1.0) / F.count("*").over(W.Window.partitionBy("probe_id"))
    return findings.withColumn("_w", w).groupBy("label", "confirmed").agg(F.count("*").alias("findings"), F.round(F.sum("_w"), 3).alias("weight"))
