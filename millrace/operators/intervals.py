"""Half-open integer intervals: containment, overlap, coverage by a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def valid(start: Column, end: Column) -> Column:
    """Whether a span is one: a start from 0 and an end beyond it; false for nulls."""
    return F.coalesce((start >= 0) & (end > start), F.lit(False))


def touching(spans: DataFrame, chunks: DataFrame, key: str, contained: bool = False, bin_size: int = 1024) -> DataFrame:
    """Spans joined with the chunks of the same key that they overlap (or lie in).

    ``spans`` has key, span_id, s_start, s_end; ``chunks`` key, chunk_id,
    c_start, c_end. Both sides are laid out over bins of the coordinate, so that
    the join is an equi-join on (key, bin) and a long document with many chunks
    is spread over as many tasks; a pair is taken in the first bin that both have.
    """
    bins = lambda a, b: F.sequence(F.floor(a / bin_size), F.floor((F.greatest(b, a + 1) - 1) / bin_size))
    s = spans.withColumn("_bin", F.explode(bins(F.col("s_start"), F.col("s_end"))))
    c = chunks.withColumn("_bin", F.explode(bins(F.col("c_start"), F.col("c_end"))))
    both = s.join(c, [key, "_bin"]).filter(F.col("_bin") == F.greatest(F.floor(F.col("s_start") / bin_size), F.floor(F.col("c_start") / bin_size)))
    on = (F.col("c_start") <= F.col("s_start")) & (F.col("c_end") >= F.col("s_end")) if contained else (F.col("c_start") < F.col("s_end")) & (F.col("c_end") > F.col("s_start"))
    return both.filter(on).drop("_bin")


def covered(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` the characters of [s_start, s_end) that the union of its [c_start, c_end) covers, as ``covered``.

    In order of starts each interval adds what lies beyond all ends before it.
    """
    w = W.Window.partitionBy(*by).orderBy("c_start", "c_end").rowsBetween(W.Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("c_end").over(w), F.col("s_start"))
    added = F.greatest(F.lit(0), F.least("c_end", "s_end") - F.greatest(F.greatest("c_start", "s_start"), before))
    return pairs.withColumn("_added", added).groupBy(*by).agg(F.sum("_added").alias("covered"))
