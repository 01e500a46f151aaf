"""Gold evidence and the chunks that stand for it: covers, quotes, misses, coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least length of a matching block, and of a gold paragraph that is evidence.
LEAST_BLOCK, LEAST_GOLD = 4, 10


def minimal_cover(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(span_id, chunk_id, place): the chunks that stand for a span (span_id, doc_id, s_start, s_end) among chunks (chunk_id, doc_id, c_start, c_end).

    The smallest chunk that contains the span (ties: start, id), else the
    fewest overlapping chunks that cover it from left to right, else all that
    overlap it. Only the chunks that overlap a span come into its row; their
    number is bounded by its length. Spans that are no spans give no row.
    """
    s = spans.filter("doc_id is not null and s_start >= 0 and s_end > s_start")
    hit = s.join(chunks, "doc_id").filter("c_start < s_end and c_end > s_start")
    whole = (F.col("c_start") <= F.col("s_start")) & (F.col("c_end") >= F.col("s_end"))
    item = F.struct((F.col("c_end") - F.col("c_start")).alias("n"), F.col("c_start"), F.col("chunk_id"))
    part = F.struct("chunk_id", F.greatest("s_start", "c_start").cast("bigint").alias("a"), F.least("s_end", "c_end").cast("bigint").alias("b"))
    per = hit.groupBy("span_id", "s_start", "s_end").agg(F.min(F.when(whole, item))["chunk_id"].alias("one"), F.array_sort(F.collect_list(part)).alias("parts"))

    # Each step takes, of the parts that begin at or before what is covered and go beyond it, the one that ends last (ties: begins first, then least id).
    def step(done: Column, _: Column) -> Column:
        fits = F.filter("parts", lambda p: (p["a"] <= done["at"]) & (p["b"] > done["at"]))
        best = F.array_max(F.transform(fits, lambda p: F.struct(p["b"].alias("b"), (-p["a"]).alias("a"))))
        first = F.filter(fits, lambda p: (p["b"] == best["b"]) & (p["a"] == -best["a"]))[0]
        return F.when(done["bad"] | (done["at"] >= F.col("s_end")), done).when(F.size(fits) == 0, F.struct(done["at"].alias("at"), F.lit(True).alias("bad"), done["ids"].alias("ids"))).otherwise(F.struct(best["b"].alias("at"), F.lit(False).alias("bad"), F.concat(done["ids"], F.array(first["chunk_id"])).alias("ids")))

    start = F.struct(F.col("s_start").cast("bigint").alias("at"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("ids"))
    walked = F.aggregate(F.sequence(F.lit(1), F.size("parts")), start, step)
    per = per.withColumn("_w", F.when(F.col("one").isNull(), walked))
    ids = F.when(F.col("one").isNotNull(), F.array("one")).when(F.col("_w.bad"), F.col("parts")["chunk_id"]).otherwise(F.col("_w.ids"))
    return per.select("span_id", F.posexplode(ids).alias("place", "chunk_id"))


def quote_span(quote: Column, chunk_text: Column, chunk_start: Column, document: Column, chunk_end: Column) -> Column:
    """struct(start, end, quality) of a quote: exact within its chunk, else exact in the document between the chunk's ends, else the chunk itself."""
    own = F.instr(chunk_text, quote)
    range_ = F.substring(document, chunk_start + 1, chunk_end - chunk_start)
    near = F.instr(range_, quote)
    at = F.when(own > 0, chunk_start + own - 1).when(near > 0, chunk_start + near - 1)
    ok = at.isNotNull() & (F.length(quote) > 0)
    return F.struct(F.when(ok, at).otherwise(chunk_start).cast("int").alias("start"), F.when(ok, at + F.length(quote)).otherwise(chunk_end).cast("int").alias("end"), F.when(ok, "exact").otherwise("chunk_fallback").alias("quality"))


def exact_spans(spans: Column) -> Column:
    """Of gold spans (structs with quality) those found exactly."""
    return F.filter(spans, lambda s: s["quality"] == "exact")


def aliases(spans: Column, text: Column) -> Column:
    """Of alias spans those that can hold the text: at least as long as it is."""
    return F.filter(spans, lambda s: (s["end"] - s["start"]) >= F.length(text))


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def missed(gold: Column, retrieved: Column) -> Column:
    """Gold ids that weren't retrieved, in their order."""
    return F.filter(gold, lambda g: ~F.array_contains(retrieved, g))


def promoted(final: Column, before: Column, mmr: Column) -> Column:
    """Ids that a reranker brought into the final list; null where MMR made the cut, or a list isn't known."""
    window = F.slice(before, F.lit(1), F.greatest(F.lit(1), F.size(final)))
    return F.when(~F.coalesce(mmr, F.lit(False)) & (F.size(before) > 0) & (F.size(final) > 0), F.filter(final, lambda x: ~F.array_contains(window, x)))


def recall_basis(span_recall: Column, chunk_recall: Column) -> Column:
    """struct(recall, basis): by spans where they could be measured, else by chunks."""
    return F.struct(F.coalesce(span_recall, chunk_recall).alias("recall"), F.when(span_recall.isNotNull(), "span").otherwise("chunk").alias("basis"))


def gold_coverage(df: DataFrame, key: str, gold: str, contexts: str) -> DataFrame:
    """(key, coverage): the mean share of each gold paragraph (array of strings) that matching blocks of the joined contexts cover.

    Blocks of fewer than four characters don't count, paragraphs of fewer than
    ten aren't evidence; null where nothing is left to measure. Matching is
    sequential per record, so it is an Arrow function where the rows are; a
    paragraph that stands in the contexts as it is costs only the search for it.
    """

    def one(golds: list[str], texts: list[str]) -> float | None:
        flat = [re.sub(r"\s+", " ", (g or "").strip()) for g in golds]
        flat = [g for g in flat if len(g) >= LEAST_GOLD]
        hay = re.sub(r"\s+", " ", " ".join(t or "" for t in texts).strip())
        if not flat or not len(texts):
            return None

        def share(g: str) -> float:
            if g in hay:
                return 1.0
            blocks = SequenceMatcher(None, g, hay, autojunk=False).get_matching_blocks() if hay else []
            return sum(b.size for b in blocks if b.size >= min(LEAST_BLOCK, len(g))) / len(g)

        return sum(map(share, flat)) / len(flat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "coverage": [None if g is None or t is None else one(list(g), list(t)) for g, t in zip(b["_g"], b["_t"])]})

    return df.select(key, F.col(gold).alias("_g"), F.col(contexts).alias("_t")).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, coverage double")


def redundant_above(ranked: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, gold_id, rank, redundant, projected_rank) of the gold below the cut within the reachable window.

    ``ranked`` has query_id, item_id, rank (from 1), shingles (array of a text's
    distinct character triples), is_gold, top_k, window. From the top, what is
    nearly the same as an earlier item that stands for others is redundant;
    gold competes with nothing. Greedy in rank order, within a bounded window.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        first, extra, rows = [], [], []
        for r in pdf.itertuples():
            if r.is_gold:
                if r.rank > r.top_k:
                    n = len(extra)
                    rows.append((r.query_id, r.item_id, r.rank, n, r.rank - n))
                continue
            own = set(r.shingles)
            if any(len(own & f) >= least * len(own | f) for f in first if own or f):
                extra.append(r.rank)
            else:
                first.append(own)
        return pd.DataFrame(rows, columns=["query_id", "gold_id", "rank", "redundant", "projected_rank"])

    kind = dict(ranked.dtypes)
    return ranked.filter(F.col("rank") <= F.col("window")).groupBy("query_id").applyInPandas(one, f"query_id {kind['query_id']}, gold_id {kind['item_id']}, rank int, redundant int, projected_rank int")
