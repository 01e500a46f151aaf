"""Mixing sources to target shares of all tokens, by Pareto order sampling.

The largest mix that no source's cap forbids is planned: its size is the least
of ``tokens · max_repeats / target_share`` over the sources. A document then
has an expected number of copies; the whole part of it is certain, and the
fraction is an inclusion probability. Documents are ranked by their random odds
over their inclusion odds (Pareto order sampling), and the first of a source
are taken until its tokens are reached. That cut is found without sorting a
source in one task: a histogram of ranks finds the cell in which the target
falls, and only that cell is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import cut

#: Cells of the histogram of ranks.
CELLS = 1 << 14


def source_key(column: F.Column) -> F.Column:
    """A source's name as it is compared: trimmed, lower case, ``-`` as ``_``."""
    return F.replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit("-"), F.lit("_"))


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per compared name.

    Rows without a name, a positive share or a positive cap name no source;
    repeated names count once, with the largest share.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    t = t.filter("source is not null and target_share > 0 and max_repeats > 0")
    return t.groupBy("source").agg(F.max_by("target_share", F.struct("target_share", "max_repeats")).alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its tokens, the tokens it shall give, and the copies of a document of weight 1.

    A source without any tokens can't give its share; it stays in the report
    with none, and the mix is planned from the others.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count("*").alias("have_docs"))
    p = targets.join(F.broadcast(have), "source", "left").fillna(0, ["have_tokens", "have_docs"])
    mix = p.filter("have_tokens > 0").agg(F.min(F.col("have_tokens") * F.col("max_repeats") / F.col("target_share")).alias("mix_tokens"))
    return p.crossJoin(F.broadcast(mix)).withColumn("want_tokens", F.when(F.col("have_tokens") > 0, F.col("mix_tokens") * F.col("target_share")).otherwise(0.0))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, weight: str | None = None) -> DataFrame:
    """The documents of the mix: (doc_id, source, n_tokens, copies), copies ≥ 1.

    ``documents`` has doc_id, source and n_tokens; repeated rows of one doc_id
    count once (the largest source and size), a null doc_id is no document, and
    sources that ``targets`` doesn't name stay out. Documents of no tokens are
    never used: they add nothing to any share. ``targets`` is a control table
    of one row per source and is broadcast. With ``weight`` (a positive number;
    null counts as 1) expected copies are in proportion to it, up to the cap;
    what the cap cuts off is spread over the others in three rounds.
    """
    targets = targets_of(targets)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    docs = documents.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.when(w > 0, w).otherwise(1.0).alias("_w"))
    docs = docs.filter("doc_id is not null and source is not null and n_tokens > 0").join(F.broadcast(targets.select("source")), "source", "left_semi")
    docs = cut(docs.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens", "_w")).alias("d")).select("doc_id", "d.*"))
    p = plan(docs, targets)
    planned = docs.join(F.broadcast(p.select("source", "want_tokens", "max_repeats")), "source")
    if weight is None:
        sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("_all"))
        planned = planned.join(F.broadcast(sums), "source").withColumn("_mu", F.least(F.col("want_tokens") / F.col("_all"), F.col("max_repeats")))
    else:
        scale = p.select("source", F.lit(0.0).alias("_k"))
        for _ in range(4):  # what capped documents can't give is spread over the others
            own = planned.join(F.broadcast(scale), "source")
            full = F.col("_k") * F.col("_w") >= F.col("max_repeats")
            scale = cut(own.groupBy("source").agg(F.sum(F.when(full, F.col("n_tokens") * F.col("max_repeats"))).alias("f"), F.sum(F.when(~full, F.col("n_tokens") * F.col("_w"))).alias("r"), F.first("want_tokens").alias("t"), F.max("_k").alias("k"))
                        .select("source", F.coalesce((F.col("t") - F.coalesce("f", F.lit(0.0))) / F.col("r"), F.col("k")).alias("_k")))
        planned = planned.join(F.broadcast(scale), "source").withColumn("_mu", F.least(F.col("_k") * F.col("_w"), F.col("max_repeats").cast("double")))
    # Certain whole copies, then the fraction as an inclusion probability.
    planned = planned.withColumn("_whole", F.floor(F.col("_mu") + 1e-9)).withColumn("_pi", F.greatest(F.col("_mu") - F.col("_whole"), F.lit(0.0)))
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("_pi") / (1 - F.col("_pi")))
    ranked = planned.withColumn("_q", F.when(F.col("_pi") > 1e-9, odds))
    # x/(1+x) brings the rank into (0, 1): its cell.
    ranked = ranked.withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS).cast("int"))
    left = ranked.groupBy("source").agg((F.first("want_tokens") - F.sum(F.col("_whole") * F.col("n_tokens"))).alias("_left"))
    cells = ranked.filter("_cell is not null").groupBy("source", "_cell").agg(F.sum("n_tokens").alias("_t"))
    upto = W.Window.partitionBy("source").orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_t").over(upto)).join(F.broadcast(left), "source")
    # Whole cells below the target, the cell in which it falls, and how much of that cell is wanted.
    edge = cells.groupBy("source").agg(F.min(F.when(F.col("_upto") > F.col("_left"), F.col("_cell"))).alias("_edge"), F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_upto"))).alias("_below"), F.first("_left").alias("_left"))
    drawn = ranked.join(F.broadcast(edge), "source", "left")
    sure = drawn.filter("_cell is null or _edge is null or _cell <> _edge").withColumn("_in", F.coalesce(F.col("_cell") < F.coalesce("_edge", F.lit(CELLS)), F.lit(False)))
    within = W.Window.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(W.Window.unboundedPreceding, 0)
    close = drawn.filter("_cell = _edge").withColumn("_run", F.sum("n_tokens").over(within) - F.col("n_tokens") / 2)
    close = close.withColumn("_in", F.col("_run") <= F.col("_left") - F.coalesce("_below", F.lit(0))).drop("_run")
    copies = (F.col("_whole") + F.col("_in").cast("bigint")).cast("bigint").alias("copies")
    return sure.unionByName(close).select("doc_id", "source", "n_tokens", copies).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: a row per target source with its target share and the share reached."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    t = targets_of(targets).join(F.broadcast(got), "source", "left").fillna(0, ["mix_tokens", "docs_used", "most_copies"])
    total = t.agg(F.sum("mix_tokens").alias("_total"))
    reached = F.when(F.col("_total") > 0, F.col("mix_tokens") / F.col("_total")).otherwise(0.0)
    return t.crossJoin(F.broadcast(total)).select("source", "target_share", reached.alias("reached_share"), "mix_tokens", "docs_used", "most_copies", "max_repeats")
