"""Evidence queries: gold spans against chunks, boundary geometry, search metrics, candidate values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import intervals, optimize
from ..runtime import table
from .corpus import CHUNKS_SQL, chunks
from .registry import query

#: Gold spans cut from documents: three per document, with lengths that cross chunk boundaries now and then.
_SPANS_SQL = """
sp AS (SELECT doc_id, j AS span_no, doc_id || ':' || j AS span_id, CAST((n * (2 * j + 1)) // 7 AS BIGINT) AS s_start, CAST(least(n, (n * (2 * j + 1)) // 7 + 40 + (doc_id * 37 + j * 101) % 400) AS BIGINT) AS s_end
  FROM (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 60), (SELECT unnest([0, 1, 2]) AS j)),
ov AS (SELECT sp.*, c.draft_no, c.start_pos AS c_start, c.end_pos AS c_end FROM sp JOIN chunks c ON c.doc_id = sp.doc_id AND c.start_pos < sp.s_end AND c.end_pos > sp.s_start)
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 60).select("doc_id", F.length("text").alias("n")).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    d = d.withColumn("s_start", F.expr("(n * (2 * j + 1)) div 7")).withColumn("s_end", F.expr("least(n, s_start + 40 + (doc_id * 37 + j * 101) % 400)"))
    return d.select("doc_id", F.col("j").alias("span_no"), F.concat_ws(":", "doc_id", "j").alias("span_id"), "s_start", "s_end")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "draft_no", F.col("start_pos").alias("c_start"), F.col("end_pos").alias("c_end"))


@query("WITH" + CHUNKS_SQL + "," + _SPANS_SQL + "SELECT span_id, count(*) AS n_chunks, count(*) FILTER (WHERE c_start <= s_start AND c_end >= s_end) AS n_containing, min(draft_no) AS first_chunk FROM ov GROUP BY 1")
def jn05_span_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by the chunks that overlap and that contain them."""
    o = intervals.touching(_spans(spark, sf_dir), _places(spark, sf_dir), "doc_id")
    inside = (F.col("c_start") <= F.col("s_start")) & (F.col("c_end") >= F.col("s_end"))
    return o.groupBy("span_id").agg(F.count("*").alias("n_chunks"), F.count_if(inside).alias("n_containing"), F.min("draft_no").alias("first_chunk"))


_COVER_SQL = "WITH" + CHUNKS_SQL + "," + _SPANS_SQL + """, hit AS (SELECT * FROM ov WHERE draft_no % 3 <> 1),
cv AS (SELECT *, coalesce(max(c_end) OVER (PARTITION BY span_id ORDER BY c_start, c_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s_start) AS before FROM hit),
sc AS (SELECT span_id, sum(greatest(0, least(c_end, s_end) - greatest(greatest(c_start, s_start), before))) AS covered FROM cv GROUP BY 1)
"""


@query(_COVER_SQL + "SELECT sp.doc_id, round(sum(coalesce(covered, 0)) / CAST(sum(s_end - s_start) AS DOUBLE), 6) AS span_recall, count(*) FILTER (WHERE coalesce(covered, 0) = s_end - s_start) AS fully, count(*) AS spans FROM sp LEFT JOIN sc USING (span_id) GROUP BY 1")
def met11_span_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold characters that the union of retrieved chunks covers, per document (two chunks of three count as retrieved)."""
    s = _spans(spark, sf_dir)
    hit = intervals.touching(s, _places(spark, sf_dir).filter("draft_no % 3 <> 1"), "doc_id")
    c = intervals.covered(hit, ["span_id"])
    out = s.join(c, "span_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    n = F.col("s_end") - F.col("s_start")
    return out.groupBy("doc_id").agg(F.round(F.sum("covered") / F.sum(n), 6).alias("span_recall"), F.count_if(F.col("covered") == n).alias("fully"), F.count("*").alias("spans"))


@query(_COVER_SQL + """, len AS (SELECT doc_id, sum(end_pos - start_pos) AS chars FROM chunks WHERE draft_no % 3 <> 1 GROUP BY 1) SELECT doc_id, round(least(1, coalesce(sum(covered), 0) / CAST(any_value(chars) AS DOUBLE)), 6) AS span_precision FROM len JOIN sp USING (doc_id) LEFT JOIN sc USING (span_id) GROUP BY 1""")
def met12_span_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered gold characters over the characters of all retrieved chunks."""
    s, got = _spans(spark, sf_dir), _places(spark, sf_dir).filter("draft_no % 3 <> 1")
    c = intervals.covered(intervals.touching(s, got, "doc_id"), ["span_id"])
    covered = s.join(c, "span_id", "left").groupBy("doc_id").agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    chars = got.groupBy("doc_id").agg(F.sum(F.col("c_end") - F.col("c_start")).alias("chars"))
    return chars.join(covered, "doc_id").select("doc_id", F.round(F.least(F.lit(1.0), F.col("covered") / F.col("chars")), 6).alias("span_precision"))


@query("WITH" + CHUNKS_SQL + "," + _SPANS_SQL + """, k AS (SELECT span_id, any_value(doc_id) AS doc_id, bool_or(c_start <= s_start AND c_end >= s_end) AS contained FROM ov GROUP BY 1)
SELECT sp.doc_id, count(*) FILTER (WHERE contained) AS contained, count(*) FILTER (WHERE NOT contained) AS split, count(*) FILTER (WHERE contained IS NULL) AS uncovered FROM sp LEFT JOIN k USING (span_id) GROUP BY 1""")
def met14_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that lie in a chunk, that boundaries split, and that no chunk touches."""
    s = _spans(spark, sf_dir)
    k = intervals.touching(s, _places(spark, sf_dir), "doc_id").groupBy("span_id").agg(F.bool_or((F.col("c_start") <= F.col("s_start")) & (F.col("c_end") >= F.col("s_end"))).alias("contained"))
    out = s.join(k, "span_id", "left")
    return out.groupBy("doc_id").agg(F.count_if("contained").alias("contained"), F.count_if(~F.col("contained")).alias("split"), F.count_if(F.col("contained").isNull()).alias("uncovered"))


@query("WITH" + CHUNKS_SQL + "," + _SPANS_SQL + """, de AS (SELECT doc_id, draft_no, sum(least(c_end, s_end) - greatest(c_start, s_start)) AS cov, any_value(c_end - c_start) AS len FROM ov GROUP BY 1, 2)
SELECT doc_id, round(sum(cov) / CAST(sum(len) AS DOUBLE), 6) AS density FROM de WHERE cov > 0 GROUP BY 1""")
def met15_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of evidence in the chunks that hold any."""
    o = intervals.touching(_spans(spark, sf_dir), _places(spark, sf_dir), "doc_id")
    d = o.groupBy("doc_id", "draft_no").agg(F.sum(F.least("c_end", "s_end") - F.greatest("c_start", "s_start")).alias("cov"), F.any_value(F.col("c_end") - F.col("c_start")).alias("len"))
    return d.filter("cov > 0").groupBy("doc_id").agg(F.round(F.sum("cov") / F.sum("len"), 6).alias("density"))


@query("WITH" + CHUNKS_SQL + "," + _SPANS_SQL + "SELECT count(*) AS spans, count(*) FILTER (WHERE s_end - s_start > (SELECT max(end_pos - start_pos) FROM chunks) // 2) AS oversized, max(s_end - s_start) AS longest FROM sp")
def met17_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans longer than half the longest chunk of the whole corpus."""
    most = _places(spark, sf_dir).agg(F.floor(F.max(F.col("c_end") - F.col("c_start")) / 2).alias("m"))
    n = F.col("s_end") - F.col("s_start")
    return _spans(spark, sf_dir).crossJoin(F.broadcast(most)).agg(F.count("*").alias("spans"), F.count_if(n > F.col("m")).alias("oversized"), F.max(n).alias("longest"))


@query("WITH" + CHUNKS_SQL + "," + _SPANS_SQL + """, p AS (SELECT doc_id, draft_no, start_pos, end_pos, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos) AS n_start, lead(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos) AS n_end FROM chunks),
x AS (SELECT p.doc_id, draft_no, span_id, s_end - s_start AS span_chars, end_pos - n_start AS overlap FROM p JOIN sp USING (doc_id) WHERE n_start IS NOT NULL AND s_start >= start_pos AND s_start < n_start AND s_end > end_pos AND s_end <= n_end)
SELECT count(*) AS crossings, quantile_disc(span_chars, 0.5) AS median_chars, quantile_disc(span_chars, 0.85) AS p85_chars, max(span_chars - overlap) AS most_missing FROM x""")
def jn16_boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that cross exactly one boundary of neighbouring chunks, and the overlap that would hold them."""
    w = W.Window.partitionBy("doc_id").orderBy("c_start")
    p = _places(spark, sf_dir).withColumn("n_start", F.lead("c_start").over(w)).withColumn("n_end", F.lead("c_end").over(w)).filter("n_start is not null")
    x = intervals.touching(_spans(spark, sf_dir), p, "doc_id").filter("s_start >= c_start and s_start < n_start and s_end > c_end and s_end <= n_end")
    x = x.select((F.col("s_end") - F.col("s_start")).alias("n"), (F.col("c_end") - F.col("n_start")).alias("o"))
    return x.agg(F.count("*").alias("crossings"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("median_chars"), F.expr("percentile_disc(0.85) WITHIN GROUP (ORDER BY n)").alias("p85_chars"), F.max(F.col("n") - F.col("o")).alias("most_missing"))


@query("""WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 60), cfg AS (SELECT * FROM (VALUES (256, 32), (512, 50), (768, 96), (1024, 128)) t(size, overlap)),
c AS (SELECT doc_id, size, overlap, n, unnest(range(0, 1 + CAST(ceil(greatest(0, n - size) / CAST(size - overlap AS DOUBLE)) AS BIGINT))) AS i FROM d, cfg),
k AS (SELECT doc_id, size, overlap, i * (size - overlap) AS c_start, least(i * (size - overlap) + size, n) AS c_end FROM c),
sp AS (SELECT doc_id, doc_id || ':' || j AS span_id, CAST((n * (2 * j + 1)) // 7 AS BIGINT) AS s_start, CAST(least(n, (n * (2 * j + 1)) // 7 + 40 + (doc_id * 37 + j * 101) % 400) AS BIGINT) AS s_end FROM d, (SELECT unnest([0, 1, 2]) AS j)),
m AS (SELECT size, overlap, count(DISTINCT span_id) AS contained FROM sp JOIN k ON k.doc_id = sp.doc_id AND c_start <= s_start AND c_end >= s_end GROUP BY 1, 2), t AS (SELECT size, overlap, sum(c_end - c_start) AS chars, count(*) AS chunks FROM k GROUP BY 1, 2)
SELECT size, overlap, contained, chunks, round(chars / CAST((SELECT sum(n) FROM d) AS DOUBLE), 6) AS duplication, row_number() OVER (ORDER BY contained DESC, chars, size) AS place FROM m JOIN t USING (size, overlap)""")
def opt19_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate chunk configurations by containment of gold spans, then by duplication."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 60).select("doc_id", F.length("text").alias("n"))
    return optimize.prescreen(docs, _spans(spark, sf_dir), [(256, 32), (512, 50), (768, 96), (1024, 128)])
