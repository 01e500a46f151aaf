"""Search, vector and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..functions import vectors as V
from ..operators import neighbours, retrieval
from ..runtime import cut, table
from .corpus import TOKENS_SQL
from .registry import query

K = 5

_KEYWORD_SQL = f"""
q AS (SELECT DISTINCT log_id AS query_id, min(question) OVER (PARTITION BY log_id) AS question FROM rag_logs WHERE log_id % 20 = 0 AND question IS NOT NULL),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(question), {TOKENS_SQL})) AS term FROM q), qc AS (SELECT query_id, term, count(*) AS qn FROM qt GROUP BY 1, 2),
k AS (SELECT DISTINCT chunk_id, text FROM kg_nodes WHERE text IS NOT NULL), kt AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {TOKENS_SQL})) AS token FROM k), kc AS (SELECT chunk_id, token, count(*) AS cn FROM kt GROUP BY 1, 2),
h AS (SELECT t.term, kc.chunk_id, sum(cn) AS hits FROM (SELECT DISTINCT term FROM qc) t JOIN kc ON kc.token = t.term OR (NOT regexp_matches(t.term, '^[a-z0-9_+.-]+$') AND contains(kc.token, t.term)) GROUP BY 1, 2),
s AS (SELECT qc.query_id, h.chunk_id, sum(least(qn, hits)) / CAST(any_value(tot) AS DOUBLE) AS score FROM qc JOIN h USING (term) JOIN (SELECT query_id, sum(qn) AS tot FROM qc GROUP BY 1) USING (query_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stated query set: every log whose number is divisible by 20, against all rows.
    return table(spark, sf_dir, "rag_logs").filter("log_id % 20 = 0 and question is not null").groupBy(F.col("log_id").alias("query_id")).agg(F.min("question").alias("question"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.spread(table(spark, sf_dir, "kg_nodes").filter("text is not null").select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").distinct()


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.keyword_top(_questions(spark, sf_dir), _nodes(spark, sf_dir), k).withColumn("score", F.round("score", 9))


@query("WITH" + _KEYWORD_SQL + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def ret03_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search of questions over all nodes: term coverage, five best."""
    return _keyword(spark, sf_dir, K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("WITH" + _KEYWORD_SQL + """, g AS (SELECT DISTINCT log_id AS query_id, unnest(contexts).chunk_id AS gold_id FROM rag_logs WHERE log_id % 20 = 0 AND question IS NOT NULL), gg AS (SELECT DISTINCT * FROM g WHERE gold_id IS NOT NULL)
SELECT q.query_id, coalesce(round(count(r.rank) / CAST(nullif(count(gg.gold_id), 0) AS DOUBLE), 6), -1.0) AS recall_at_k FROM q LEFT JOIN gg USING (query_id) LEFT JOIN (SELECT * FROM r WHERE rank <= 20) r ON r.query_id = q.query_id AND r.chunk_id = gg.gold_id GROUP BY 1""")
def met08_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of logged contexts among the twenty best of keyword search; -1 without any."""
    gold = table(spark, sf_dir, "rag_logs").filter("log_id % 20 = 0 and question is not null").select(F.col("log_id").alias("query_id"), F.explode("contexts").alias("c")).select("query_id", F.col("c.chunk_id").alias("gold_id")).filter("gold_id is not null").distinct()
    ranked = _keyword(spark, sf_dir, 20).withColumnRenamed("chunk_id", "item_id")
    return retrieval.recall(gold, ranked, _questions(spark, sf_dir)).withColumn("recall_at_k", F.round("recall_at_k", 6))


_VEC_SQL = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_sum(list_transform(range(1, 65), lambda j: q.e[j] * i.e[j])) / (q.norm * i.norm) AS score FROM n q JOIN n i ON q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM p)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q, i = _vectors(spark, sf_dir)
    near = retrieval.dense_top(q, i, k + 1).filter("query_id <> item_id").withColumn("score", F.round("score", 9))
    return retrieval.top(near.drop("rank"), "query_id", "score", "item_id", k)


@query("WITH" + _VEC_SQL + "SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def ret06_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search: the ten nearest vectors by cosine."""
    return _dense(spark, sf_dir, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


_LEX_SQL = ", x AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, ((q.vec_id * 7 + i.vec_id * 13) % 101) / 100.0 AS score FROM v q JOIN v i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0), xr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM x)"


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    # A stand-in for the lexical channel over vectors: an arithmetic score among items of one label.
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    x = q.join(e.withColumnRenamed("vec_id", "item_id"), "label").filter("query_id <> item_id").withColumn("score", F.expr("((query_id * 7 + item_id * 13) % 101) / 100.0D"))
    return retrieval.top(x, "query_id", "score", "item_id", k)


@query("WITH" + _VEC_SQL + _LEX_SQL + """, d AS (SELECT query_id, item_id, greatest(round(score, 9), 0) AS d FROM r WHERE rank <= 20), dm AS (SELECT *, max(d) OVER (PARTITION BY query_id) AS m FROM d),
f AS (SELECT coalesce(dm.query_id, xr.query_id) AS query_id, coalesce(dm.item_id, xr.item_id) AS item_id, round(0.6 * coalesce(CASE WHEN m > 0 THEN d / m ELSE 0 END, 0) + 0.4 * coalesce(xr.score, 0), 9) AS score FROM dm FULL JOIN (SELECT * FROM xr WHERE rank <= 20) xr ON dm.query_id = xr.query_id AND dm.item_id = xr.item_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) SELECT query_id, item_id, round(score, 6) AS score, rank FROM fr WHERE rank <= 5""")
def ret07_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local hybrid fusion of a dense and a lexical channel."""
    n = retrieval.pool_size(K)
    return retrieval.fuse(_dense(spark, sf_dir, n), _lexical(spark, sf_dir, n), 0.6, K).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("WITH" + _VEC_SQL + _LEX_SQL + """, f AS (SELECT coalesce(d.query_id, xr.query_id) AS query_id, coalesce(d.item_id, xr.item_id) AS item_id, round(coalesce(0.6 / (60 + d.rank), 0) + coalesce(0.4 / (60 + xr.rank), 0), 9) AS score FROM (SELECT * FROM r WHERE rank <= 20) d FULL JOIN (SELECT * FROM xr WHERE rank <= 20) xr ON d.query_id = xr.query_id AND d.item_id = xr.item_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) SELECT query_id, item_id, round(score, 6) AS score, rank FROM fr WHERE rank <= 5""")
def ret08_reciprocal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal rank fusion of the two channels."""
    n = retrieval.pool_size(K)
    return retrieval.reciprocal(_dense(spark, sf_dir, n), _lexical(spark, sf_dir, n), 0.6, K).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("WITH" + _VEC_SQL + """, c AS (SELECT query_id, item_id, round(score, 9) AS score, rank FROM r WHERE rank <= 20), m AS (SELECT query_id, item_id, (query_id * 31 + item_id * 17) % 97 / 96.0 AS ms, rank, score FROM c WHERE query_id % 40 = 0 UNION ALL SELECT query_id, item_id, NULL, rank, score FROM c WHERE query_id % 40 <> 0),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ms, score) DESC, rank) AS new_rank FROM m) SELECT query_id, item_id, rank AS pre_rank, new_rank AS rank, CASE WHEN ms IS NULL THEN 'kept' ELSE 'applied' END AS status FROM z WHERE new_rank <= 5""")
def ret09_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by a table of model scores; queries without scores keep their order."""
    ranked = _dense(spark, sf_dir, 20)
    scores = ranked.filter("query_id % 40 = 0").select("query_id", "item_id", F.expr("(query_id * 31 + item_id * 17) % 97 / 96.0D").alias("model_score"))
    return retrieval.rerank(ranked, scores, K).select("query_id", "item_id", "pre_rank", "rank", "status")


@query()
def ret10_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance over each query's pool."""
    _, items = _vectors(spark, sf_dir)
    return retrieval.mmr(_dense(spark, sf_dir, 20).join(items.select("item_id", "embedding"), "item_id"), 0.5, K)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS cnt FROM v),
s AS (SELECT * FROM n WHERE cnt <= 40 OR i IN (SELECT unnest(list_transform(range(0, 40), lambda j: j * n.cnt // 40)))),
p AS (SELECT a.label, list_sum(list_transform(range(1, 65), lambda j: a.e[j] * b.e[j])) / (a.norm * b.norm) AS c FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS pairs, round(avg(c), 6) AS cohesion FROM p GROUP BY 1""")
def met30_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine of each topic over a deterministic stride sample of forty.

    By linearity the sum over pairs is (|Σu|² − n) / 2 of unit vectors, so a
    topic needs one aggregate of its vectors and no pairs.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    w = W.Window.partitionBy("label")
    e = e.withColumn("i", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("n", F.count("*").over(w))
    e = e.filter((F.col("n") <= 40) | F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.floor(j * F.col("n") / 40).cast("int")), F.col("i")))
    unit = e.select("label", "vec_id", F.posexplode("embedding").alias("d", "x"), V.norm(F.col("embedding")).alias("norm"))
    sums = unit.groupBy("label", "d").agg(F.sum(F.col("x").cast("double") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n")).filter("n > 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select("label", pairs.cast("bigint").alias("pairs"), F.round((F.col("q") - F.col("n")) / 2 / pairs, 6).alias("cohesion"))


_GRAPH_SQL = f"""
k AS (SELECT DISTINCT chunk_id, text FROM kg_nodes WHERE text IS NOT NULL AND doc_id IS NOT NULL), t AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), {TOKENS_SQL}))) AS term, text FROM k),
c AS (SELECT chunk_id, term, len(list_filter(regexp_extract_all(lower(text), {TOKENS_SQL}), lambda x: x = term)) AS n FROM t WHERE length(term) >= 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, term) AS place FROM c) WHERE place <= 8), cnt AS (SELECT chunk_id, count(*) AS m FROM kw GROUP BY 1),
i AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS shared FROM kw a JOIN kw b ON a.term = b.term AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
e AS (SELECT src, dst, round(shared / CAST(x.m + y.m - shared AS DOUBLE), 9) AS weight FROM i JOIN cnt x ON x.chunk_id = src JOIN cnt y ON y.chunk_id = dst WHERE shared / CAST(x.m + y.m - shared AS DOUBLE) >= 0.3),
b AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e), rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM b),
g AS (SELECT DISTINCT least(node, other) AS src, greatest(node, other) AS dst, weight FROM rk WHERE r <= 2)
"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "kg_nodes").filter("text is not null and doc_id is not null and chunk_id is not null").select("chunk_id", "text")
    t = retrieval.spread(nodes, "chunk_id").distinct().groupBy("chunk_id").agg(F.flatten(F.collect_list(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 2))).alias("tokens"))
    kw = t.select("chunk_id", F.transform(neighbours.most_frequent(F.col("tokens"), 8), lambda x: F.xxhash64(x)).alias("terms")).filter(F.size("terms") > 0)
    # Numbers in the order of chunk_id stand for it; both cuts keep what is costly or must not change from being done again.
    own = cut(cut(kw).orderBy("chunk_id").withColumn("id", F.monotonically_increasing_id()))
    best = neighbours.jaccard_top(own, 0.3, 2)
    e = best.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst"), "weight").distinct()
    src, dst = own.select(F.col("id").alias("src"), F.col("chunk_id").alias("a")), own.select(F.col("id").alias("dst"), F.col("chunk_id").alias("b"))
    return e.join(src, "src").join(dst, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


@query("WITH" + _GRAPH_SQL + "SELECT src, dst, round(weight, 6) AS weight FROM g")
def jn12_keyword_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours by shared keywords: floor, two per node, symmetrised."""
    return _graph(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("WITH" + _GRAPH_SQL + "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst")
def jn13_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the keyword graph."""
    g = cut(_graph(spark, sf_dir).select("src", "dst"))
    x, y, z = g.toDF("a", "b"), g.toDF("b", "c"), g.toDF("a", "c")
    return x.join(y, "b").join(z, ["a", "c"]).select("a", "b", "c")
