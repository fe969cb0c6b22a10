"""Queries on retrieval: benchmark passages as questions, documents as the corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import FUNCTION_WORDS, english_tokens, signal_tokens, specificity
from lexmill.operators import evaluation as E
from lexmill.operators import index
from lexmill.operators import retrieval as R
from lexmill.session import table
from lexmill.storage import materialize, shared_path


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "documents"), table(spark, sf, "benchmark")


def _top(spark: SparkSession, sf: str, path: str) -> DataFrame:
    return R.lexical_hits(*_both(spark, sf), paths=(path,)).drop("path", "path_order")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "bm25")


def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "sparse")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "dense")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return R.dense_hits(vectors, vectors.filter("vec_id % 20 = 0"))


def indexed_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The BM25 rows from an index that is written first."""
    docs, items = _both(spark, sf)
    folder = shared_path(spark, "text-index")
    index.build_text_index(docs, folder)
    return index.search_text_index(spark, folder, items)


def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors from an index; recall against dense_topk is tested."""
    vectors, folder = table(spark, sf, "embeddings"), shared_path(spark, "vector-index")
    index.build_vector_index(vectors, folder)
    return index.search_vector_index(spark, folder, vectors.filter("vec_id % 20 = 0"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(R.lexical_hits(*_both(spark, sf)), "paths")  # each path is used by the fusion more than once


def _specificity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), specificity(english_tokens(F.col("text"))).alias("s"))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(R.rrf(_paths(spark, sf)), 10)


def path_union(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_found(_paths(spark, sf))


def minmax_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(R.fuse(_paths(spark, sf), _specificity(spark, sf)), 10)


def funnel_top3(spark: SparkSession, sf: str) -> DataFrame:
    return R.funnel(_paths(spark, sf), _specificity(spark, sf))


def funnel_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.left(F.col("text"), F.lit(500)).alias("text"), "source")
    return R.context(bm25_topk(spark, sf).filter("rank <= 3").join(docs, "doc_id"))


def query_specificity(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", english_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return asked.select("conv_id", "turn", F.size("w").cast("long").alias("total_tokens"), signal_tokens(F.col("w")).cast("long").alias("signal_tokens"), F.round(specificity(F.col("w")), 6).alias("specificity"))


def bm25_vocab_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.vocabulary(table(spark, sf, "documents"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain the passage."""
    docs, items = _both(spark, sf)
    return R.containing_pairs(docs, items).select("query_id", "doc_id")


def gold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf)


def retrieval_hits(spark: SparkSession, sf: str) -> DataFrame:
    return E.retrieval_scores(materialize(bm25_topk(spark, sf), "hits"), materialize(_gold(spark, sf), "gold"))


def _summary(hits: DataFrame, gold: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return E.retrieval_summary(E.retrieval_scores(hits, gold), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")))


def retrieval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(bm25_topk(spark, sf), materialize(_gold(spark, sf), "gold"), spark, sf)


def baseline_compare(spark: SparkSession, sf: str) -> DataFrame:
    gold = materialize(_gold(spark, sf), "gold")
    return E.compare(_summary(sparse_topk(spark, sf), gold, spark, sf), _summary(bm25_topk(spark, sf), gold, spark, sf))


def elimination_stage(spark: SparkSession, sf: str) -> DataFrame:
    paths = _paths(spark, sf)
    l2 = materialize(R.top_k(R.fuse(paths, _specificity(spark, sf)), 10), "coarse")
    l1 = R.first_found(paths).select("query_id", "doc_id", F.col("first_rank").alias("rank"))
    return E.elimination({"l1": l1, "l2": l2, "l3": l2.filter("rank <= 3")}, materialize(_gold(spark, sf), "gold"))


QUERIES = {f.__name__: f for f in (bm25_topk, sparse_topk, cosine_topk, dense_topk, indexed_bm25_topk, ann_topk, rrf_fusion, path_union, minmax_fusion, funnel_top3, funnel_context, query_specificity, bm25_vocab_stats, gold_pairs, retrieval_hits, retrieval_summary, baseline_compare, elimination_stage)}

WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'), lambda x: lower(x))"
STRUCTURE = "['" + "','".join(FUNCTION_WORDS) + "']"
BASE = f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
tf AS (SELECT doc_id, length, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM dw) GROUP BY ALL),
qw AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
qt AS (SELECT query_id, token, count(*) AS q FROM (SELECT query_id, unnest(w) AS token FROM qw) GROUP BY ALL),
df AS (SELECT token, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY token),
bm AS (SELECT query_id, doc_id, round(sum(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / 256.0::DOUBLE)))), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token) GROUP BY ALL),
sp AS (SELECT query_id, doc_id, sum(q * tf)::DOUBLE AS score FROM qt JOIN tf USING (token) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY doc_id),
qn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM qt GROUP BY query_id),
co AS (SELECT query_id, doc_id, round(score / (dn * qn), 6) AS score FROM sp JOIN dn USING (doc_id) JOIN qn USING (query_id)),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bm QUALIFY rank <= 10),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sp QUALIFY rank <= 10),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM co QUALIFY rank <= 10),
paths AS (SELECT *, 'dense' AS path, 0 AS o FROM dense UNION ALL SELECT *, 'sparse', 1 FROM sparse UNION ALL SELECT *, 'bm25', 2 FROM bm25),
s AS (SELECT query_id, CASE WHEN len(w) = 0 THEN 0.5 ELSE greatest(0.2, least(0.8, 0.8 - 0.6 * (len(list_filter(w, lambda x: list_contains({STRUCTURE}, x)))::DOUBLE / len(w)))) END AS s FROM qw),
nm AS (SELECT *, (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p + 1e-6) AS norm FROM paths WINDOW p AS (PARTITION BY query_id, path)),
wide AS (SELECT query_id, doc_id, coalesce(max(norm) FILTER (path = 'dense'), 0) AS dense, coalesce(max(norm) FILTER (path = 'sparse'), 0) AS sparse, coalesce(max(norm) FILTER (path = 'bm25'), 0) AS bm25 FROM nm GROUP BY ALL),
mx AS (SELECT *, (1 - s) * dense + s * (0.5 * sparse + 0.5 * bm25) AS m FROM wide JOIN s USING (query_id)),
fu AS (SELECT query_id, doc_id, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(bm25, 6) AS bm25, round(CASE WHEN dense > 0.85 THEN greatest(m, 0.5) ELSE m END, 6) AS score FROM mx),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM fu QUALIFY rank <= 10),
first AS (SELECT query_id, doc_id, arg_min(path, o) AS first_path, arg_min(rank, o) AS first_rank FROM paths GROUP BY ALL),
gold AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
"""
SCORED = """,
gs AS (SELECT query_id, min(rank) AS first_rank, count(rank) AS found, count(*) AS n_gold FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN {hits} h USING (query_id, doc_id) GROUP BY query_id),
sc AS (SELECT query_id, first_rank, coalesce(first_rank <= 1, false)::INT AS hit_at_1, coalesce(first_rank <= 3, false)::INT AS hit_at_3, round(coalesce(1 / first_rank, 0), 6) AS rr, round(found / n_gold, 6) AS recall FROM gs),
sm AS (SELECT count(*) AS n_questions, count(rr) AS n_scored, round(avg(coalesce(hit_at_1, 0)), 6) AS hit_at_1, round(avg(coalesce(hit_at_3, 0)), 6) AS hit_at_3, round(avg(coalesce(rr, 0)), 6) AS rr, round(avg(coalesce(recall, 0)), 6) AS recall FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN sc USING (query_id))
"""
TOP3 = "(SELECT * FROM {} WHERE rank <= 3)"
SUMMARY = BASE + SCORED.format(hits=TOP3.format("bm25"))

SQL = {
    "bm25_topk": BASE + "SELECT query_id, doc_id, score, rank FROM bm25",
    "indexed_bm25_topk": BASE + "SELECT query_id, doc_id, score, rank FROM bm25",
    "sparse_topk": BASE + "SELECT query_id, doc_id, score, rank FROM sparse",
    "cosine_topk": BASE + "SELECT query_id, doc_id, score, rank FROM dense",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
      x AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(d.e, q.e), 6) AS score FROM v d JOIN v q ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM x QUALIFY rank <= 10""",
    "rrf_fusion": BASE + ", r AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score, count(*) AS n_paths FROM paths GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM r QUALIFY rank <= 10",
    "path_union": BASE + "SELECT * FROM first",
    "minmax_fusion": BASE + "SELECT * FROM fused",
    "funnel_top3": BASE + "SELECT * FROM fused WHERE rank <= 3",
    "funnel_context": BASE + "SELECT query_id, string_agg('[' || rank || '] src:' || source || chr(10) || left(text, 500), chr(10) || chr(10) ORDER BY rank) AS context FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id",
    "query_specificity": f"""WITH c AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'user'), n AS (SELECT *, len(list_filter(w, lambda x: list_contains({STRUCTURE}, x))) AS k FROM c)
      SELECT conv_id, turn, len(w)::BIGINT AS total_tokens, k::BIGINT AS signal_tokens, round(CASE WHEN len(w) = 0 THEN 0.5 ELSE greatest(0.2, least(0.8, 0.8 - 0.6 * (k::DOUBLE / len(w)))) END, 6) AS specificity FROM n""",
    "bm25_vocab_stats": f"""WITH t AS (SELECT unnest({WORDS}) AS token FROM documents), n AS (SELECT count(*) AS n_docs FROM documents)
      SELECT n_docs, count(DISTINCT token) AS vocabulary_size, count(*) AS n_tokens, round(count(*) / n_docs, 6) AS mean_length, 256.0::DOUBLE AS average_document_length FROM t, n GROUP BY n_docs""",
    "gold_pairs": BASE + "SELECT * FROM gold",
    "retrieval_hits": SUMMARY + "SELECT * FROM sc",
    "retrieval_summary": SUMMARY + "SELECT * FROM sm",
    "elimination_stage": BASE
    + """, g AS (SELECT DISTINCT query_id FROM gold), l1 AS (SELECT query_id, min(first_rank) AS l1_rank FROM first JOIN gold USING (query_id, doc_id) GROUP BY 1), l2 AS (SELECT query_id, min(rank) AS l2_rank FROM fused JOIN gold USING (query_id, doc_id) GROUP BY 1), l3 AS (SELECT query_id, min(rank) AS l3_rank FROM fused JOIN gold USING (query_id, doc_id) WHERE rank <= 3 GROUP BY 1)
      SELECT query_id, l1_rank, l2_rank, l3_rank, CASE WHEN l1_rank IS NULL THEN 'l1' WHEN l2_rank IS NULL THEN 'l2' WHEN l3_rank IS NULL THEN 'l3' ELSE 'none' END AS eliminated_at FROM g LEFT JOIN l1 USING (query_id) LEFT JOIN l2 USING (query_id) LEFT JOIN l3 USING (query_id)""",
    "baseline_compare": SUMMARY
    + """, gs2 AS (SELECT query_id, min(rank) AS first_rank, count(rank) AS found, count(*) AS n_gold FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN (SELECT * FROM sparse WHERE rank <= 3) h USING (query_id, doc_id) GROUP BY query_id),
      o AS (SELECT round(avg(coalesce((first_rank <= 1)::INT, 0)), 6) AS old_hit_at_1, round(avg(coalesce((first_rank <= 3)::INT, 0)), 6) AS old_hit_at_3, round(avg(round(coalesce(1 / first_rank, 0), 6)), 6) AS old_rr, round(avg(coalesce(round(found / n_gold, 6), 0)), 6) AS old_recall FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN gs2 USING (query_id))
      SELECT old_hit_at_1, old_hit_at_3, old_rr, old_recall, hit_at_1 AS new_hit_at_1, hit_at_3 AS new_hit_at_3, rr AS new_rr, recall AS new_recall, round(hit_at_1 - old_hit_at_1, 6) AS delta_hit_at_1, round(hit_at_3 - old_hit_at_3, 6) AS delta_hit_at_3, round(rr - old_rr, 6) AS delta_rr, round(recall - old_recall, 6) AS delta_recall, round(hit_at_3 - old_hit_at_3, 6) >= 0 AS passed FROM sm, o""",
}
