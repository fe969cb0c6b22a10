"""Queries on prepared corpora, vectors, payloads and review facts; the given tables stand for them, with faults that follow
from ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.chunks import fixed_chunks
from lexmill.functions.ids import text_sha256
from lexmill.operators import evaluation as E
from lexmill.operators import prepared as P
from lexmill.operators import retrieval as R
from lexmill.operators import review as V
from lexmill.session import table


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as articles, and their chunks of 1000 characters; some ids lack an article, a hash or a number."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"))
    i, n = F.col("article_id"), F.greatest(F.ceil((F.length("text") - 200) / 800), F.lit(1)).cast("int")
    articles = docs.select(i, "text", F.when(i % 29 == 0, "x").otherwise(text_sha256(F.col("text"))).alias("sha256"), F.when(i % 31 == 0, n + 1).otherwise(n).alias("chunk_count"))
    counts = articles.select(i, "chunk_count", F.col("sha256").alias("article_sha256"))
    cut = fixed_chunks(docs.join(counts, "article_id"), "text", 1000, 200)  # joined before it is cut, as a chunk repeats what its neighbours say
    start, end = F.col("start").cast("long"), F.col("start").cast("long") + F.length("chunk")
    chunks = cut.select(
        i, F.when(i % 17 == 0, F.col("chunk_index") * 2).otherwise(F.col("chunk_index")).alias("chunk_index"), F.when(i % 37 == 0, F.lit("p")).otherwise(F.concat_ws("#", i.cast("string"), F.col("chunk_index").cast("string"))).alias("point_id"),
        start.alias("start"), F.when(i % 41 == 0, end + 10_000_000).otherwise(end).alias("end"), F.when(i % 23 == 0, F.upper("chunk")).otherwise(F.col("chunk")).alias("excerpt"), text_sha256(F.col("chunk")).alias("excerpt_sha256"), F.col("chunk").alias("chunk_text"),
        "chunk_count", "article_sha256",
    )
    return articles.filter(i % 19 != 0), chunks


def article_checks(spark: SparkSession, sf: str) -> DataFrame:
    articles, chunks = _prepared(spark, sf)
    return P.article_errors(articles, chunks).select("article_id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


def chunk_checks(spark: SparkSession, sf: str) -> DataFrame:
    articles, chunks = _prepared(spark, sf)
    found = P.chunk_errors(articles, chunks).select(F.explode("errors").alias("error"), "article_id")
    return found.groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("n_articles"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    i = F.col("doc_id")
    return docs.select(
        "doc_id", F.left(F.trim("text"), F.lit(20)).alias("title"), F.when(F.col("lang") == "en", "A").otherwise("B").alias("source_level"), F.when(i % 7 == 0, "rag_chunks").otherwise("legal_docs").alias("target_collection"), F.when(i % 5 == 0, "废止").otherwise(P.IN_FORCE).alias("status"),
        F.when(i % 11 == 0, "2024-1-1").otherwise("2024-01-01").alias("effective_date"), F.concat(F.when(i % 3 == 0, "http://").otherwise("https://"), "source").alias("official_url"), F.concat(F.when(i % 13 == 0, "../").otherwise("raw/"), "source").alias("raw_file"), F.lit("md/x").alias("markdown_file"),
        F.md5("text").alias("raw_sha256"), F.when(i % 17 == 0, "x").otherwise(F.md5("text")).alias("raw_found"), F.lit("m").alias("markdown_sha256"), F.lit("m").alias("markdown_found"), F.when(i % 2 == 0, 3).otherwise(1).alias("status_code"),
    )


def source_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("doc_id", F.array_join(P.source_errors("legal_docs"), ",").alias("errors"))


def activation_checks(spark: SparkSession, sf: str) -> DataFrame:
    found = P.activation_errors("legal_docs", "https://")
    done = P.activated(_sources(spark, sf).withColumn("errors", found), "ops", "2025-01-01", F.size("errors") == 0)
    return done.select("doc_id", F.array_join("errors", ",").alias("errors"), "activation_status", "activated_by", "activated_at")


def vector_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of which some are cut or spoilt."""
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    spoilt = F.when(i % 50 == 0, F.slice(v, 1, 63)).when(i % 51 == 0, F.transform(v, lambda x: x * 0)).when(i % 53 == 0, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("inf"))))).otherwise(v)
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(P.vector_errors(spoilt, 64), ",").alias("errors"), F.round(F.get(P.normalised(F.transform(v, lambda x: x * 3)), 0), 6).alias("first_normalised"))


def archive_check(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")))
    return P.archive_summary(table(spark, sf, "documents").select((F.col("doc_id") % 900).alias("record_id"), "source", words.alias("n")), "record_id", "source", F.col("n"))


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyword_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


PRIVATE = ("user_id", "token", "path")


def private_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each event nested in a payload of its own, its kind deciding what is inside."""
    inner = F.when(F.col("event_type") == "error", F.format_string('{"auth":{"token":"t"},"files":[{"k":%d},{"path":"/x"}]}', "event_id"))
    payload = F.coalesce(inner, F.when(F.col("event_type") == "view", F.to_json(F.struct("user_id", F.col("props").alias("text")))), F.col("props"))
    events = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return events.select("event_id", F.array_join(F.array_sort(P.private_key_paths(PRIVATE)("payload")), ",").alias("paths"), F.array_join(P.payload_errors(F.col("payload"), PRIVATE, ('"k":7', "/x")), ",").alias("errors"))


def fact_views(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as fact drafts: status, what may be done, the first state and the question."""
    n, value = (F.col("l_linenumber") % 3).cast("int"), F.when(F.col("l_tax") == 0, "unknown").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    given = F.when(F.col("l_returnflag") == "A", "contradicted").when(F.col("l_returnflag") == "R", "confirmed").otherwise("extracted")
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("name"), n.alias("n"), value.alias("value"), given.alias("given"), (F.col("l_quantity") / 40).alias("sure"), (F.col("l_discount") > 0.09).alias("flagged"))
    built = facts.withColumns(V.built_fact(F.col("value"), F.col("given"), F.col("n"), F.col("sure"), F.col("flagged")))
    state = V.initial_state(F.col("needs_confirmation"), F.col("value"))
    actions = V.allowed_actions(F.col("status"), F.col("needs_confirmation"), F.col("value"), F.col("n"))
    return built.select("l_orderkey", "l_linenumber", "status", "needs_confirmation", F.array_join(actions, ",").alias("actions"), state["state"].alias("state"), state["effective_value"].alias("effective_value"), V.confirmation_question(F.col("name"), F.col("status"), F.col("n")).alias("question"))


def review_states(spark: SparkSession, sf: str) -> DataFrame:
    return V.review_status(fact_views(spark, sf), "l_orderkey", "state", "question")


def first_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Events as hits: users are reviews, kinds are queries, the props name the source."""
    hits = table(spark, sf, "events").select("user_id", "props", "event_type", "event_id")
    return V.first_sources(hits, "user_id", ["props"], ["event_type", "event_id"])


def generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Events as answers to half of the questions; their values are latencies."""
    rows = table(spark, sf, "events").filter("event_type <> 'error'").select("event_id", F.col("value").alias("retrieval"), (F.col("value") * 2).alias("generation"), F.col("props").alias("answer"))
    return E.generation_summary(rows, table(spark, sf, "events").select("event_id"), "event_id", "retrieval", "generation", "answer")


QUERIES = {f.__name__: f for f in (article_checks, chunk_checks, source_checks, activation_checks, vector_checks, archive_check, keyword_topk, private_paths, fact_views, review_states, first_sources, generation_summary)}

PREPARED = """WITH d AS (SELECT doc_id AS article_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, greatest(ceil((length(text) - 200) / 800.0), 1)::INT AS n FROM d),
aa AS (SELECT article_id, text, CASE WHEN article_id % 29 = 0 THEN 'x' ELSE sha256(text) END AS sha256, CASE WHEN article_id % 31 = 0 THEN n + 1 ELSE n END AS chunk_count FROM n),
a AS (SELECT * FROM aa WHERE article_id % 19 <> 0),
c0 AS (SELECT article_id, unnest(range(n::BIGINT)) AS i, text FROM n),
c1 AS (SELECT article_id, i, i * 800 AS start, substr(text, i * 800 + 1, 1000) AS chunk FROM c0),
c AS (SELECT c1.article_id, CASE WHEN c1.article_id % 17 = 0 THEN i * 2 ELSE i END AS chunk_index, CASE WHEN c1.article_id % 37 = 0 THEN 'p' ELSE c1.article_id || '#' || i END AS point_id, start,
  CASE WHEN c1.article_id % 41 = 0 THEN start + length(chunk) + 10000000 ELSE start + length(chunk) END AS "end", CASE WHEN c1.article_id % 23 = 0 THEN upper(chunk) ELSE chunk END AS excerpt, sha256(chunk) AS excerpt_sha256, chunk AS chunk_text, aa.sha256 AS article_sha256, chunk_count
  FROM c1 JOIN aa ON c1.article_id = aa.article_id)
"""
LIST = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
SOURCES = """WITH s AS (SELECT doc_id, left(trim(coalesce(text, ''), ' '), 20) AS title, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS level, CASE WHEN doc_id % 7 = 0 THEN 'rag_chunks' ELSE 'legal_docs' END AS target, CASE WHEN doc_id % 5 = 0 THEN '废止' ELSE '有效' END AS status,
 CASE WHEN doc_id % 11 = 0 THEN '2024-1-1' ELSE '2024-01-01' END AS day, CASE WHEN doc_id % 3 = 0 THEN 'http://' ELSE 'https://' END AS url, doc_id % 13 = 0 AS outside, doc_id % 17 = 0 AS spoilt, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS code FROM documents)
"""


def _names(**checks: str) -> str:
    return LIST.format(", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()))


FACTS = """WITH f AS (SELECT l_orderkey, l_linenumber, l_linestatus AS name, l_linenumber % 3 AS n, CASE WHEN l_tax = 0 THEN 'unknown' ELSE l_shipdate::DATE::VARCHAR END AS value, CASE l_returnflag WHEN 'A' THEN 'contradicted' WHEN 'R' THEN 'confirmed' ELSE 'extracted' END AS given, greatest(0, least(1, l_quantity / 40)) AS sure, l_discount > 0.09 AS flagged FROM lineitem),
g AS (SELECT *, CASE WHEN given = 'contradicted' THEN given WHEN value = 'unknown' THEN 'missing' WHEN n = 0 OR sure < 0.65 THEN 'needs_confirmation' WHEN given = 'confirmed' THEN 'confirmed' ELSE 'extracted' END AS status FROM f),
h AS (SELECT *, flagged OR status IN ('missing', 'contradicted', 'needs_confirmation') AS needs_confirmation FROM g),
v AS (SELECT l_orderkey, l_linenumber, status, needs_confirmation, CASE WHEN status = 'confirmed' AND NOT needs_confirmation AND value <> 'unknown' AND n > 0 THEN 'confirm,' ELSE '' END || CASE WHEN n > 0 THEN 'correct,' ELSE '' END || 'supplement,not_applicable,defer' AS actions,
  CASE WHEN needs_confirmation THEN 'unreviewed' ELSE 'confirmed' END AS state, CASE WHEN NOT needs_confirmation THEN value END AS effective_value,
  CASE WHEN status = 'missing' THEN '请补充或确认合同中的“' || name || '”信息。' WHEN status = 'contradicted' THEN '合同中“' || name || '”出现不一致，请确认以哪一处内容为准。' WHEN n = 0 THEN '请确认“' || name || '”的原文位置和具体内容。' ELSE '请确认合同中的“' || name || '”是否准确。' END AS question FROM h)
"""
SQL = {
    "article_checks": PREPARED
    + ", h AS (SELECT article_id, count(*) AS n, count(DISTINCT chunk_index) AS k, min(chunk_index) AS lo, max(chunk_index) AS hi, min(chunk_count) AS a, max(chunk_count) AS b FROM c GROUP BY 1) SELECT a.article_id, "
    + _names(count_differs="h.n > 0 AND (h.a <> a.chunk_count OR h.b <> a.chunk_count)", hash_differs="a.sha256 <> sha256(a.text)", missing_text="a.text = ''", no_chunks="h.n IS NULL", not_contiguous="h.n > 0 AND (k <> h.n OR lo <> 0 OR hi <> h.n - 1)", wrong_count="a.chunk_count <> coalesce(h.n, 0)")
    + " AS errors FROM a LEFT JOIN h USING (article_id)",
    "chunk_checks": PREPARED
    + """, p AS (SELECT point_id, count(*) AS n FROM c GROUP BY 1), j AS (SELECT c.*, p.n AS n_points, a.text, a.sha256, a.article_id IS NOT NULL AS known, start < c."end" AS span FROM c JOIN p USING (point_id) LEFT JOIN a ON c.article_id = a.article_id), e AS (SELECT article_id, unnest(list_filter([CASE WHEN n_points > 1 THEN 'repeated_point' END,
 CASE WHEN NOT known THEN 'unknown_article' END, CASE WHEN known AND article_sha256 <> sha256 THEN 'other_article' END, CASE WHEN NOT span THEN 'bad_span' END, CASE WHEN known AND span AND "end" > length(text) THEN 'beyond_article' END, CASE WHEN known AND span AND "end" <= length(text) AND excerpt <> substr(text, start + 1, "end" - start) THEN 'excerpt_differs' END,
 CASE WHEN excerpt_sha256 <> sha256(excerpt) THEN 'hash_differs' END, CASE WHEN trim(chunk_text, ' ') = '' THEN 'blank_text' END], lambda x: x IS NOT NULL)) AS error FROM j) SELECT error, count(*) AS n, count(DISTINCT article_id) AS n_articles FROM e GROUP BY 1""",
    "source_checks": SOURCES + "SELECT doc_id, " + _names(missing_title="title = ''", level_not_a="level <> 'A'", wrong_collection="target <> 'legal_docs'", not_in_force="status <> '有效'", bad_date="day = '2024-1-1'", not_https="url = 'http://'", outside_folder="outside", raw_hash_differs="spoilt") + " AS errors FROM s",
    "activation_checks": SOURCES
    + ", e AS (SELECT doc_id, "
    + _names(wrong_collection="target <> 'legal_docs'", level_not_a="level <> 'A'", not_official="url = 'http://'", wrong_status_code="code <> 3", not_in_force="status <> '有效'", bad_date="day = '2024-1-1'")
    + " AS errors FROM s) SELECT doc_id, errors, CASE WHEN errors = '' THEN 'ACTIVE' ELSE 'PENDING' END AS activation_status, CASE WHEN errors = '' THEN 'ops' END AS activated_by, CASE WHEN errors = '' THEN '2025-01-01' END AS activated_at FROM e",
    "vector_checks": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'wrong_dimension' WHEN vec_id % 51 = 0 THEN 'zero_vector' WHEN vec_id % 53 = 0 THEN 'not_finite' ELSE '' END AS errors, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_normalised FROM v",
    "archive_check": "WITH d AS (SELECT doc_id % 900 AS r, source, len(list_distinct(string_split(lower(coalesce(text, '')), ' '))) AS n FROM documents), b AS (SELECT r, count(*) AS k FROM d GROUP BY 1) SELECT count(*) AS records, count(DISTINCT source) AS documents, (SELECT count(*) FROM b WHERE k > 1) AS repeated_ids, min(n)::INT AS min_terms, max(n)::INT AS max_terms FROM d",
    "keyword_topk": r"""WITH q AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(left(text, 100), '\s+'), lambda x: x <> '') AS w FROM benchmark), s AS (SELECT query_id, doc_id, round(len(list_filter(w, lambda x: contains(text, x))) / len(w), 6) AS score FROM documents JOIN q ON len(list_filter(w[1:5], lambda x: contains(text, x))) > 0)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10""",
    "private_paths": """SELECT event_id, CASE event_type WHEN 'error' THEN '$.auth.token,$.files[1].path' WHEN 'view' THEN '$.user_id' ELSE '' END AS paths, array_to_string(list_filter([CASE WHEN event_type IN ('error', 'view') THEN 'private_keys' END,
      CASE WHEN event_type = 'error' AND event_id::VARCHAR LIKE '7%' THEN 'sentinel_1' END, CASE WHEN event_type = 'error' THEN 'sentinel_2' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""",
    "fact_views": FACTS + "SELECT * FROM v",
    "review_states": FACTS + "SELECT l_orderkey, count(*) FILTER (state = 'unreviewed') AS n_pending, min(question) FILTER (state = 'unreviewed') AS first_question, CASE WHEN count(*) FILTER (state = 'unreviewed') > 0 THEN 'awaiting_confirmation' ELSE 'ready' END AS status FROM v GROUP BY 1",
    "first_sources": "SELECT user_id, props, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_type, event_id) = 1",
    "generation_summary": """WITH r AS (SELECT event_id, value AS a, value * 2 AS g, value + value * 2 AS t, props FROM events WHERE event_type <> 'error'), j AS (SELECT e.event_id, r.* EXCLUDE (event_id), r.event_id IS NOT NULL AS done FROM events e LEFT JOIN r USING (event_id))
      SELECT count(*) AS total_questions, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS failed, round(avg(a), 6) AS mean_retrieval, round(avg(g), 6) AS mean_generation, round(avg(t), 6) AS mean_total, round(quantile_disc(t, 0.5), 6) AS p50_total, round(quantile_disc(t, 0.95), 6) AS p95_total, round(max(t), 6) AS max_total, round(avg(length(props)), 6) AS mean_answer_chars FROM j""",
}
