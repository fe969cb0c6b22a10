"""Queries on corpus ingest: fingerprints, chunks, points, redaction, pages, answers."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import pii
from lexmill.functions.chunks import fixed_chunks, preferred_chunks
from lexmill.functions.ids import text_sha256, uuid5
from lexmill.functions.text import display_source, file_title, fold_blanks, trim_blank_lines, visible, without_tags
from lexmill.operators import governance as G
from lexmill.operators import store
from lexmill.session import table
from lexmill.sources.readers import form_feed_pages


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def fingerprint_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(text_sha256(F.col("text")).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.max(F.length("text")).cast("long").alias("n_chars"))


def ingest_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Later sources meet the fingerprints of the sources before src5."""
    docs = _docs(spark, sf).select("doc_id", "source", text_sha256(F.col("text")).alias("sha256"))
    return store.route_ingest(docs.filter("source >= 'src5'"), docs.filter("source < 'src5'")).select("doc_id", "route")


def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    by_text = _docs(spark, sf).groupBy(text_sha256(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.trim("text") == "").alias("blank"))
    return by_text.agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("chars").alias("total_chars"), F.sum("blank").alias("n_blank"))


def fixed_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    cut = fixed_chunks(_docs(spark, sf).select("doc_id", "text"), "text", 1000, 200)
    return cut.select("doc_id", "chunk_index", F.col("start").cast("long").alias("start"), F.md5("chunk").alias("chunk_md5"))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    per_doc = fixed_chunks(_docs(spark, sf).select("doc_id", "text"), "text", 1000, 200).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))
    return per_doc.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"), F.round(F.avg("n"), 6).alias("mean_chunks"), F.ceil(F.sum("n") / 12).alias("n_batches"), F.sum("chars").alias("chunk_chars"))


def preferred_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    cut = preferred_chunks(_docs(spark, sf).select("doc_id", "text"), "text")
    return cut.select("doc_id", "chunk_index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), text_sha256(F.col("chunk")).alias("sha256"))


def point_rows(spark: SparkSession, sf: str) -> DataFrame:
    cut = fixed_chunks(_docs(spark, sf).select("doc_id", "text"), "text", 1000, 200)
    name = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return cut.select("doc_id", "chunk_index", name.alias("chunk_id"), F.sha1(name).alias("name_sha1"), text_sha256(F.col("chunk")).alias("sha256"))


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", uuid5(uuid.NAMESPACE_URL, F.concat(F.lit("legal-corpus/"), F.col("doc_id").cast("string"))).alias("point_id"))


def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(without_tags(F.coalesce("html", F.lit("")))).alias("text_md5"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    url = F.coalesce(F.regexp_replace("url", r"[?#].*$", ""), F.lit(""))
    return table(spark, sf, "pages").select("page_id", file_title(url).alias("title"), display_source(F.replace(url, F.lit("/en/"), F.lit("/data/"))).alias("shown"))


def redact_cards(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", pii.redacted(F.col("text")).alias("r")).select("doc_id", F.md5("r.text").alias("text_md5"), *[f"r.{k}" for k in (*pii.KINDS, "hidden")])


def redact_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = _docs(spark, sf).select("source", pii.redacted(F.col("text")).alias("r"))
    return found.groupBy("source").agg(*[F.sum(f"r.{k}").alias(k) for k in pii.KINDS], F.sum("r.hidden").alias("hidden"))


def text_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.md5(fold_blanks(t)).alias("folded_md5"), F.md5(trim_blank_lines(t)).alias("trimmed_md5"), F.length(visible(t)).cast("long").alias("visible_chars"))


def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stand for pages: their mode, coverage and the pages that failed, by document."""
    lines = form_feed_pages(_docs(spark, sf).withColumn("text", F.translate("text", "\n", "\f")), "doc_id", "text")
    moded = lines.withColumn("mode", G.page_mode(F.col("text")))
    n = lambda m: F.count_if(F.col("mode") == m).alias(m)
    failed = F.array_join(F.sort_array(F.collect_set(F.when(F.trim("text") == "", F.col("page_no")))), ",").alias("failed_pages")
    return moded.groupBy("doc_id").agg(F.count("*").alias("n_pages"), n("native"), n("hybrid"), n("scanned"), F.round(F.count_if(F.trim("text") != "") / F.count("*"), 4).alias("coverage"), failed)


def token_max_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Each token's largest count in one document."""
    from lexmill.operators.retrieval import term_counts

    return term_counts(_docs(spark, sf), "doc_id", "text").groupBy("token").agg(F.max("tf").alias("max_weight"), F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (fingerprint_dedupe, ingest_routing, validation_report, fixed_chunk_rows, chunk_stats, preferred_chunk_rows, point_rows, point_ids, html_strip, page_titles, redact_cards, redact_counts, text_normal_forms, page_quality, token_max_weights)}

D = "d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
CHUNKS = f"{D}, c AS (SELECT doc_id, i::INT AS chunk_index, (i * 800)::BIGINT AS start, substr(text, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 800.0), 1)::BIGINT)) AS i FROM d))"

SQL = {
    "fingerprint_dedupe": f"WITH {D} SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies, max(length(text))::BIGINT AS n_chars FROM d GROUP BY sha256(text)",
    "ingest_routing": f"WITH {D}, h AS (SELECT doc_id, source, sha256(text) AS h FROM d), k AS (SELECT h, max(source) AS s FROM h WHERE source < 'src5' GROUP BY h) SELECT doc_id, CASE WHEN s IS NULL THEN 'store' WHEN s = source THEN 'skip' ELSE 'sync' END AS route FROM h LEFT JOIN k USING (h) WHERE source >= 'src5'",
    "validation_report": f"WITH {D} SELECT count(*) AS n_docs, count(DISTINCT text) AS n_texts, count(*) - count(DISTINCT text) AS n_duplicates, sum(length(text))::BIGINT AS total_chars, count(*) FILTER (trim(text) = '') AS n_blank FROM d",
    "fixed_chunk_rows": f"WITH {CHUNKS} SELECT doc_id, chunk_index, start, md5(chunk) AS chunk_md5 FROM c",
    "chunk_stats": f"WITH {CHUNKS}, p AS (SELECT doc_id, count(*) AS n, sum(length(chunk))::BIGINT AS chars FROM c GROUP BY doc_id) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_chunks, min(n) AS min_chunks, max(n) AS max_chunks, round(avg(n), 6) AS mean_chunks, ceil(sum(n) / 12.0)::BIGINT AS n_batches, sum(chars)::BIGINT AS chunk_chars FROM p",
    "point_rows": f"WITH {CHUNKS} SELECT doc_id, chunk_index, doc_id || '#' || chunk_index AS chunk_id, sha1(doc_id || '#' || chunk_index) AS name_sha1, sha256(chunk) AS sha256 FROM c",
    "point_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('legal-corpus/' || doc_id)) AS s FROM documents)
      SELECT doc_id, concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), '5' || substr(s, 14, 3), printf('%02x', (('0x' || substr(s, 17, 2))::INT & 63) | 128) || substr(s, 19, 2), substr(s, 21, 12)) AS point_id FROM h""",
    "html_strip": "SELECT page_id, md5(trim(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'))) AS text_md5 FROM pages",
    "page_titles": r"WITH p AS (SELECT page_id, coalesce(regexp_replace(url, '[?#].*$', ''), '') AS u FROM pages), s AS (SELECT *, regexp_extract(u, '([^/]*)$', 1) AS f, replace(u, '/en/', '/data/') AS r FROM p) SELECT page_id, CASE WHEN regexp_matches(f, '^.+\.[^.]*$') THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END AS title, CASE WHEN strpos(r, '/data/') > 0 THEN substr(r, strpos(r, '/data/') + 6) ELSE r END AS shown FROM s",
    "page_quality": f"""WITH {D}, l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(\\n\\s*)+$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '(\\n\\s*)+$', ''), chr(10)), 1) AS page_no FROM d),
      m AS (SELECT *, length(regexp_replace(line, '\\s', '', 'g')) AS n FROM l)
      SELECT doc_id, count(*) AS n_pages, count(*) FILTER (n >= 50) AS native, count(*) FILTER (n >= 20 AND n < 50) AS hybrid, count(*) FILTER (n < 20) AS scanned, round(count(*) FILTER (trim(line) <> '') / count(*), 4) AS coverage, coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (trim(line) = ''), '') AS failed_pages FROM m GROUP BY doc_id""",
    "token_max_weights": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS t FROM documents), n AS (SELECT doc_id, lower(t) AS token, count(*) AS tf FROM w GROUP BY ALL) SELECT token, max(tf) AS max_weight, count(*) AS n_docs FROM n GROUP BY token",
}
