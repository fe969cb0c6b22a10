"""Queries on stateful streams; orders stand for rows with a retention, conversations for message threads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.chunks import fixed_chunks
from lexmill.functions.ids import text_sha256
from lexmill.operators.store import expires
from lexmill.plans.corpus_plans import CHUNKS
from lexmill.session import table
from lexmill.sources import deltas
from lexmill.storage import partitions, shared_path
from lexmill.streaming import ingest, publish, stateful

FIRST, SECOND = "1996-01-01 00:00:00", "1997-01-01 00:00:00"


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows put when they were made; those of status F expire after 30 days, others after the usual time."""
    orders = table(spark, sf, "orders")
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(30)))
    until = expires(own, F.col("o_orderdate"))
    return orders.select(F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("id"), F.lit("put").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"), until.cast("timestamp").alias("expires_at"))


def clock(spark: SparkSession, now: str) -> DataFrame:
    """An event that moves the clock to now, an hour being the delay that streams allow for."""
    at = F.to_timestamp(F.lit(now)) + F.expr("interval 1 hour 1 millisecond")
    return spark.range(1).select(F.lit("clock").alias("owner"), F.lit("clock").alias("id"), F.lit("clock").alias("kind"), at.alias("at"), F.lit(None).cast("timestamp").alias("expires_at"))


def retention_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two sweeps a year apart, the second resumed from the first's checkpoint; every seventh order's first removal fails."""
    events, out = shared_path(spark, "events"), shared_path(spark, "sweeps")
    purge = lambda due: due.withColumn("removed", (F.col("id").cast("long") % 7 != 0) | (F.col("attempt") > 1))
    rows, before = order_events(spark, sf), None
    for now in (FIRST, SECOND):
        new = rows.filter((F.col("at") <= F.lit(now)) & (F.lit(True) if before is None else F.col("at") > F.lit(before)))
        new.unionByName(clock(spark, now)).write.mode("append").parquet(events)
        found, before = stateful.sweep(spark, events, out, purge, stores=max(8, partitions(spark))), now
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "attempt", "removed", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


def message_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations said twice, edited and partly removed, arriving last turns first: what arrives is merged before more comes."""
    said = table(spark, sf, "conversations").filter("conv_id is not null and turn is not null")
    base = said.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").cast("string").alias("id"), F.col("turn").cast("long").alias("seq"), F.lit(1).cast("long").alias("version"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("removed"))
    edits = base.filter("seq % 3 = 1").withColumns({"version": F.lit(2).cast("long"), "text": F.concat(F.lit("edited: "), F.col("text")), "seq": F.col("seq") + 100})
    removals = base.filter("seq % 5 = 4").withColumns({"version": F.lit(3).cast("long"), "removed": F.lit(True)})
    messages, out = shared_path(spark, "messages"), shared_path(spark, "threads")
    for part in (removals, edits.unionByName(base.filter("seq > 2")), base):
        part.write.mode("append").parquet(messages)
        merged = stateful.merge_threads(spark, messages, out, stores=max(8, partitions(spark)))
    now = merged.filter("not removed")
    line = F.concat("role", F.lit(": "), "text")
    return now.groupBy(F.col("thread").cast("long").alias("conv_id")).agg(F.count("*").alias("n_messages"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")).alias("thread_md5"))


def delta_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a table: urgent ones replaced, some customers' dropped, a bad change rolled back, then compacted."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    folder = shared_path(spark, "orders")
    first = deltas.create(orders, folder, "o_orderkey")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("N"))
    good = deltas.delete(folder, orders.filter("o_custkey % 10 = 0"), deltas.upsert(folder, urgent, first))
    deltas.upsert(folder, orders.withColumn("o_orderstatus", F.lit("?")), good)
    deltas.rollback(spark, folder, good)
    deltas.upsert(folder, orders.filter("o_custkey % 20 = 0").withColumn("o_orderstatus", F.lit("R")))
    deltas.compact(spark, folder)
    return deltas.read(spark, folder)


def ingest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all documents, ingested as a stream into a table; two calls, of which the second has nothing to do."""
    out, docs = shared_path(spark, "ingest"), f"{sf}/documents.parquet"
    ingest.ingest_stream(spark, docs, out)
    found = ingest.ingest_stream(spark, docs, out)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_points"), F.sum(F.length("chunk_text")).alias("chunk_chars"), F.bit_xor(F.xxhash64("point_id", "sha256")).alias("points_hash"))


def letter_vector(chunks: DataFrame) -> DataFrame:
    """Stands for an embedding: the lengths of a chunk and of its vowels, and one."""
    vowels = F.length("chunk_text") - F.length(F.translate("chunk_text", "aeiou", ""))
    return chunks.withColumn("vector", F.array(F.length("chunk_text").cast("double"), vowels.cast("double"), F.lit(1.0)))


def published_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose chunks all say something, published as articles; English ones activated, an activation of the others
    rolled back as their check finds fault."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    articles = docs.filter("article_id IS NOT NULL").select("article_id", "text", text_sha256(F.col("text")).alias("sha256"), F.greatest(F.ceil((F.length("text") - 200) / 800), F.lit(1)).cast("int").alias("chunk_count"), "lang")
    says = F.forall(F.sequence(F.lit(0), F.col("chunk_count") - 1), lambda k: F.trim(F.substr("text", k * 800 + 1, F.lit(1000))) != "")
    articles = articles.filter(says)  # an article's own chunks, so nothing is gathered
    chunks = fixed_chunks(articles, "text", 1000, 200).select(
        "article_id", "chunk_index", F.concat_ws("#", F.col("article_id").cast("string"), F.col("chunk_index").cast("string")).alias("point_id"), F.col("sha256").alias("article_sha256"),
        F.col("start").cast("long").alias("start"), (F.col("start") + F.length("chunk")).cast("long").alias("end"), F.col("chunk").alias("excerpt"), text_sha256(F.col("chunk")).alias("excerpt_sha256"), F.col("chunk").alias("chunk_text"), "chunk_count",
    )
    paths = {name: shared_path(spark, name) for name in ("articles", "chunks", "collection")}
    articles.write.parquet(paths["articles"])
    chunks.write.parquet(paths["chunks"])
    out = paths["collection"]
    points = publish.publish(spark, paths["articles"], paths["chunks"], out, "documents", "documents", letter_vector, 3)
    written = spark.read.parquet(paths["articles"])
    english = written.filter("lang = 'en'").select("article_id")
    unasked = lambda seen: {"not English": seen.join(english, "article_id", "left_anti").count()}
    publish.activate(spark, out, english, "ops", "2025-01-01", unasked)
    others = written.join(english, "article_id", "left_anti")
    try:
        publish.activate(spark, out, others, "ops", "2025-01-02", unasked)
    except publish.Refused:
        pass  # rolled back; SQL knows English ones as active only
    active = publish.active_points(spark, out).select("point_id", "activated_at")
    joined = points.select("point_id", "article_id", F.length("chunk_text").alias("chars"), F.col("vector")[1].alias("vowels")).join(active, "point_id", "left")
    return joined.groupBy("article_id").agg(F.count("*").alias("n_points"), F.sum("chars").alias("chunk_chars"), F.sum("vowels").cast("long").alias("vowels"), F.max("activated_at").alias("activated_at"))


QUERIES = {f.__name__: f for f in (retention_stream, message_threads, delta_table, ingest_points, published_corpus)}

SQL = {
    "published_corpus": f"""WITH {CHUNKS}, s AS (SELECT doc_id, count(*) AS n_points, sum(length(chunk))::BIGINT AS chunk_chars, sum(length(chunk) - length(translate(chunk, 'aeiou', '')))::BIGINT AS vowels FROM c GROUP BY doc_id HAVING min(length(trim(chunk))) > 0)
      SELECT s.doc_id AS article_id, n_points, chunk_chars, vowels, CASE WHEN lang = 'en' THEN '2025-01-01' END AS activated_at FROM s JOIN documents USING (doc_id)""",
    "retention_stream": f"""WITH o AS (SELECT o_orderkey, o_orderdate AS made, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate + INTERVAL 7 DAY END AS expires_at FROM orders WHERE o_orderdate <= '{SECOND}'),
      d AS (SELECT *, expires_at <= TIMESTAMP '{FIRST}' AND made <= TIMESTAMP '{FIRST}' AS early, o_orderkey % 7 = 0 AS fails FROM o WHERE expires_at <= TIMESTAMP '{SECOND}')
      SELECT o_orderkey, 1 AS attempt, NOT fails AS removed, expires_at FROM d UNION ALL SELECT o_orderkey, 2, true, expires_at FROM d WHERE early AND fails""",
    "delta_table": """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 20 = 0 THEN 'R' WHEN o_orderpriority = '1-URGENT' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
      FROM orders WHERE o_custkey % 10 <> 0 OR o_custkey % 20 = 0""",
    "message_threads": """SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ': ' || CASE WHEN turn % 3 = 1 THEN 'edited: ' ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn)) AS thread_md5
      FROM conversations WHERE turn % 5 <> 4 AND conv_id IS NOT NULL GROUP BY conv_id""",
}
