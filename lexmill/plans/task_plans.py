"""Queries on tasks, reports, payloads and artifacts; orders stand for reviews, their lines for sources, documents for articles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.chunks import fixed_chunks
from lexmill.functions.ids import text_sha256
from lexmill.operators import tasks as K
from lexmill.operators.conversation import transcript
from lexmill.session import table

URL = "https://law.example/"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def payload_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as payloads, of which some lack a key."""
    pairs = {"doc_id": F.col("doc_id").cast("string"), "chunk_text": F.col("text"), "source": F.col("source"), "user_id": F.lit("u"), "chapter": F.col("lang"), "article_no": F.when(F.col("doc_id") % 3 > 0, F.col("n_chars").cast("string"))}
    payload = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    hit = _docs(spark, sf).select(K.adapted_hit(payload).alias("h")).select("h.*")
    keys = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return hit.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "title", F.md5("context_text").alias("context_md5"), keys.alias("metadata"))


def report_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reports, their lines as sources; lines of every seventh order are left out."""
    i, n = F.col("l_partkey"), F.col("l_linenumber")
    sources = table(spark, sf, "lineitem").filter("l_orderkey % 7 <> 0").select(
        "l_orderkey", F.when(i % 11 > 0, "A").otherwise("B").alias("source_level"), (F.col("l_suppkey") % 13 > 0).alias("citation_eligible"), (n - 1 + (i % 5 > 0).cast("int")).alias("rank"), F.concat(F.when(i % 3 > 0, URL).otherwise(" http://x/"), i.cast("string")).alias("official_url"),
        F.col("l_shipdate").cast("string").alias("effective_date"), F.when(i % 17 == 0, " ").when(i % 17 == 1, "序言").otherwise("第一条").alias("citation_label"), F.when(i % 19 > 0, F.col("l_linestatus")).alias("quote"), F.when(i % 4 > 0, "ACTIVE").when(i % 8 > 0, "PENDING_LEGAL_REVIEW").alias("legal_activation_status"),
    )
    reports = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return K.report_citations(reports, sources, "l_orderkey", URL).withColumn("errors", F.array_join("errors", ","))


def unfinished_tasks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "extracting").when(F.col("o_orderstatus") == "P", "needs_confirmation").when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("ready")
    running = F.when(F.col("o_orderkey") % 2 == 0, "running").when(F.col("o_orderkey") % 5 > 0, "ready")
    tasks = table(spark, sf, "orders").select("o_orderkey", status.alias("status"), running.alias("extraction_status"))
    ended = tasks.filter(K.terminal(F.col("status"), F.col("extraction_status"))).select("o_orderkey", F.lit("ended").alias("step"))
    return K.unfinished(tasks).select("o_orderkey", "step").unionByName(ended)


NOW = "1997-01-01 00:00:00"


def owned_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks, their lines as report versions."""
    orders = table(spark, sf, "orders")
    t, ends = F.col("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(400)))
    tasks = orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), t.alias("created_at"), ends.alias("expires_at"), F.when(F.col("o_orderkey") % 5 == 0, t).alias("deleted_at"))
    reports = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("report_version"), F.col("l_partkey").alias("report_id"))
    return K.owned_reports(tasks, reports, "o_orderkey", F.to_timestamp_ntz(F.lit(NOW)))


def handled_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as confirmations of their users' tasks; every tenth event is sent again, some by another user."""
    events = table(spark, sf, "events")
    confirmations = events.select("user_id", F.col("event_type").alias("request_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("confirmation_id")).withColumnRenamed("user_id", "task")
    tasks = events.select(F.col("user_id").alias("task"), F.col("user_id")).distinct()
    again = events.filter("event_id % 10 = 0").select(F.col("user_id").alias("task"), F.when(F.col("event_id") % 20 == 0, -1).otherwise(F.col("user_id")).alias("user_id"), F.col("event_type").alias("request_id")).distinct()
    return K.handled_requests(again, confirmations, tasks, "task").select("task", "user_id", "request_id", "confirmation_id")


def status_flips(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    done = table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return K.flipped(orders, done, "o_orderkey", o_orderstatus="A", o_orderpriority="0")


def approval_state(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as artifacts that were approved; since then some changed, went or came."""
    docs, i = _docs(spark, sf), F.col("doc_id")
    approved = docs.filter("doc_id % 6 <> 0").select(i.alias("name"), text_sha256(F.col("text")).alias("sha256"))
    present = docs.filter("doc_id % 7 <> 0").select(i.alias("name"), text_sha256(F.when(i % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("sha256"))
    return K.approval_state(approved, present)


def parsed_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as tool messages: a transcript, a list of texts, or no JSON."""
    talk = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    legacy = transcript(talk, "conv_id", "turn", "role", "text")
    listed = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    message = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct("context"))).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct(F.col("roles").alias("contexts")))).otherwise(F.col("context"))
    found = legacy.join(listed, "conv_id").select("conv_id", K.tool_contexts(message).alias("c"))
    return found.select("conv_id", F.size("c").alias("n_contexts"), F.md5(F.array_join("c", "|")).alias("contexts_md5"))


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a stream's body: a comment, its props, text that is no JSON, its kind, and an unfinished frame."""
    body = F.concat(F.lit(":keepalive\n\nevent: x\ndata: "), F.coalesce("props", F.lit("null")), F.lit("\n\ndata: done!\n\ndata: \""), F.coalesce("event_type", F.lit("")), F.lit("\"\n\ndata: {}"))
    return table(spark, sf, "events").select("event_id", F.array_join(K.stream_events(body), "\n").alias("events"))


def answer_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Assistants' turns as answers with documents whose ranks and ids are spoilt here and there."""
    i = F.col("conv_id") * 10 + F.col("turn")
    documents = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(F.when(i % 7 == 0, k + 1).otherwise(k).alias("rank"), F.when((i % 5 > 0) | (k < 3), k.cast("string")).alias("chunk_id")))
    documents = F.when(i % 11 > 0, documents)
    contexts = F.when(i % 3 > 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.array_join(K.answer_errors(F.col("text"), contexts, documents), ",").alias("errors"))


def question_set(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as questions about articles, of which some are incomplete: what is wrong, and the questions' wording."""
    i, no = F.col("doc_id"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("条")))
    expected = F.struct(i.cast("string").alias("doc_id"), F.coalesce(no, F.lit(" ")).alias("article_no"), F.when(i % 6 > 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("required_terms"))
    asked = _docs(spark, sf).select((i - (i % 9 == 0).cast("long")).cast("string").alias("question_id"), K.direct_question(F.col("source"), no).alias("query"), expected.alias("expected"))
    return K.question_errors(asked, ["doc_id", "article_no"]).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("n_ids"))


def cross_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the next one."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("string").alias("no"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("other"), F.col("no").alias("other_no"))
    return docs.join(other, "doc_id").select("doc_id", K.cross_question(F.col("source"), F.col("no"), F.col("other"), F.col("other_no")).alias("question"))


def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fixed_chunks(_docs(spark, sf).select("doc_id", "text"), "text", 1000, 200)
    return K.manifest(chunks, "doc_id", "chunk", 64, 1000, 200).select("*", F.array_join(K.manifest_errors(), ",").alias("errors")).drop("content_digest")


def rendered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as blocks; a document's first line that isn't blank is its title."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    trimmed = K.strip(F.col("line"))
    first = lines.filter(trimmed != "").groupBy("doc_id").agg(F.min_by(trimmed, "line_no").alias("title"))
    return K.rendered(lines.join(first, "doc_id", "left"), "doc_id", "line_no", "line", "title").select("doc_id", "n_paragraphs", F.md5("markdown").alias("markdown_md5"))


def contract_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as contracts, their turns as pages."""
    talk = table(spark, sf, "conversations")
    tasks = talk.groupBy("conv_id").agg(F.to_json(F.struct(F.count("*").alias("pages"))).alias("facts"))
    found = K.contract_context(tasks, talk.filter("conv_id % 5 > 0").select("conv_id", F.col("turn").alias("page_no"), "text"), "conv_id", {"facts": "facts"}, 2000)
    return found.select("conv_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


QUERIES = {f.__name__: f for f in (payload_metadata, report_citations, unfinished_tasks, owned_reports, handled_requests, status_flips, approval_state, parsed_contexts, event_frames, answer_contract, question_set, cross_questions, corpus_manifest, rendered_documents, contract_contexts)}

NAMES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def _names(**checks: str) -> str:
    return ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items())


SQL = {
    "payload_metadata": "SELECT doc_id, source, '' AS title, md5(left(coalesce(text, ''), 500)) AS context_md5, CASE WHEN doc_id % 3 > 0 THEN 'article_no=' || n_chars || ',' ELSE '' END || 'chapter=' || lang AS metadata FROM documents",
    "report_citations": "WITH e AS (SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list_distinct(list_filter(flatten(list(["
    + _names(wrong_level="l_partkey % 11 = 0", not_eligible="l_suppkey % 13 = 0", bad_rank="l_linenumber - 1 + (l_partkey % 5 > 0)::INT < 1", other_url="l_partkey % 3 = 0", missing_label="l_partkey % 17 = 0", label_without_article="l_partkey % 17 = 1", missing_quote="l_partkey % 19 = 0", bad_status="l_partkey % 8 = 0", not_active="l_partkey % 8 = 4")
    + "])), lambda x: x IS NOT NULL))), ',') AS errors FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), r AS (SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n_sources, CASE WHEN n IS NULL THEN 'no_sources' ELSE errors END AS errors FROM orders LEFT JOIN e ON o_orderkey = l_orderkey) SELECT *, errors = '' AS passed FROM r",
    "unfinished_tasks": """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'extracting' WHEN 'P' THEN 'needs_confirmation' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'ready' END END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'running' WHEN o_orderkey % 5 > 0 THEN 'ready' END AS x FROM orders)
      SELECT o_orderkey, CASE WHEN s = 'extracting' THEN 'process' WHEN s <> 'failed' AND x = 'running' THEN 'extract' ELSE 'ended' END AS step FROM t WHERE s IN ('extracting', 'failed') OR x IS NOT NULL""",
    "owned_reports": """SELECT o_orderkey, o_custkey AS user_id, l_linenumber AS report_version, l_partkey AS report_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 AND o_orderdate + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 400 DAY ELSE INTERVAL 7 DAY END > TIMESTAMP '1997-01-01'
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1""",
    "handled_requests": "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 10 = 0 AND event_id % 20 <> 0) SELECT user_id AS task, user_id, event_type AS request_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS confirmation_id FROM events JOIN a USING (user_id, event_type) GROUP BY 1, 2, 3",
    "status_flips": "WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 7) SELECT o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'A' END AS o_orderstatus, CASE WHEN k IS NULL THEN o_orderpriority ELSE '0' END AS o_orderpriority FROM orders LEFT JOIN d ON k = o_orderkey",
    "approval_state": "SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 5 = 0 AND upper(coalesce(text, '')) <> coalesce(text, '') THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE doc_id % 6 <> 0 OR doc_id % 7 <> 0",
    "parsed_contexts": r"""WITH t AS (SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS c, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1),
      p AS (SELECT *, list_filter(list_transform(string_split(c, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM t),
      b AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN list_transform(parts, lambda x: CASE WHEN contains(x, chr(10)) THEN regexp_replace(substr(x, strpos(x, chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE x END) WHEN 1 THEN roles ELSE []::VARCHAR[] END AS c FROM p)
      SELECT conv_id, len(c)::INT AS n_contexts, md5(coalesce(array_to_string(c, '|'), '')) AS contexts_md5 FROM b""",
    "event_frames": """SELECT event_id, coalesce(props, 'null') || chr(10) || '"' || coalesce(event_type, '') || '"' AS events FROM events""",
    "answer_contract": "WITH a AS (SELECT conv_id, turn, conv_id * 10 + turn AS i, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, "
    + NAMES.format(_names(missing_answer=r"regexp_matches(t, '^\s*$')", missing_documents="i % 11 = 0", counts_differ="i % 11 > 0 AND i % 3 = 0", ranks_not_contiguous="i % 11 > 0 AND i % 7 = 0", missing_chunk_id="i % 11 > 0 AND i % 5 = 0"))
    + " AS errors FROM a",
    "question_set": "WITH q AS (SELECT doc_id - (doc_id % 9 = 0)::INT AS qid, doc_id AS i FROM documents), s AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM q), e AS (SELECT qid, " + NAMES.format(_names(repeated_id="n > 1", missing_article_no="i % 4 = 0", bad_terms="i % 6 = 0")) + " AS errors FROM s) SELECT errors, count(*) AS n, count(DISTINCT qid) AS n_ids FROM e GROUP BY 1",
    "cross_questions": "SELECT d.doc_id, '劳动合同审查同时涉及《' || d.source || '》' || d.n_chars || '和《' || o.source || '》' || o.n_chars || '时，两条规定分别解决什么问题？' AS question FROM documents d JOIN documents o ON o.doc_id = d.doc_id + 1",
    "corpus_manifest": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, substr(t, i * 800 + 1, 1000) AS c FROM (SELECT *, unnest(range(greatest(ceil((length(t) - 200) / 800.0), 1)::BIGINT)) AS i FROM d))
      SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(length(c))::BIGINT AS characters, 64 AS vector_dim, 1000 AS chunk_size, 200 AS chunk_overlap, '' AS errors FROM c""",
    "rendered_documents": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents), s AS (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p FROM s WHERE line <> ''), t AS (SELECT doc_id, line AS title FROM k WHERE p = 1), b AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS body, count(*) AS np FROM k WHERE p > 1 GROUP BY 1)
      SELECT d.doc_id, coalesce(np, 0) AS n_paragraphs, md5('# ' || coalesce(title, '') || coalesce(chr(10) || chr(10) || body, '') || chr(10)) AS markdown_md5 FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "contract_contexts": """WITH t AS (SELECT conv_id, count(*) AS n, string_agg('[第 ' || turn || ' 页]' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS p FROM conversations GROUP BY 1),
      c AS (SELECT conv_id, 'facts:' || chr(10) || '{"pages":' || n || '}' || chr(10) || chr(10) || 'pages:' || chr(10) || CASE WHEN conv_id % 5 > 0 THEN p ELSE '[尚无已保存的脱敏正文]' END AS c FROM t),
      k AS (SELECT conv_id, CASE WHEN length(c) <= 2000 THEN c ELSE left(c, 998) || chr(10) || '…' || chr(10) || right(c, 998) END AS c FROM c) SELECT conv_id, length(c)::INT AS n_chars, md5(c) AS context_md5 FROM k""",
}
