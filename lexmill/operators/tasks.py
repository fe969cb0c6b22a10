"""Task, report and artifact tables around a review: what is unfinished, who may see what, what an approval covers, payload and
stream parsing, question sets and manifests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import limited
from lexmill.operators.governance import errors
from lexmill.operators.prepared import blank
from lexmill.operators.store import expires, latest

#: The keys of a payload that a hit shows, and the length of its excerpt.
METADATA = (
    "source_level", "citation_eligible", "citation_label", "article_no", "article_label", "chapter", "section", "effective_date", "official_url", "legal_activation_status", "document_type", "issuing_authority", "jurisdiction",
    "national_applicability", "publication_date", "amendment_or_repeal_status",
)
EXCERPT = 500
#: States of files and of fact extraction.
WAITING, READY, RUNNING = ("queued", "extracting"), ("ready", "needs_confirmation"), "running"
TERMINAL = ("ready", "needs_confirmation", "failed")
ACTIVE, PENDING = "ACTIVE", "PENDING_LEGAL_REVIEW"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def adapted_hit(payload: Column) -> Column:
    """Struct of a hit's payload (map<string,string>): identity, text, excerpt and those metadata keys that it has."""
    said = lambda key: F.coalesce(payload[key], F.lit("")).alias(key)
    text = F.coalesce(payload["chunk_text"], F.lit(""))
    return F.struct(*map(said, ("doc_id", "chunk_id", "title", "source")), text.alias("text"), F.left(text, F.lit(EXCERPT)).alias("context_text"), F.map_filter(payload, lambda k, _: k.isin(*METADATA)).alias("metadata"))


def citation_errors(url_prefix: str, level: str = "A", allow_pending: bool = False) -> Column:
    """Names of what is wrong with a report's source: source_level, citation_eligible, rank, official_url, effective_date,
    citation_label, quote, legal_activation_status. Words of the source aren't in them."""
    c = F.col
    label, status = F.coalesce(strip(c("citation_label")), F.lit("")), F.coalesce(strip(c("legal_activation_status")), F.lit(""))
    numbered = label.contains("第") & label.contains("条")
    return errors(
        wrong_level=~c("source_level").eqNullSafe(level), not_eligible=~c("citation_eligible"), bad_rank=c("rank") < 1, other_url=~strip(c("official_url")).startswith(url_prefix), missing_date=blank(strip(c("effective_date"))), missing_label=label == "",
        label_without_article=(label != "") & F.lit(level == "A") & ~numbered, missing_quote=blank(strip(c("quote"))), bad_status=~status.isin(ACTIVE, PENDING), not_active=(status == PENDING) & F.lit(not allow_pending),
    )


def report_citations(reports: DataFrame, sources: DataFrame, by: str, url_prefix: str, **options) -> DataFrame:
    """by, n_sources, errors (distinct names), passed of every report; one without sources can't show that the search works."""
    found = sources.select(by, citation_errors(url_prefix, **options).alias("e"))
    n = found.groupBy(by).agg(F.count("*").alias("n_sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("errors"))
    all_ = reports.select(by).distinct().join(n, by, "left")
    wrong = F.when(F.col("n_sources").isNull(), F.array(F.lit("no_sources"))).otherwise(F.col("errors"))
    return all_.select(by, F.coalesce("n_sources", F.lit(0)).alias("n_sources"), wrong.alias("errors"), (F.size(wrong) == 0).alias("passed"))


def unfinished(tasks: DataFrame) -> DataFrame:
    """tasks to take up again after a restart, with step: process for files, extract for facts. Columns: status, extraction_status."""
    step = F.when(F.col("status").isin(*WAITING), "process").when(F.col("status").isin(*READY) & (F.col("extraction_status") == RUNNING), "extract")
    return tasks.withColumn("step", step).filter("step IS NOT NULL")


def terminal(status: Column, extraction: Column, require_extraction: bool = True) -> Column:
    """Whether a review's two state machines have come to their ends; a failed file ends both."""
    done = F.coalesce(extraction.isin(*TERMINAL), F.lit(False)) if require_extraction else F.lit(True)
    return F.coalesce(status.isin(*TERMINAL), F.lit(False)) & ((status == "failed") | done)


def owned_reports(tasks: DataFrame, reports: DataFrame, key: str, now: Column) -> DataFrame:
    """The last report version of each task that is neither deleted nor expired, with the task's owner.

    tasks: key, user_id, created_at, expires_at, deleted_at; reports: key, report_version and more.
    """
    live = tasks.filter(F.col("deleted_at").isNull() & (expires(F.col("expires_at"), F.col("created_at")) > now)).select(key, "user_id")
    return live.join(latest(reports, key, "report_version"), key)


def handled_requests(requests: DataFrame, confirmations: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """requests (key, user_id, request_id) that were handled before, with the last confirmation_id; other users' are not seen."""
    last = confirmations.groupBy(key, "request_id").agg(F.max_by("confirmation_id", F.struct("created_at", "confirmation_id")).alias("confirmation_id"))
    return requests.join(tasks.select(key, "user_id"), [key, "user_id"]).join(last, [key, "request_id"])


def flipped(rows: DataFrame, ids: DataFrame, key: str, **values) -> DataFrame:
    """rows with the columns of values set for the ids (a row each) and as they were for others."""
    marked = rows.join(ids.select(key, F.lit(True).alias("_flip")), key, "left")
    return marked.withColumns({c: F.when(F.col("_flip"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_flip")


def approval_state(approved: DataFrame, present: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """name, state of every artifact that was approved or is there: unchanged, changed, missing, or added since."""
    a, b = approved.select(name, F.col(digest).alias("_a")), present.select(name, F.col(digest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, name, "full").select(name, state.alias("state"))


def tool_contexts(text: Column) -> Column:
    """Contexts of a tool's message: the JSON's contexts, else those of its context text, blocks apart by a blank line whose first
    line is a label."""
    said = F.try_parse_json(text)
    given = F.from_json(text, "contexts array<string>, context string")
    legacy = F.coalesce(given["context"], F.lit(""))
    parts = F.filter(F.transform(F.split(F.when(legacy == "(empty)", "").otherwise(legacy), "\n\n"), strip), lambda p: p != "")
    body = F.transform(parts, lambda p: F.when(p.contains("\n"), strip(F.substr(p, F.position(F.lit("\n"), p) + 1))).otherwise(p))
    listed = F.filter(given["contexts"], lambda x: strip(x) != "")
    return F.when(said.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(listed, body))


def stream_events(body: Column) -> Column:
    """JSON texts of an event stream's whole frames, which end in a blank line: each frame's first data line, if it is JSON."""
    frames = F.split(body, "\n\n")
    whole = F.slice(frames, 1, F.size(frames) - 1)
    data = F.transform(whole, lambda f: F.get(F.filter(F.split(f, "\n"), lambda line: line.startswith("data: ")), F.lit(0)))
    return F.filter(F.transform(data, lambda d: F.substr(d, F.lit(7))), lambda d: F.try_parse_json(d).isNotNull())


def answer_errors(answer: Column, contexts: Column, documents: Column) -> Column:
    """Names of what is wrong with an answer, its contexts and its documents (array of structs with rank and chunk_id)."""
    some = F.size(F.coalesce(documents, F.array().cast("array<struct<rank:int,chunk_id:string>>"))) > 0
    gaps = F.exists(F.transform(documents, lambda d, i: ~d["rank"].eqNullSafe(i + 1)), lambda x: x)
    return errors(missing_answer=blank(strip(answer)), missing_contexts=F.coalesce(F.size(contexts) < 1, F.lit(True)), missing_documents=~some, counts_differ=some & (F.size(documents) != F.size(contexts)), ranks_not_contiguous=some & gaps, missing_chunk_id=some & F.exists(documents, lambda d: blank(d["chunk_id"])))


def question_errors(questions: DataFrame, fields: list[str]) -> DataFrame:
    """question_id, errors of a question set: blank or repeated ids, a blank query, blank fields of the expected answer, terms
    missing or blank. questions: question_id, query, expected (struct of the fields and required_terms)."""
    terms = F.col("expected.required_terms")
    same = questions.groupBy("question_id").agg(F.count("*").alias("_n"))
    checks = {f"missing_{f}": blank(strip(F.col(f"expected.{f}"))) for f in fields}
    found = errors(missing_id=blank(strip(F.col("question_id"))), repeated_id=F.col("_n") > 1, missing_query=blank(strip(F.col("query"))), **checks, bad_terms=(F.size(terms) < 1) | F.exists(terms, lambda t: blank(strip(t))))
    return questions.join(same, "question_id", "left").select("question_id", found.alias("errors"))


def _cite(title: Column, no: Column) -> Column:
    return F.concat(F.lit("《"), F.coalesce(title, F.lit("法律文件")), F.lit("》"), F.coalesce(no, F.lit("该条")))


def direct_question(title: Column, article_no: Column) -> Column:
    return F.concat(F.lit("根据"), _cite(title, article_no), F.lit("，该条文规定了什么？"))


def cross_question(title: Column, no: Column, other_title: Column, other_no: Column) -> Column:
    return F.concat(F.lit("劳动合同审查同时涉及"), _cite(title, no), F.lit("和"), _cite(other_title, other_no), F.lit("时，两条规定分别解决什么问题？"))


def manifest(chunks: DataFrame, doc: str, text: str, vector_dim: int, size: int, overlap: int) -> DataFrame:
    """One row that describes a corpus: documents, chunks, characters, settings and a digest of all chunks in any order."""
    digest = F.bit_xor(F.xxhash64(doc, text))
    return chunks.agg(F.count_distinct(doc).alias("documents"), F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"), F.lit(vector_dim).alias("vector_dim"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lower(F.hex(digest)).alias("content_digest"))


def manifest_errors(chunks: Column | None = None) -> Column:
    """Names of what is wrong with a manifest row, and with its count where the number of chunks found is given."""
    c = F.col
    found = F.lit(False) if chunks is None else c("chunks") != chunks
    return errors(no_documents=c("documents") < 1, no_chunks=c("chunks") < 1, bad_dimension=c("vector_dim") < 1, bad_chunk_size=c("chunk_size") < 1, bad_overlap=(c("chunk_overlap") < 0) | (c("chunk_overlap") >= c("chunk_size")), other_count=found)


def rendered(blocks: DataFrame, by: str, order: str, text: str, title: str) -> DataFrame:
    """by, markdown, n_paragraphs: a document's non-blank blocks under its title, whose first repetition as a block is left out."""
    kept = blocks.filter(~blank(strip(F.col(text)))).withColumn("_t", strip(F.col(text)))
    is_title = F.col("_t") == F.col(title)
    first = is_title & (F.sum(is_title.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    body = kept.withColumn("_first", first).filter(~F.col("_first"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n\n")
    grouped = body.groupBy(by).agg(joined.alias("body"), F.count("*").alias("n_paragraphs"))
    titles = blocks.groupBy(by).agg(F.min(title).alias("title"))
    said = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.col("body"))
    return titles.join(grouped, by, "left").select(by, F.concat(said, F.lit("\n")).alias("markdown"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))


def contract_context(tasks: DataFrame, pages: DataFrame, key: str, parts: dict[str, str], limit: int) -> DataFrame:
    """key, context of each task: a block a part (heading and JSON column) and the pages in order, cut to head and tail.

    pages: key, page_no, text. Private columns aren't named, so they can't get in.
    """
    line = F.concat(F.lit("[第 "), F.col("page_no").cast("string"), F.lit(" 页]\n"), F.coalesce("text", F.lit("")))
    joined = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", line.alias("p")))), lambda x: x["p"]), "\n\n").alias("_pages"))
    blocks = [F.concat(F.lit(head + ":\n"), F.coalesce(c, F.lit("{}"))) for head, c in parts.items()] + [F.concat(F.lit("pages:\n"), F.coalesce("_pages", F.lit("[尚无已保存的脱敏正文]")))]
    return tasks.join(joined, key, "left").select(key, limited(F.concat_ws("\n\n", *blocks), limit).alias("context"))
