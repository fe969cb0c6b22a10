"""Traces and acceptance of retrieval and review runs: full traces, smoke checks, report rows, histories, resumed work."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold_blanks
from lexmill.operators.evaluation import citations, is_refusal, nearest_rank
from lexmill.operators.governance import errors
from lexmill.operators.prepared import STATUS_CODE, blank, token_id
from lexmill.operators.retrieval import B, K1, AVERAGE_LENGTH, term_counts
from lexmill.operators.review import locate_quote

#: The query of a review without findings, and how many case queries a review asks.
BASELINE = ("LC-BASE", "中国大陆劳动合同订立必备事项和劳动者基本权益")
CASE_QUERIES = 3
CONFLICT, RESOLVED = "possible_conflict", ("confirmed", "corrected", "supplemented", "not_applicable")


def first_gold_ranks(stages: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """query_id and a column <stage>_rank of the smallest rank of a gold document, and <stage>_count of the stage's rows."""
    marked = [df.select("query_id", "doc_id", "rank", F.lit(name).alias("stage")) for name, df in stages.items()]
    hits = reduce(DataFrame.unionByName, marked).join(gold.select("query_id", "doc_id", F.lit(True).alias("is_gold")).distinct(), ["query_id", "doc_id"], "left")
    columns = []
    for name in stages:
        here = F.col("stage") == name
        columns += [F.min(F.when(here & F.col("is_gold"), F.col("rank"))).alias(f"{name}_rank"), F.count_if(here).alias(f"{name}_count")]
    return hits.groupBy("query_id").agg(*columns)


def traces(questions: DataFrame, paths: DataFrame, coarse: DataFrame, final: DataFrame, gold: DataFrame) -> DataFrame:
    """A row a question (query_id): first gold rank and number of hits of each path and stage, and where gold was lost.

    paths: query_id, doc_id, rank, path, path_order. The first stage numbers each document once, in the order of paths,
    then ranks. A question whose gold no path found is lost at l1; one without hits has counts of 0.
    """
    place = Window.partitionBy("query_id").orderBy("f")
    l1 = paths.groupBy("query_id", "doc_id").agg(F.min(F.struct("path_order", "rank")).alias("f")).withColumn("rank", F.row_number().over(place)).drop("f")
    names = ("dense", "sparse", "bm25")
    stages = {p: paths.filter(F.col("path") == p) for p in names} | {"l1": l1, "l2": coarse, "l3": final}
    found = questions.select("query_id").join(first_gold_ranks(stages, gold), "query_id", "left").fillna(0, [f"{n}_count" for n in stages])
    lost = reduce(lambda out, n: F.when(F.col(f"{n}_rank").isNull(), n).otherwise(out), ("l3", "l2", "l1"), F.lit("none"))
    return found.withColumn("eliminated_at", lost)


def smoke_errors(hits: DataFrame, expected: DataFrame, allow_pending: bool = False) -> DataFrame:
    """query_id, n_documents, errors, passed of every expected answer.

    hits: query_id, doc_id, article_no, rank, source_level, citation_eligible, official_url, effective_date,
    citation_label, activation_status, excerpt. expected: query_id, doc_id, article_no, official_url_prefix,
    effective_date, required_terms. Errors are names, of any hit or of the expected one; a question's hits are few.
    """
    c, e = F.col, lambda name: F.col(f"e.{name}")
    any_hit = errors(level_not_a=c("source_level") != "A", not_eligible=~c("citation_eligible"), missing_article=blank(c("article_no").cast("string")), missing_url=blank(c("official_url")), missing_date=blank(c("effective_date")), blank_excerpt=blank(F.trim("excerpt")))
    joined = expected.select("query_id", F.struct(*[x for x in expected.columns if x != "query_id"]).alias("e")).join(hits, "query_id", "left")
    hit, wanted = c("doc_id").isNotNull(), (c("doc_id") == e("doc_id")) & c("article_no").eqNullSafe(e("article_no"))
    active = F.lit(True) if allow_pending else c("activation_status") == "ACTIVE"
    of_wanted = errors(
        other_url=~c("official_url").startswith(e("official_url_prefix")), other_date=c("effective_date") != e("effective_date"), label_without_article=~c("citation_label").contains(e("article_no").cast("string")),
        not_active=~active, missing_term=~F.forall(e("required_terms"), lambda t: c("excerpt").contains(t)),
    )
    rows = joined.select("query_id", hit.alias("hit"), F.when(hit, any_hit).alias("any"), F.when(wanted, F.struct(c("rank"), of_wanted.alias("errors"))).alias("wanted"))
    grouped = rows.groupBy("query_id").agg(F.count_if("hit").alias("n_documents"), F.flatten(F.collect_set("any")).alias("any"), F.min_by("wanted", "wanted.rank").alias("wanted"))
    found = F.array_sort(F.array_union("any", F.coalesce("wanted.errors", F.array(F.lit("expected_not_found")))))
    return grouped.select("query_id", "n_documents", found.alias("errors"), (F.size(found) == 0).alias("passed"))


def locate_facts(candidates: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, fact_id, page_no, match_type, char_start, char_end: the places of facts' quotes, each place of a fact once.

    candidates: doc, fact_id, candidate_no, quote, preferred (array of page numbers); pages: doc, page_no, text. A quote is
    sought on the preferred pages if the document has any of them, else on all; its first exact place by page counts,
    or its first with white space folded. Blank quotes have no place.
    """
    quotes = candidates.filter(F.trim("quote") != "").withColumn("quote", F.trim("quote"))
    joined = quotes.join(pages.select(doc, "page_no", "text"), doc)
    asked = [doc, "fact_id", "candidate_no"]
    scoped = F.coalesce(F.array_contains("preferred", F.col("page_no")), F.lit(False))
    any_scoped = F.max(F.col("scoped")).over(Window.partitionBy(*asked))
    placed = joined.select(*asked, "page_no", scoped.alias("scoped"), locate_quote(F.col("quote"), F.coalesce("text", F.lit(""))).alias("p")).withColumn("any_scoped", any_scoped)
    best = placed.filter((F.col("scoped") | ~F.col("any_scoped")) & F.col("p").isNotNull()).groupBy(*asked).agg(F.min_by(F.struct("page_no", "p"), F.struct(F.col("p.match_type") != "exact", F.col("page_no"))).alias("b"))
    places = best.select(doc, "fact_id", "b.page_no", "b.p.*")
    return places.groupBy(doc, "fact_id", "page_no", "char_start", "char_end").agg(F.min("match_type").alias("match_type"))


def law_queries(reviews: DataFrame, findings: DataFrame, review: str) -> DataFrame:
    """review, rule_id, query: a query a rule that was found, or the baseline's where nothing was."""
    asked = findings.select(review, "rule_id", "query").dropDuplicates([review, "rule_id"])
    none = reviews.select(review).distinct().join(asked.select(review), review, "left_anti")
    return asked.unionByName(none.select(review, F.lit(BASELINE[0]).alias("rule_id"), F.lit(BASELINE[1]).alias("query")))


def held_law_queries(held: DataFrame, review: str) -> DataFrame:
    """What law_queries gives, from reviews that hold their findings (review, found), one a rule at most; nothing is shuffled."""
    baseline = F.struct(F.lit(BASELINE[0]).alias("rule_id"), F.lit(BASELINE[1]).alias("query"))
    asked = F.transform("found", lambda f: F.struct(f["rule_id"].alias("rule_id"), f["query"].alias("query")))
    return held.select(review, F.inline(F.when(F.size("found") > 0, asked).otherwise(F.array(baseline))))


def case_queries(findings: DataFrame, review: str) -> DataFrame:
    """review, rule_id, case_no: the first conflicts of each review, by rule."""
    place = F.row_number().over(Window.partitionBy(review).orderBy("rule_id"))
    return findings.filter(F.col("finding_type") == CONFLICT).select(review, "rule_id", place.alias("case_no")).filter(F.col("case_no") <= CASE_QUERIES)


def report_rows(reviews: DataFrame, findings: DataFrame, questions: DataFrame, warnings: DataFrame, review: str) -> DataFrame:
    """review, findings, conflicts, pending_questions, warnings, workflow_status, report_version 1 of every review.

    questions and warnings (review, text) count once a text. A review with warnings is PARTIAL; one without findings gets a
    warning that this is no proof, which doesn't make it partial.
    """
    once = lambda df, name: df.filter(~blank(F.col("text"))).select(review, "text").distinct().groupBy(review).agg(F.count("*").alias(name))
    counts = findings.groupBy(review).agg(F.count("*").alias("findings"), F.count_if(F.col("finding_type") == CONFLICT).alias("conflicts"))
    out = reviews.select(review).distinct()
    for df in (counts, once(questions, "pending_questions"), once(warnings, "given")):
        out = out.join(df, review, "left")
    return _reported(out.fillna(0, ["findings", "conflicts", "pending_questions", "given"]), review)


def held_report_rows(held: DataFrame, review: str) -> DataFrame:
    """What report_rows gives, from a row a review with arrays: found (its findings), questions and warnings (texts, which are
    counted once a text); nothing is shuffled."""
    once = lambda texts: F.size(F.array_distinct(F.filter(texts, lambda x: ~blank(x)))).cast("long")
    conflicts = F.size(F.filter("found", lambda f: f["finding_type"] == CONFLICT)).cast("long")
    return _reported(held.select(review, F.size("found").cast("long").alias("findings"), conflicts.alias("conflicts"), once("questions").alias("pending_questions"), once("warnings").alias("given")), review)


def _reported(counts: DataFrame, review: str) -> DataFrame:
    return counts.select(review, "findings", "conflicts", "pending_questions", (F.col("given") + (F.col("findings") == 0).cast("long")).alias("warnings"), F.when(F.col("given") > 0, "PARTIAL").otherwise("COMPLETED").alias("workflow_status"))


def resolved_value(state: Column, value: Column) -> Column:
    """A fact's value in a report: only where a person or the contract settled it."""
    return F.when(state.isin(*RESOLVED), value)


def report_history(reports: DataFrame, messages: DataFrame) -> DataFrame:
    """review_id, thread, turn, role, text: a report's visible messages, from its session or, if that has none, from its legacy
    thread. reports: review_id, session_id; messages: thread, turn, role, text."""
    shown = messages.filter(F.col("role").isin("user", "assistant") & ~blank(F.col("text")))
    session, legacy = F.col("session_id").cast("string"), F.concat(F.lit("contract-review:"), F.col("review_id").cast("string"))
    either = reports.select("review_id", F.explode(F.array(F.struct(F.lit(0).alias("choice"), session.alias("thread")), F.struct(F.lit(1).alias("choice"), legacy.alias("thread")))).alias("t")).select("review_id", "t.*")
    has = shown.select("thread").distinct()
    chosen = either.join(has, "thread").groupBy("review_id").agg(F.min(F.struct("choice", "thread")).alias("t")).select("review_id", "t.thread")
    return chosen.join(shown, "thread").select("review_id", "thread", "turn", "role", "text")


def chosen_titles(titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """title, outcome, chosen: the one effective candidate of the very title, or why there is none.

    candidates: title, candidate_id, status_code. outcome: chosen, several_effective, not_effective (one version, not in
    force), several_not_effective, not_found.
    """
    clean = lambda c: fold_blanks(F.col(c))
    effective = F.col("status_code") == STATUS_CODE
    held = candidates.groupBy(clean("title").alias("title")).agg(F.count("*").alias("n"), F.count_if(effective).alias("n_effective"), F.min(F.when(effective, F.col("candidate_id"))).alias("id"))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("n_effective", F.lit(0))
    outcome = F.when(n == 0, "not_found").when(k == 1, "chosen").when(k > 1, "several_effective").when(n == 1, "not_effective").otherwise("several_not_effective")
    return titles.select(clean("title").alias("title")).distinct().join(held, "title", "left").select("title", outcome.alias("outcome"), F.when(outcome == "chosen", F.col("id")).alias("chosen"))


def remaining(work: DataFrame, done: DataFrame, key: str, **identity) -> DataFrame:
    """work not done yet. done is the output so far, whose columns of identity (model, collection, signature) must all have
    the run's values; output of another run, or a key done twice or never asked for, is refused."""
    other = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in identity.items()], F.lit(False))
    by_key = done.withColumn("_other", other).groupBy(key).agg(F.count("*").alias("_n"), F.max("_other").alias("_other"))
    known = work.select(key, F.lit(True).alias("_known")).distinct()
    wrong = by_key.join(known, key, "left").agg(F.count_if("_other").alias("of_another_run"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_known").isNull()).alias("unknown")).first()
    bad = {k: v for k, v in wrong.asDict().items() if v}
    if bad:
        raise ValueError(f"output can't be resumed: {bad}")
    return work.join(done.select(key), key, "left_anti")


def bm25_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, indices (token ids in order), weights: the documents' side of BM25; idf is the index's own.

    Words of one id add up; collisions() counts them. A document's distinct words are one array. One without words has none.
    """
    length, tf = F.col("length"), F.col("tf")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / AVERAGE_LENGTH))
    words = term_counts(docs, doc_id, text).select("doc_id", token_id("token").alias("id"), weight.alias("w"))
    by_id = words.groupBy("doc_id", "id").agg(F.sum("w").alias("w"))
    return by_id.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("v")).select("doc_id", F.col("v.id").alias("indices"), F.col("v.w").alias("weights"))


def answer_summary(answers: DataFrame, answer: str, n_contexts: str, gold_ranks: Column | None = None) -> DataFrame:
    """One row: answers, their length (mean, p50 by nearest rank, least, most), refusals, missing and invalid citations,
    answers with other than three contexts, and hits at 1 and 3 where ranks are given."""
    size, cited, n = F.length(answer), citations(F.col(answer)), F.col(n_contexts)
    invalid = F.exists(cited, lambda x: (x < 1) | (x > n))
    hits = [] if gold_ranks is None else [F.round(F.avg(F.coalesce(gold_ranks <= k, F.lit(False)).cast("double")), 6).alias(f"hit_at_{k}") for k in (1, 3)]
    return answers.withColumn("_size", size).agg(
        F.count("*").alias("answers"), F.round(F.avg("_size"), 6).alias("mean_characters"), nearest_rank("_size", 0.5).alias("p50_characters"), F.min("_size").alias("min_characters"), F.max("_size").alias("max_characters"),
        F.count_if(is_refusal(F.col(answer))).alias("refusals"), F.count_if((n > 0) & (F.size(cited) == 0)).alias("missing_citations"), F.count_if(invalid).alias("invalid_citations"), F.count_if(n != 3).alias("other_contexts"), *hits,
    )
