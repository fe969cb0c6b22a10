"""Queries on governance, facts, rules, clauses and answers; documents, labels and conversations stand for their inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import conversation as C
from lexmill.operators import evaluation as E
from lexmill.operators import governance as G
from lexmill.operators import labor_rules as L
from lexmill.operators import review as V
from lexmill.operators.review_graph import review_graph as review_graph_of
from lexmill.session import table

#: Rule cards for the English test texts: id, aliases, required.
CARDS = [("R-01", ["license", "licence"], True), ("R-02", ["email", "@"], False), ("R-03", ["the"], True), ("R-04", ["http"], False), ("R-05", ["apache", "mit"], True)]


ALIASES = [(rule, aliases) for rule, aliases, _ in CARDS]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def governance_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for the governance fields: not toxic is eligible, good quality is active, the language gives the level."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    level = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("C")
    passed = docs.filter(G.eligible(level, F.col("toxic") == 0, F.when(F.col("quality") == 1, "ACTIVE").otherwise("PENDING")))
    return G.rerank_dense(passed, "source", F.col("doc_id")).select("doc_id", "source", "rank")


def constraint_errors(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    found = G.errors(too_short=F.length(t) < 200, no_stop=~t.contains("."), too_long=F.length(t) > 20_000, wrong_count=F.length(t) != F.col("n_chars"), other_language=~F.col("lang").isin("en", "de"))
    return _docs(spark, sf).select("doc_id", F.array_join(found, ",").alias("errors"), F.size(found).alias("n_errors"))


def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """How many labelled documents of each source are in each state of activation."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id")
    level = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("C")
    status = F.when(~G.eligible(level, F.col("toxic") == 0, F.lit("ACTIVE")), "BLOCKED").when(F.col("quality") == 1, "ACTIVE").otherwise("PENDING")
    return docs.groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


def field_pending_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(*[F.when(F.col(c).startswith(p), F.concat(F.lit("PENDING_"), F.col(c))).otherwise(F.col(c)).alias(c) for c, p in (("o_orderstatus", "P"), ("o_orderpriority", "1"))])
    return G.pending_fields(rows, ["o_orderstatus", "o_orderpriority"])


def private_key_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(G.private_keys(F.coalesce("props", F.lit("")), ("token", "k", "a", "ref"))).alias("n_private"), F.count("*").alias("n"))


def rule_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    found = V.alias_matches(_docs(spark, sf).select("doc_id", "text"), ALIASES, F.col("text"))
    return found.groupBy("rule_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def missing_required(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text")
    found = V.alias_matches(docs, ALIASES, F.col("text")).select("doc_id", "rule_id")
    all_docs = docs.select("doc_id", F.lit(None).cast("string").alias("rule_id"))
    return V.missing_required(found.unionByName(all_docs), [rule for rule, _, required in CARDS if required], "rule_id", "doc_id")


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a customer's orders of one priority disagree in status; null is missing."""
    facts = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value"))
    return V.mark_contradictions(facts, "value", "o_custkey", "o_orderpriority").select("o_orderkey", "contradicted")


def fact_statuses(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = V.fact_status(F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("unknown"), F.length(F.coalesce("props", F.lit(""))) % 3, F.abs("value") % 1)
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def confirmation_states(spark: SparkSession, sf: str) -> DataFrame:
    actions = F.array(*[F.lit(x) for x in ("confirm", "correct", "supplement", "not_applicable", "defer")])
    e = table(spark, sf, "events").withColumn("action", F.get(actions, (F.col("user_id") % 5).cast("int")))
    status = F.when(F.col("event_id") % 4 > 0, "confirmed").otherwise("needs_confirmation")
    r = V.apply_action(F.col("action"), status, F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit("given")), F.col("event_id") % 3, F.col("event_id") % 5 > 0)
    return e.withColumn("r", r).groupBy("action", "r.state", "r.source", "r.error").agg(F.count("*").alias("n"), F.count("r.effective_value").alias("n_values"))


def article_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Shouted lines are chapters, lines of symbols sections, and lines that start with The articles."""
    line = F.col("line")
    found = V.articles(_lines(spark, sf), "doc_id", "line_no", "line", line.contains("!!"), line.contains("$$$"), line.startswith("The "))
    return found.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), F.md5("label").alias("label_md5"), F.md5("chapter").alias("chapter_md5"), F.md5("section").alias("section_md5"), F.md5("text").alias("text_md5"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reviews and their lines as facts; the wording is picked by the lines' numbers."""
    pick = lambda key, *options: F.get(F.array(*[F.lit(x) for x in options]), (F.col(key) % len(options)).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("fact_id"), pick("l_partkey", "社会保险", "工时休假", "劳动报酬", "竞业", "期限").alias("category"),
        pick("l_suppkey", "加班", "试用期", "salary", "社会保险", "other", "甲方").alias("name"), pick("l_partkey", "自愿放弃缴纳社会保险", "无偿加班", "面议", "两年", "试用期超过六个月").alias("value"),
    )


def review_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as contracts, of which some aren't extracted, some wait and some aren't of labour; passages as law and cases."""
    lines = table(spark, sf, "lineitem")
    own = lines.select(F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("fact_id"), "l_partkey", "l_suppkey")
    state = F.when(F.col("l_partkey") % 23 == 0, "unreviewed").when(F.col("l_partkey") % 29 == 0, "deferred").when(F.col("l_suppkey") % 7 == 0, "rejected").otherwise("confirmed")
    settled = own.select("review_id", "fact_id", state.alias("state"), F.concat(F.lit("question "), (F.col("l_suppkey") % 3).cast("string")).alias("question"))
    facts = _facts(spark, sf).join(settled, ["review_id", "fact_id"])
    clauses = own.filter("l_suppkey % 11 = 0").select("review_id", F.lit("parties").alias("clause_type"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    reviews = orders.select("review_id", (F.col("review_id") % 13 != 0).alias("confirmed"), (F.col("review_id") % 17 != 0).alias("extracted"))
    warned = orders.filter("review_id % 3 = 0").select("review_id", F.lit("pages of poor quality").alias("text"))
    hits = lambda n: table(spark, sf, "benchmark").select(F.format_string("LC-%03d", F.col("item_id") % n).alias("rule_id"), F.col("item_id").alias("doc_id"))
    return review_graph_of(reviews, facts, clauses, warned, hits(15), hits(11))


def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return L.findings(_facts(spark, sf)).select("review_id", "rule_id", "finding_type", "risk_level", "query")


def scope_check(spark: SparkSession, sf: str) -> DataFrame:
    return L.in_scope(_facts(spark, sf))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.floor(F.col("line_no") / 40) + 1)


def clause_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Short lines without an inner stop are the headings here."""
    is_heading = (F.length("line") <= 60) & F.col("line").rlike("^[A-Z0-9]") & ~F.col("line").rlike(r"\. ")
    found = V.clauses(_lines(spark, sf), "doc_id", "page", "line_no", "line", is_heading)
    return found.select("doc_id", "clause_id", "title", "page_start", "page_end", "n_lines")


def heading_types(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("doc_id").agg(F.count(V.heading(F.col("line"))).alias("n_headings"), F.count("*").alias("n_lines"))


def quote_places(spark: SparkSession, sf: str) -> DataFrame:
    """60 characters from the middle of each document, located in it: as they are, with other white space, or altered."""
    i, n = F.col("doc_id"), F.length("text")
    raw = F.regexp_replace(F.substr("text", (n / 2).cast("int") + 1, F.lit(60)), r"^\s+|\s+$", "")
    quote = F.when(i % 5 == 0, F.concat(F.lit("zq"), raw)).when(i % 5 < 3, F.replace(raw, F.lit(" "), F.lit("\n  "))).otherwise(raw)
    return _docs(spark, sf).withColumn("q", quote).select("doc_id", V.locate_quote(F.col("q"), F.col("text")).alias("p")).select("doc_id", "p.*")


def batch_plans(spark: SparkSession, sf: str) -> DataFrame:
    return V.batch_plan(table(spark, sf, "conversations"), "conv_id", "text", "turn", single=2000, size=2).groupBy("conv_id", "batch_no").agg(F.count("*").alias("n"))


def prompt_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return V.prompt_budget(table(spark, sf, "conversations"), "conv_id", "text", "turn", 1500).select("conv_id", "turn", "given")


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return V.ordered_distinct(table(spark, sf, "conversations"), "conv_id", "role", "turn")


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 4
    scope = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("contract:"), F.col("turn").cast("string"))).when(F.col("turn") % 3 == 1, "general")
    return table(spark, sf, "conversations").withColumn("scope", scope).withColumn("mode", F.when(k == 0, "contract_review").otherwise("general")).withColumn("legacy", k == 2)


def message_scope(spark: SparkSession, sf: str) -> DataFrame:
    return C.visible_messages(_scoped(spark, sf), "scope", "mode", F.lit("contract:3"), F.col("legacy")).select("conv_id", "turn")


def legacy_scope(spark: SparkSession, sf: str) -> DataFrame:
    return C.legacy_scope(_scoped(spark, sf), "conv_id", "scope")


def memory_condense(spark: SparkSession, sf: str) -> DataFrame:
    return C.condense(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    return C.question_answers(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.transcript(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def answer_inspection(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "conversations").filter("role = 'assistant'")
    return answers.select("conv_id", "turn", F.array_join(E.inspect_answer(F.coalesce("text", F.lit("")), F.lit(3)), ",").alias("reasons"))


def spotcheck(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "n_chars", F.length("text").alias("length"), F.when(F.col("text").contains("###"), F.array(F.lit("invalid_citation"))).otherwise(F.array().cast("array<string>")).alias("must"))
    return E.spot_checks(docs, "doc_id", F.col("must"), "n_chars", "length", target=100)


def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").groupBy("toxic").agg(E.gate(F.col("quality") == 1, F.col("doc_id") >= 0, minimum=10).alias("passed"), F.count_if(F.col("quality") == 1).alias("n_approved"), F.count("*").alias("n"))


def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, None).otherwise(F.col("value")))
    return e.groupBy("event_type").agg(*E.finite_mean("v"))


def percentile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(*[E.nearest_rank("value", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)])


def percentile_linear(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(*[F.round(E.linear_percentile("value", q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)])


QUERIES = {
    f.__name__: f
    for f in (
        governance_filter, constraint_errors, status_histogram, field_pending_counts, private_key_rows, rule_alias_join, missing_required, contradictions, fact_statuses, confirmation_states, article_rows, rule_findings, review_graph, scope_check, clause_segments, heading_types,
        quote_places, batch_plans, prompt_budgets, ordered_distinct, message_scope, legacy_scope, memory_condense, question_answers, context_text, answer_inspection, spotcheck, release_gate, metric_means, percentile_nearest, percentile_linear,
    )
}

CARD_ROWS = "cards AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}, {r})" for i, a, r in CARDS) + ") t(rule_id, aliases, required))"
HITS = f"{CARD_ROWS}, hits AS (SELECT doc_id, rule_id FROM documents, cards WHERE len(list_filter(aliases, lambda a: contains(lower(coalesce(text, '')), a))) > 0)"
FACTS = """facts AS (SELECT l_orderkey AS review_id, l_linenumber AS fact_id, ['社会保险', '工时休假', '劳动报酬', '竞业', '期限'][l_partkey % 5 + 1] AS category, ['加班', '试用期', 'salary', '社会保险', 'other', '甲方'][l_suppkey % 6 + 1] AS name,
      ['自愿放弃缴纳社会保险', '无偿加班', '面议', '两年', '试用期超过六个月'][l_partkey % 5 + 1] AS value FROM lineitem)"""
RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {a}, '{q}', {r})" for i, _, a, q, r in L.CARDS) + ") t(rule_id, aliases, query, required)), conditions AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{i}', '{p}', '{k}', '{r}')" for o, (i, p, k, r) in enumerate(L.CONDITIONS)) + ") t(o, rule_id, pattern, kind, risk))"
SCOPED = "sc AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'contract:' || turn WHEN 1 THEN 'general' END AS scope, CASE WHEN conv_id % 4 = 0 THEN 'contract_review' ELSE 'general' END AS mode, conv_id % 4 = 2 AS legacy FROM conversations)"

SQL = {
    "governance_filter": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND toxic = 0 AND quality = 1",
    "constraint_errors": """WITH e AS (SELECT doc_id, list_filter([CASE WHEN length(t) < 200 THEN 'too_short' END, CASE WHEN NOT contains(t, '.') THEN 'no_stop' END, CASE WHEN length(t) > 20000 THEN 'too_long' END, CASE WHEN coalesce(length(t) <> n_chars, true) THEN 'wrong_count' END, CASE WHEN coalesce(lang NOT IN ('en', 'de'), true) THEN 'other_language' END], lambda x: x IS NOT NULL) AS e FROM (SELECT *, coalesce(text, '') AS t FROM documents))
      SELECT doc_id, array_to_string(e, ',') AS errors, len(e)::INT AS n_errors FROM e""",
    "status_histogram": "SELECT source, CASE WHEN lang NOT IN ('en', 'de') OR toxic <> 0 THEN 'BLOCKED' WHEN quality = 1 THEN 'ACTIVE' ELSE 'PENDING' END AS status, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "quote_places": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), r AS (SELECT *, regexp_replace(substr(text, length(text) // 2 + 1, 60), '^\s+|\s+$', '', 'g') AS raw FROM d),
      q AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'zq' || raw WHEN doc_id % 5 < 3 THEN replace(raw, ' ', chr(10) || '  ') ELSE raw END AS q FROM r),
      f AS (SELECT *, strpos(text, q) AS pos, regexp_extract(text, array_to_string(list_transform(regexp_extract_all(q, '\S+'), lambda x: regexp_escape(x)), '\s+')) AS folded FROM q)
      SELECT doc_id, CASE WHEN length(q) > 0 AND pos > 0 THEN 'exact' WHEN length(q) > 0 AND folded <> '' THEN 'normalized' END AS match_type, CASE WHEN length(q) > 0 AND pos > 0 THEN pos - 1 WHEN length(q) > 0 AND folded <> '' THEN strpos(text, folded) - 1 END::INT AS char_start,
      CASE WHEN length(q) > 0 AND pos > 0 THEN pos - 1 + length(q) WHEN length(q) > 0 AND folded <> '' THEN strpos(text, folded) - 1 + length(folded) END::INT AS char_end FROM f""",
    "field_pending_counts": "SELECT 'o_orderstatus' AS field, count(*) FILTER (o_orderstatus LIKE 'P%') AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority LIKE '1%') FROM orders",
    "private_key_rows": r"""SELECT event_type, count(*) FILTER (regexp_matches(coalesce(props, ''), '"(?:token|k|a|ref)"\s*:')) AS n_private, count(*) AS n FROM events GROUP BY 1""",
    "rule_alias_join": f"WITH {HITS} SELECT rule_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM hits GROUP BY 1",
    "missing_required": f"WITH {HITS} SELECT doc_id, rule_id FROM (SELECT DISTINCT doc_id FROM documents), cards WHERE required AND (doc_id, rule_id) NOT IN (SELECT (doc_id, rule_id) FROM hits)",
    "contradictions": "WITH f AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS v FROM orders) SELECT o_orderkey, v IS NOT NULL AND min(v) OVER k <> max(v) OVER k AS contradicted FROM f WINDOW k AS (PARTITION BY o_custkey, o_orderpriority)",
    "fact_statuses": "SELECT CASE WHEN coalesce(event_type, 'view') = 'view' THEN 'missing' WHEN length(coalesce(props, '')) % 3 = 0 OR abs(value) % 1 < 0.65 THEN 'needs_confirmation' ELSE 'extracted' END AS status, count(*) AS n FROM events GROUP BY 1",
    "confirmation_states": """WITH a AS (SELECT *, ['confirm', 'correct', 'supplement', 'not_applicable', 'defer'][user_id % 5 + 1] AS action FROM events),
      x AS (SELECT *, CASE WHEN action = 'confirm' AND (event_id % 4 = 0 OR event_type IS NULL OR event_id % 3 = 0) THEN 'confirm_without_evidence' WHEN action IN ('correct', 'supplement') AND event_id % 2 = 1 THEN 'value_required' WHEN action = 'correct' AND event_id % 5 = 0 THEN 'correction_evidence_not_found' END AS error FROM a),
      s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'unreviewed' ELSE map {'confirm': 'confirmed', 'correct': 'corrected', 'supplement': 'supplemented', 'not_applicable': 'not_applicable', 'defer': 'deferred'}[action] END AS state FROM x)
      SELECT action, state, CASE WHEN state IN ('confirmed', 'corrected') THEN 'contract' WHEN state = 'supplemented' THEN 'user' ELSE 'none' END AS source, error, count(*) AS n, count(*) FILTER (state IN ('confirmed', 'corrected', 'supplemented')) AS n_values FROM s GROUP BY ALL""",
    "article_rows": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
      k AS (SELECT *, CASE WHEN contains(line, '!!') THEN 'c' WHEN contains(line, '$$$') THEN 's' WHEN starts_with(line, 'The ') THEN 'a' END AS k FROM l),
      g AS (SELECT *, count(k) OVER w AS g, count(*) FILTER (k = 'c') OVER w AS c, last_value(k IGNORE NULLS) OVER w AS kind, last_value(CASE WHEN k = 'c' THEN trim(line) END IGNORE NULLS) OVER w AS chapter FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
      h AS (SELECT *, last_value(CASE WHEN k = 's' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id, c ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM g),
      t AS (SELECT doc_id, CASE WHEN kind = 'a' THEN g ELSE 0 END AS g, string_agg(line, chr(10) ORDER BY n) AS text, arg_min(line, n) AS label, min_by(coalesce(chapter, chr(0)), n) AS chapter, min_by(coalesce(section, chr(0)), n) AS section FROM h WHERE k IS NULL OR k = 'a' GROUP BY ALL),
      r AS (SELECT * REPLACE (regexp_replace(regexp_replace(text, '\A(?:[^\S\n]*\n)+', ''), '(?:\n[^\S\n]*)+\z', '') AS text) FROM t)
      SELECT doc_id, CASE WHEN g = 0 THEN 0 ELSE count(*) FILTER (g > 0) OVER (PARTITION BY doc_id ORDER BY g) END::INT AS ordinal, CASE WHEN g > 0 THEN md5(label) END AS label_md5, CASE WHEN g > 0 THEN md5(nullif(chapter, chr(0))) END AS chapter_md5, CASE WHEN g > 0 THEN md5(nullif(section, chr(0))) END AS section_md5, md5(text) AS text_md5 FROM r WHERE trim(text) <> ''""",
    "rule_findings": f"""WITH {FACTS}, {RULES},
      m AS (SELECT f.*, rule_id, aliases FROM facts f, rules WHERE len(list_filter(aliases, lambda a: contains(lower(category || ' ' || name), lower(a)))) > 0),
      v AS (SELECT review_id, rule_id, string_agg(value, '；' ORDER BY fact_id, value) AS v FROM m GROUP BY ALL),
      h AS (SELECT review_id, rule_id, first(kind ORDER BY o) AS finding_type, first(risk ORDER BY o) AS risk_level FROM v JOIN conditions USING (rule_id) WHERE regexp_matches(v, pattern) GROUP BY ALL)
      SELECT review_id, rule_id, finding_type, risk_level, query FROM (SELECT * FROM h UNION ALL SELECT review_id, rule_id, 'missing_information', 'unconfirmed' FROM (SELECT DISTINCT review_id FROM facts), rules WHERE required AND (review_id, rule_id) NOT IN (SELECT (review_id, rule_id) FROM v)) JOIN rules USING (rule_id)""",
    "review_graph": f"""WITH {FACTS}, {RULES},
      st AS (SELECT l_orderkey AS review_id, l_linenumber AS fact_id, CASE WHEN l_partkey % 23 = 0 THEN 'unreviewed' WHEN l_partkey % 29 = 0 THEN 'deferred' WHEN l_suppkey % 7 = 0 THEN 'rejected' ELSE 'confirmed' END AS state, 'question ' || l_suppkey % 3 AS question, l_suppkey % 11 = 0 AS parties FROM lineitem),
      fs AS (SELECT review_id, fact_id, category, name, CASE WHEN state = 'confirmed' THEN value END AS value, state IN ('unreviewed', 'deferred') AS open, question, parties FROM facts JOIN st USING (review_id, fact_id)),
      gt AS (SELECT review_id, count(*) FILTER (open) AS n_open, count(DISTINCT question) FILTER (open) AS waiting, bool_or(parties OR regexp_matches(lower(concat_ws(' ', category, name, value)), '劳动|用人单位|试用期|社会保险|social|probation|employment')) AS labour FROM fs GROUP BY 1),
      br AS (SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'error' WHEN coalesce(n_open, 0) > 0 THEN 'awaiting_confirmation' WHEN NOT coalesce(labour, false) THEN 'out_of_scope' ELSE 'full' END AS branch, coalesce(waiting, 0) AS waiting FROM orders LEFT JOIN gt ON review_id = o_orderkey),
      ff AS (SELECT fs.* FROM fs JOIN br USING (review_id) WHERE branch = 'full'),
      m AS (SELECT f.*, rule_id FROM ff f, rules WHERE len(list_filter(aliases, lambda a: contains(lower(category || ' ' || name), lower(a)))) > 0),
      v AS (SELECT review_id, rule_id, string_agg(coalesce(value, ''), '；' ORDER BY fact_id, value) AS v FROM m GROUP BY ALL),
      h AS (SELECT review_id, rule_id, first(kind ORDER BY o) AS kind FROM v JOIN conditions USING (rule_id) WHERE regexp_matches(v, pattern) GROUP BY ALL),
      fd AS (SELECT * FROM h UNION ALL SELECT review_id, rule_id, 'missing_information' FROM (SELECT DISTINCT review_id FROM ff), rules WHERE required AND (review_id, rule_id) NOT IN (SELECT (review_id, rule_id) FROM v)),
      ct AS (SELECT review_id, count(*) AS findings, count(*) FILTER (kind = 'possible_conflict') AS conflicts, count(DISTINCT rule_id) FILTER (kind = 'missing_information') AS asked FROM fd GROUP BY 1),
      lq AS (SELECT DISTINCT review_id, rule_id FROM fd UNION ALL SELECT review_id, 'LC-BASE' FROM br WHERE branch = 'full' AND review_id NOT IN (SELECT review_id FROM fd)),
      ls AS (SELECT review_id, count(DISTINCT item_id) AS legal_sources, bool_or(item_id IS NULL) AS short FROM lq LEFT JOIN benchmark ON rule_id = printf('LC-%03d', item_id % 15) GROUP BY 1),
      cq AS (SELECT review_id, rule_id FROM fd WHERE kind = 'possible_conflict' QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY rule_id) <= 3),
      cs AS (SELECT review_id, count(DISTINCT item_id) AS case_sources, bool_or(item_id IS NULL) AS short FROM cq LEFT JOIN benchmark ON rule_id = printf('LC-%03d', item_id % 11) GROUP BY 1),
      al AS (SELECT br.*, coalesce(findings, 0) AS findings, coalesce(conflicts, 0) AS conflicts, coalesce(asked, 0) AS asked, coalesce(legal_sources, 0) AS legal_sources, coalesce(case_sources, 0) AS case_sources, coalesce(cs.short, ls.short, false)::INT AS short FROM br LEFT JOIN ct USING (review_id) LEFT JOIN ls USING (review_id) LEFT JOIN cs USING (review_id))
      SELECT review_id, branch, CASE branch WHEN 'error' THEN 'FAILED' WHEN 'awaiting_confirmation' THEN 'AWAITING_CONFIRMATION' WHEN 'out_of_scope' THEN 'OUT_OF_SCOPE' ELSE CASE WHEN short = 1 THEN 'PARTIAL' ELSE 'COMPLETED' END END AS workflow_status, findings, conflicts,
        CASE branch WHEN 'error' THEN 0 WHEN 'awaiting_confirmation' THEN waiting ELSE asked END AS pending_questions, legal_sources, case_sources,
        CASE branch WHEN 'full' THEN short WHEN 'out_of_scope' THEN 1 WHEN 'awaiting_confirmation' THEN (review_id % 3 = 0)::INT ELSE 0 END + (findings = 0 AND branch <> 'error')::INT AS warnings FROM al""",
    "scope_check": f"WITH {FACTS} SELECT review_id, bool_or(regexp_matches(lower(category || ' ' || name || ' ' || value), '劳动|用人单位|试用期|社会保险|social|probation|employment')) AS in_scope FROM facts GROUP BY 1",
    "clause_segments": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
      m AS (SELECT *, line_no // 40 + 1 AS page, (length(line) <= 60 AND regexp_matches(line, '^[A-Z0-9]') AND NOT regexp_matches(line, '\. '))::INT AS h, (trim(line) <> '')::INT AS s FROM l),
      a AS (SELECT *, coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m),
      c AS (SELECT *, sum(h * seen) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) + 1 AS clause_no FROM a)
      SELECT doc_id, printf('clause_%03d', clause_no::BIGINT) AS clause_id, arg_min(line, line_no) FILTER (s = 1) AS title, min(page)::BIGINT AS page_start, max(page)::BIGINT AS page_end, count(*) AS n_lines FROM c GROUP BY doc_id, clause_no HAVING max(s) = 1""",
    "batch_plans": "WITH t AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, CASE WHEN total <= 2000 THEN 0 ELSE (p - 1) // 2 END::INT AS batch_no, count(*) AS n FROM t GROUP BY ALL",
    "prompt_budgets": "SELECT conv_id, turn, greatest(0, least(length(text), 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS given FROM conversations",
    "ordered_distinct": "WITH f AS (SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, role)::INT AS place FROM f",
    "message_scope": f"""WITH {SCOPED} SELECT conv_id, turn FROM sc WHERE CASE WHEN mode = 'contract_review' THEN (coalesce(scope, '') <> '' AND (coalesce(scope, '') NOT LIKE 'contract:%' OR scope = 'contract:3')) OR (NOT legacy AND coalesce(scope, '') NOT LIKE 'contract:%')
      ELSE coalesce(scope, '') NOT LIKE 'contract:%' AND (NOT legacy OR coalesce(scope, '') <> '') END""",
    "legacy_scope": f"WITH {SCOPED} SELECT conv_id, bool_or(coalesce(scope, '') = '') AS has_unscoped FROM sc GROUP BY conv_id",
    "memory_condense": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, count(*) AS n_messages, string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'ai' END || ': ' || left(coalesce(text, ''), 300), chr(10) ORDER BY n) FILTER (n <= 2) AS summary_input FROM n GROUP BY conv_id HAVING count(*) > 6",
    "question_answers": "WITH p AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(text) AS question_md5, md5(a) AS answer_md5 FROM p WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(a) <> ''",
    "context_text": "SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id",
    "answer_inspection": r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '\[(\d{1,9})\]', 1), lambda x: x::INT) AS c FROM conversations WHERE role = 'assistant')
      SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(lower(t), 'insufficient information|not enough information|cannot answer|can''t answer') THEN 'refusal_answer' END, CASE WHEN len(c) = 0 THEN 'missing_citation' END, CASE WHEN len(list_filter(c, lambda x: x < 1 OR x > 3)) > 0 THEN 'invalid_citation' END, CASE WHEN length(t) < 50 THEN 'short_answer' END, CASE WHEN contains(t, '\n') THEN 'literal_escaped_newlines' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a""",
    "spotcheck": """WITH d AS (SELECT doc_id, n_chars, length(coalesce(text, '')) AS n, coalesce(text, '') AS t FROM documents),
      p AS (SELECT doc_id, 'invalid_citation' AS reason FROM d WHERE contains(t, '###') UNION ALL (SELECT doc_id, 'latency_outlier' FROM d ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 2) UNION ALL (SELECT doc_id, 'shortest_answer' FROM d ORDER BY n, doc_id LIMIT 1) UNION ALL (SELECT doc_id, 'longest_answer' FROM d ORDER BY n DESC, doc_id LIMIT 1)),
      k AS (SELECT DISTINCT doc_id FROM p), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM d),
      w AS (SELECT n.doc_id, v.place FROM n JOIN (VALUES (0, 0.0), (1, 0.25), (2, 0.5), (3, 0.75), (4, 1.0)) v(place, share) ON pos = least(floor(n * share), n - 1) UNION ALL SELECT doc_id, pos + 5 FROM n WHERE pos < 100),
      x AS (SELECT *, (doc_id NOT IN (SELECT doc_id FROM k) AND row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1)::INT AS fresh FROM w),
      y AS (SELECT *, coalesce(sum(fresh) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
      z AS (SELECT * FROM p UNION ALL SELECT doc_id, 'deterministic_coverage_sample' FROM y WHERE (SELECT count(*) FROM k) + before < 100)
      SELECT doc_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM z GROUP BY doc_id""",
    "release_gate": "SELECT toxic, bool_and(quality = 1) AND count(*) >= 10 AS passed, count(*) FILTER (quality = 1) AS n_approved, count(*) AS n FROM labels GROUP BY toxic",
    "metric_means": "SELECT event_type, round(avg(value) FILTER (event_id % 10 > 1), 6) AS mean, count(value) FILTER (event_id % 10 > 1) AS n_scored, round(count(value) FILTER (event_id % 10 > 1) / count(*), 6) AS coverage FROM events GROUP BY 1",
    "percentile_nearest": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "percentile_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
}
