"""Facts, rules and clauses of document review."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import join_sized

#: What counts as no value, and the least confidence.
UNKNOWN = ("", "unknown", "n/a", "none", "null", "未知", "未提供", "缺失", "待补充")
MIN_CONFIDENCE = 0.65
#: A numbered heading, and how long headings are.
NUMBERED = r"^\s*(?:第\s*[一二三四五六七八九十百千万零〇0-9]+\s*[章节条款]|[一二三四五六七八九十百千万零〇]+[、.．]|\d+(?:\.\d+)*[、.．:]?|[A-Za-z][、.．])\s*(.+?)\s*$"
MAX_HEADING, MAX_PLAIN_HEADING = 100, 36
#: Clause types by pattern, first match wins.
CLAUSE_TYPES = (
    ("当事人|甲乙双方|基本信息|双方信息", "parties"),
    ("合同期限|劳动合同期限|履行期限|服务期限", "term"),
    ("试用期", "probation"),
    ("工作内容|岗位职责|工作地点|工作场所", "work_content"),
    ("工作时间|休息休假|加班|工时", "work_hours"),
    ("劳动报酬|工资|薪酬|报酬", "compensation"),
    ("社会保险|住房公积金|五险一金", "social_insurance"),
    ("解除|终止|离职", "termination"),
    ("违约责任|赔偿责任|责任", "liability"),
    ("竞业限制|竞业禁止", "non_compete"),
    ("保密|知识产权|成果归属", "confidentiality"),
    ("争议解决|劳动争议|仲裁|管辖", "dispute_resolution"),
)


def usable(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(*UNKNOWN), F.lit(False))


def normal_value(value: Column) -> Column:
    """White space folded; Chinese dates as Y-M-D without padding."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1-$2-$3")


def fact_status(value: Column, n_evidence: Column, confidence: Column) -> Column:
    return F.when(~usable(value), "missing").when((n_evidence == 0) | (confidence < MIN_CONFIDENCE), "needs_confirmation").otherwise("extracted")


def mark_contradictions(facts: DataFrame, value: str, *key: str) -> DataFrame:
    """facts with contradicted: its key (ignoring case) has two or more normal values.

    A key's least and greatest value tell that, which combine before the shuffle however many rows the key has.
    """
    keyed = facts.withColumn("_k", F.concat_ws("\x1f", *[F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in key])).withColumn("_v", F.when(usable(F.col(value).cast("string")), normal_value(F.col(value).cast("string"))))
    spread = keyed.groupBy("_k").agg((F.min("_v") != F.max("_v")).alias("_c"))
    return keyed.join(spread, "_k").withColumn("contradicted", F.coalesce("_c", F.lit(False)) & F.col("_v").isNotNull()).drop("_k", "_v", "_c")


def _said(cards: list[tuple[str, list[str]]], haystack: Column) -> list[Column]:
    """Whether an alias of each card stands in the haystack, which is lower case. An alias that holds another of its card adds nothing."""
    needed = lambda aliases: [a for n, a in enumerate(aliases) if not any(b in a and (b != a or m < n) for m, b in enumerate(aliases))]
    return [reduce(or_, (F.contains(haystack, F.lit(a)) for a in needed([a.lower() for a in aliases]))) for _, aliases in cards]


def alias_matches(facts: DataFrame, cards: list[tuple[str, list[str]]], haystack: Column) -> DataFrame:
    """facts with rule_id, a row for each of the cards (rule_id, aliases) of which an alias stands in the haystack, case
    ignored. The cards are a fixed list, so all are searched in one expression on the row, without a join."""
    said = [F.when(here, F.lit(rule)) for here, (rule, _) in zip(_said(cards, F.col("_h")), cards, strict=True)]
    return facts.withColumn("_h", F.lower(haystack)).withColumn("rule_id", F.explode(F.array_compact(F.array(*said)))).drop("_h")


def alias_mask(facts: DataFrame, cards: list[tuple[str, list[str]]], haystack: Column) -> DataFrame:
    """facts with matched, a long whose bit n is set where alias_matches would give a row for card n of at most 63."""
    if len(cards) > 63:
        raise ValueError("a mask has room for 63 cards")
    bits = [F.when(here, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, here in enumerate(_said(cards, F.col("_h")))]
    return facts.withColumn("_h", F.lower(haystack)).withColumn("matched", reduce(Column.bitwiseOR, bits)).drop("_h")


def missing_required(present: DataFrame, required: list[str], key: str, per: str) -> DataFrame:
    """(per, key) of the required keys, a fixed list, that a group of present lacks."""
    found = present.groupBy(per).agg(F.collect_set(F.when(F.col(key).isin(required), F.col(key))).alias("_found"))  # at most the fixed list
    return found.select(per, F.explode(F.array_except(F.array(*[F.lit(k) for k in required]), "_found")).alias(key))


def clause_type(title: Column) -> Column:
    out = None
    for pattern, kind in CLAUSE_TYPES:
        value = F.lit(kind)
        if kind == "work_content":
            value = F.when(title.contains("地点"), "work_location").otherwise(kind)
        if kind == "confidentiality":
            value = F.when(title.contains("知识产权"), "intellectual_property").otherwise(kind)
        out = F.when(title.rlike(f"(?i){pattern}"), value) if out is None else out.when(title.rlike(f"(?i){pattern}"), value)
    return out.otherwise("other")


def heading(line: Column) -> Column:
    """The heading's title, or null: a numbered line, or a short one without a final stop that names a known topic."""
    flat = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    title = F.btrim(F.regexp_extract(flat, NUMBERED, 1), F.lit(" ：:、.．-"))
    plain = (F.length(flat) <= MAX_PLAIN_HEADING) & ~flat.rlike(r"[。！？.!?]$") & (clause_type(flat) != "other")
    return F.when((F.length(flat) == 0) | (F.length(flat) > MAX_HEADING), None).when(flat.rlike(NUMBERED) & (title != ""), title).when(plain, flat)


def clauses(lines: DataFrame, doc: str, page: str, line_no: str, text: str, is_heading: Column) -> DataFrame:
    """A row a clause: doc, clause_id, title line, first and last page, number of lines.

    A heading closes the clause before it only if that one has a line that isn't blank; so leading blank lines join the
    first clause. lines come by document; a document's lines are its own window.
    """
    w = Window.partitionBy(doc).orderBy(page, line_no)
    marked = lines.withColumn("_h", is_heading.cast("int")).withColumn("_s", (F.trim(F.col(text)) != "").cast("int"))
    marked = marked.withColumn("_any", F.coalesce(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("clause_no", F.sum(F.col("_h") * F.col("_any")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    first = F.min(F.when(F.col("_s") == 1, F.struct(page, line_no, text)))
    grouped = marked.groupBy(doc, "clause_no").agg(F.max("_s").alias("_s"), first[text].alias("title"), F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count("*").alias("n_lines"))
    return grouped.filter("_s = 1").withColumn("clause_id", F.format_string("clause_%03d", "clause_no")).drop("_s")


def locate_quote(quote: Column, text: Column) -> Column:
    """Struct(match_type, char_start, char_end) of the quote's first place: exact, else with white space folded; or null."""
    place = F.position(quote, text)
    pattern = F.regexp_replace(F.regexp_replace(F.trim(quote), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"(?U)\s+", r"\\s+")
    folded = F.regexp_substr(text, F.concat(F.lit("(?U)"), pattern))
    loose = F.position(folded, text)
    found = lambda kind, start, n: F.struct(F.lit(kind).alias("match_type"), (start - 1).alias("char_start"), (start - 1 + n).alias("char_end"))
    return F.when((F.length(quote) > 0) & (place > 0), found("exact", place, F.length(quote))).when((F.length(F.trim(quote)) > 0) & folded.isNotNull(), found("normalized", loose, F.length(folded)))


def overlay(facts: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """facts with the stored value of each field where there is one."""
    mine = stored.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = facts.join(mine, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in facts.columns])


def apply_action(action: Column, status: Column, original: Column, given: Column, n_evidence: Column, in_document: Column) -> Column:
    """Struct(state, effective_value, source, error) after a user's action on a fact.

    Confirming needs a confirmed status, a usable value and evidence; a correction must be found in the document, a
    supplement only needs a value. A failed action leaves the fact unreviewed and says why.
    """
    error = (
        F.when((action == "confirm") & ((status != "confirmed") | ~usable(original) | (n_evidence == 0)), "confirm_without_evidence")
        .when(action.isin("correct", "supplement") & ~usable(given), "value_required")
        .when((action == "correct") & ~in_document, "correction_evidence_not_found")
        .when(~action.isin("confirm", "correct", "supplement", "not_applicable", "defer"), "unknown_action")
    )
    ok = error.isNull()
    state = F.when(~ok, "unreviewed").when(action == "confirm", "confirmed").when(action == "correct", "corrected").when(action == "supplement", "supplemented").when(action == "not_applicable", "not_applicable").otherwise("deferred")
    value = F.when(ok & (action == "confirm"), original).when(ok & action.isin("correct", "supplement"), given)
    source = F.when(ok & action.isin("confirm", "correct"), "contract").when(ok & (action == "supplement"), "user").otherwise("none")
    return F.struct(state.alias("state"), value.alias("effective_value"), source.alias("source"), error.alias("error"))


def articles(lines: DataFrame, doc: str, order: str, text: str, chapter: Column, section: Column, article: Column) -> DataFrame:
    """A row an article: doc, ordinal, label, chapter, section, text; a document's other lines make its article 0.

    chapter, section and article say whether a line is such a heading. A chapter ends the section before it; any heading
    ends an article. Blank lines at the ends of a text go; a preamble of blank lines only is no article.
    """
    w = Window.partitionBy(doc).orderBy(order)
    kind = F.when(chapter, "c").when(section, "s").when(article, "a")
    df = lines.withColumn("_k", kind)
    df = df.withColumn("_g", F.count("_k").over(w)).withColumn("_c", F.count_if(F.col("_k") == "c").over(w))
    last = lambda k, over: F.last(F.when(F.col("_k") == k, F.trim(text)), ignorenulls=True).over(over)
    in_chapter = Window.partitionBy(doc, "_c").orderBy(order)
    df = df.withColumn("_chapter", last("c", w)).withColumn("_section", last("s", in_chapter)).withColumn("_kind", F.last("_k", ignorenulls=True).over(w))
    df = df.filter(F.col("_k").isNull() | (F.col("_k") == "a")).withColumn("_g", F.when(F.col("_kind") == "a", F.col("_g")).otherwise(0))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    first = lambda c: F.when(F.col("_g") > 0, F.min_by(c, order))
    grouped = df.groupBy(doc, "_g").agg(joined.alias("text"), first(text).alias("label"), first("_chapter").alias("chapter"), first("_section").alias("section"))
    grouped = grouped.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\A(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+\z", "")).filter(F.trim("text") != "")
    ordinal = F.when(F.col("_g") == 0, 0).otherwise(F.count_if(F.col("_g") > 0).over(Window.partitionBy(doc).orderBy("_g")))
    return grouped.select(doc, ordinal.alias("ordinal"), "label", "chapter", "section", "text")


def ordered_distinct(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value, place: the distinct values of each group in the order of their first row."""
    first = df.groupBy(by, value).agg(F.min(order).alias("first_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("first_at", value)))


def batch_plan(df: DataFrame, by: str, text: str, order: str, single: int = 12_000, size: int = 6) -> DataFrame:
    """df with batch_no: one batch where a group's texts are short in all, else size rows a batch."""
    total = F.sum(F.length(text)).over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("batch_no", F.when(total <= single, 0).otherwise(F.floor((place - 1) / size)).cast("int"))


def prompt_budget(df: DataFrame, by: str, text: str, order: str, limit: int) -> DataFrame:
    """df with given: how many characters of each text fit what the earlier ones of its group leave of the limit."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("given", F.greatest(F.lit(0), F.least(F.length(text), limit - before)).cast("long"))


def contained(passages: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """passages semi-joined with docs by key where the passage, white space folded, stands in the document."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return join_sized(docs, passages, key, "inner").filter(fold(F.col("text")).contains(fold(F.col("passage"))))


#: Statuses that need a person.
UNRESOLVED = ("ambiguous", "missing", "contradicted", "needs_confirmation")


def built_fact(value: Column, given_status: Column, n_evidence: Column, confidence: Column, flagged: Column) -> dict[str, Column]:
    """Columns of a fact from a draft: confidence between 0 and 1, status, whether it needs confirmation, normal value.

    A contradiction or ambiguity that the draft states stays, whatever its value.
    """
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    derived = fact_status(value, n_evidence, sure)
    status = F.when(given_status.isin("contradicted", "ambiguous"), given_status).when((derived == "extracted") & (given_status == "confirmed"), "confirmed").otherwise(derived)
    return {"confidence": sure, "status": status, "needs_confirmation": F.coalesce(flagged, F.lit(False)) | status.isin(*UNRESOLVED), "normalized_value": normal_value(value)}


def allowed_actions(status: Column, needs_confirmation: Column, value: Column, n_evidence: Column) -> Column:
    """What a user may do with a fact, in the order in which it is offered."""
    confirm = (status == "confirmed") & ~needs_confirmation & usable(value) & (n_evidence > 0)
    first = [F.when(confirm, F.lit("confirm")), F.when(n_evidence > 0, F.lit("correct"))]
    return F.array_compact(F.array(*first, F.lit("supplement"), F.lit("not_applicable"), F.lit("defer")))


def confirmation_question(name: Column, status: Column, n_evidence: Column) -> Column:
    said = lambda form: F.format_string(form, name)
    return F.when(status == "missing", said("请补充或确认合同中的“%s”信息。")).when(status == "contradicted", said("合同中“%s”出现不一致，请确认以哪一处内容为准。")).when(n_evidence == 0, said("请确认“%s”的原文位置和具体内容。")).otherwise(said("请确认合同中的“%s”是否准确。"))


def initial_state(needs_confirmation: Column, value: Column) -> Column:
    """Struct(state, effective_value, source) of a fact that no user has touched."""
    return F.struct(F.when(needs_confirmation, "unreviewed").otherwise("confirmed").alias("state"), F.when(~needs_confirmation, value).alias("effective_value"), F.when(needs_confirmation, "none").otherwise("contract").alias("source"))


def review_status(states: DataFrame, by: str, state: str, question: str) -> DataFrame:
    """by, status, n_pending, first_question of each review: it waits while facts are unreviewed or deferred."""
    open_ = F.col(state).isin("unreviewed", "deferred")
    grouped = states.groupBy(by).agg(F.count_if(open_).alias("n_pending"), F.min(F.when(open_, F.col(question))).alias("first_question"))
    return grouped.withColumn("status", F.when(F.col("n_pending") > 0, "awaiting_confirmation").otherwise("ready"))


def first_sources(hits: DataFrame, by: str, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key within a review, in the order in which its queries found it."""
    first = F.row_number().over(Window.partitionBy(by, *key).orderBy(*order))
    return hits.withColumn("_n", first).filter("_n = 1").drop("_n")
