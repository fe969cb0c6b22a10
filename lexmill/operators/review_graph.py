"""The review of a contract as one plan: load, gate, scope, rules, law, cases, report, with the branch that each review takes.

Facts are shared by all steps and written once. A review's branch is a column, decided from sums by review; only facts of
reviews that go all the way reach the rules. What the steps find is summed by review before it is joined, so no review's
rows meet in one place but for the rule evaluation, which a review's size bounds.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.acceptance import case_queries, law_queries, resolved_value
from lexmill.operators.labor_rules import findings as rule_findings
from lexmill.operators.labor_rules import in_scope
from lexmill.storage import join_sized, materialize

#: Clause types that show a labour contract, states of facts that a person has to settle.
LABOUR_CLAUSES = ("parties", "probation", "compensation", "social_insurance", "work_hours")
OPEN = ("unreviewed", "deferred")
ERROR, WAITING, OUTSIDE, FULL = "error", "awaiting_confirmation", "out_of_scope", "full"


def branches(reviews: DataFrame, facts: DataFrame, clauses: DataFrame, review: str) -> DataFrame:
    """review, branch, waiting (distinct questions of open facts). reviews: review, confirmed, extracted (whether there is a
    confirmation and an extraction); a review without either can't be loaded."""
    open_ = F.col("state").isin(*OPEN)
    gate = facts.groupBy(review).agg(F.count_if(open_).alias("n_open"), F.count_distinct(F.when(open_, F.col("question"))).alias("waiting"))
    said = in_scope(facts, review)
    typed = clauses.filter(F.col("clause_type").isin(*LABOUR_CLAUSES)).select(review).distinct().withColumn("typed", F.lit(True))
    all_ = reviews.join(gate, review, "left").join(said, review, "left").join(typed, review, "left")
    labour = F.coalesce("in_scope", F.lit(False)) | F.coalesce("typed", F.lit(False))
    branch = F.when(~(F.col("confirmed") & F.col("extracted")), ERROR).when(F.coalesce("n_open", F.lit(0)) > 0, WAITING).when(~labour, OUTSIDE).otherwise(FULL)
    return all_.select(review, branch.alias("branch"), F.coalesce("waiting", F.lit(0)).alias("waiting"))


def retrieved(queries: DataFrame, hits: DataFrame, review: str, name: str) -> DataFrame:
    """review, the number of distinct documents of its queries, and whether a query found none. hits: rule_id, doc_id.

    Reviews ask sets of a few rules, of which there are far fewer than reviews; each set's documents are counted once, and no
    review meets a document."""
    asked = materialize(queries.groupBy(review).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), "\n").alias("_asked")), "asked")
    sets = asked.select("_asked").distinct()
    found = sets.select("_asked", F.explode(F.split("_asked", "\n")).alias("rule_id")).join(hits.select("rule_id", "doc_id").distinct(), "rule_id", "left")
    counts = found.groupBy("_asked").agg(F.count_distinct("doc_id").alias(name), F.bool_or(F.col("doc_id").isNull()).alias(f"{name}_missing"))
    return join_sized(asked, materialize(counts, "asked-counts"), "_asked").drop("_asked")


def review_graph(reviews: DataFrame, facts: DataFrame, clauses: DataFrame, warnings: DataFrame, law: DataFrame, cases: DataFrame | None = None, review: str = "review_id") -> DataFrame:
    """A row a review: branch, workflow_status, findings, conflicts, pending_questions, legal_sources, case_sources, warnings.

    facts: review, fact_id, category, name, value, state, question; a value counts only where its state is settled. warnings:
    review, text, from the extraction; law and cases: rule_id, doc_id of what a rule's query finds; without cases that step
    is left out. A later step's warnings replace those of the ones before it, so a full review only has those of its last
    retrieval; a report without findings warns that this is no proof, which doesn't make it partial.
    """
    held = materialize(facts.withColumn("value", resolved_value(F.col("state"), F.col("value"))), "review-facts")
    routed = materialize(branches(reviews, held, clauses, review), "branches")
    full = routed.filter(F.col("branch") == FULL).select(review)
    found = materialize(rule_findings(held.join(full, review, "left_semi"), review), "findings")
    counts = found.groupBy(review).agg(F.count("*").alias("findings"), F.count_if(F.col("finding_type") == "possible_conflict").alias("conflicts"), F.count_distinct(F.when(F.col("finding_type") == "missing_information", F.col("query"))).alias("asked"))
    sources = retrieved(law_queries(full, found, review), law, review, "legal_sources")
    given = warnings.filter(F.trim("text") != "").groupBy(review).agg(F.count_distinct("text").alias("given"))
    out = routed.join(counts, review, "left").join(sources, review, "left").join(given, review, "left")
    if cases is not None:
        out = out.join(retrieved(case_queries(found, review), cases, review, "case_sources"), review, "left")
    else:
        out = out.withColumns({"case_sources": F.lit(0).cast("long"), "case_sources_missing": F.lit(None).cast("boolean")})
    out = out.fillna(0, ["findings", "conflicts", "asked", "legal_sources", "case_sources", "given"])
    last = F.coalesce("case_sources_missing", "legal_sources_missing", F.lit(False)).cast("long")
    said = F.when(F.col("branch") == FULL, last).when(F.col("branch") == OUTSIDE, 1).when(F.col("branch") == WAITING, F.col("given")).otherwise(0)
    none = ((F.col("findings") == 0) & (F.col("branch") != ERROR)).cast("long")
    status = F.when(F.col("branch") == ERROR, "FAILED").when(F.col("branch") == WAITING, "AWAITING_CONFIRMATION").when(F.col("branch") == OUTSIDE, "OUT_OF_SCOPE").when(last > 0, "PARTIAL").otherwise("COMPLETED")
    pending = F.when(F.col("branch") == WAITING, F.col("waiting")).otherwise(F.col("asked"))
    return out.select(review, "branch", status.alias("workflow_status"), "findings", "conflicts", F.when(F.col("branch") == ERROR, 0).otherwise(pending).alias("pending_questions"), "legal_sources", "case_sources", (said + none).alias("warnings"))

