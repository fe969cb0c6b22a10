"""Message tables: scopes, condensation, questions and answers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, TAKEN, EXCERPT = 6, 2, 300


def scope_label(mode: Column, contract: Column) -> Column:
    return F.when(mode == "contract_review", F.concat(F.lit("contract:"), contract)).otherwise(mode)


def visible_messages(messages: DataFrame, scope: str, mode: str, current: Column, legacy: Column) -> DataFrame:
    """Messages that a turn may see: contract messages only in their own contract's scope, unlabelled ones only in threads without legacy residue."""
    s = F.coalesce(F.col(scope), F.lit(""))
    is_contract = s.startswith("contract:")
    in_review = ((s != "") & (~is_contract | (s == current))) | (~legacy & ~is_contract)
    in_general = ~is_contract & (~legacy | (s != ""))
    return messages.filter(F.when(F.col(mode) == "contract_review", in_review).otherwise(in_general))


def condense(messages: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """by, n_messages, summary_input of threads with more than KEEP messages: their first TAKEN, each cut to EXCERPT characters."""
    numbered = messages.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    line = F.concat(F.when(F.col(role) == "user", "user").otherwise("ai"), F.lit(": "), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(EXCERPT)))
    first = F.collect_list(F.when(F.col("_n") <= TAKEN, F.struct(F.col("_n").alias("n"), line.alias("line"))))
    joined = F.array_join(F.transform(F.sort_array(first), lambda x: x["line"]), "\n")
    return numbered.groupBy(by).agg(F.count("*").alias("n_messages"), joined.alias("summary_input")).filter(F.col("n_messages") > KEEP)


def question_answers(messages: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """by, order, question, answer: each user message whose next message is an assistant's, both not blank."""
    w = Window.partitionBy(by).orderBy(order)
    paired = messages.withColumn("_r", F.lead(role).over(w)).withColumn("answer", F.lead(text).over(w))
    good = (F.col(role) == "user") & (F.col("_r") == "assistant") & (F.trim(text) != "") & (F.trim("answer") != "")
    return paired.filter(good).select(by, order, F.col(text).alias("question"), "answer")


def legacy_scope(messages: DataFrame, by: str, scope: str) -> DataFrame:
    """by, has_unscoped: whether a thread has a message without a scope label."""
    return messages.groupBy(by).agg(F.bool_or(F.coalesce(F.col(scope), F.lit("")) == "").alias("has_unscoped"))


def transcript(messages: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """by, context: the thread's messages in order, each under its place and role."""
    part = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), F.col(role), F.lit("\n"), F.col(text))
    return messages.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))
