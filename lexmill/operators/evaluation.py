"""Scores, percentiles, gates and samples of retrieval and generation runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import materialize

#: Phrases of a refusal.
REFUSALS = ("知识库中未找到", "未找到相关信息", "没有找到相关信息", "无法从参考资料", "无法根据参考资料", "insufficient information", "not enough information", "cannot answer", "can't answer")
METRICS = ("hit_at_1", "hit_at_3", "rr", "recall")


def retrieval_scores(hits: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """A row a question of gold (query_id, doc_id): first relevant rank, hits at 1 and k, reciprocal rank, recall at k.

    Several chunks of one document count once for recall; ranks are places in hits (query_id, doc_id, rank).
    """
    needed = gold.distinct().withColumn("is_gold", F.lit(True))
    top = hits.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    best = needed.join(top.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), ["query_id", "doc_id"], "left")
    scored = best.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count("rank").alias("found"), F.count("*").alias("n_gold"))
    hit = lambda at: F.coalesce(F.col("first_rank") <= at, F.lit(False)).cast("int")
    return scored.select("query_id", "first_rank", hit(1).alias("hit_at_1"), hit(k).alias("hit_at_3"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("found") / F.col("n_gold"), 6).alias("recall"))


def retrieval_summary(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Means over all questions (query_id); those without scores, failed ones, count as misses."""
    joined = questions.select("query_id").join(scores, "query_id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6).alias(c)
    return joined.agg(F.count("*").alias("n_questions"), F.count("rr").alias("n_scored"), *[mean(c) for c in METRICS])


def nearest_rank(value: str, q: float) -> Column:
    """The smallest value with at least a share q of the rows at or below it."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def linear_percentile(value: str, q: float) -> Column:
    return F.percentile(value, q)


def elimination(stages: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """query_id, the first gold rank in each stage, and the first stage that has no gold document ("none" if all have)."""
    out = gold.select("query_id").distinct()
    for name, hits in stages.items():
        ranks = hits.join(gold.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(f"{name}_rank"))
        out = out.join(ranks, "query_id", "left")
    lost = F.lit("none")
    for name in reversed(stages):
        lost = F.when(F.col(f"{name}_rank").isNull(), name).otherwise(lost)
    return out.withColumn("eliminated_at", lost)


def compare(old: DataFrame, new: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Deltas of two one-row summaries and whether the new one passes the hit@3 gate."""
    a, b = old.select(*[F.col(m).alias(f"old_{m}") for m in METRICS]), new.select(*[F.col(m).alias(f"new_{m}") for m in METRICS])
    deltas = [F.round(F.col(f"new_{m}") - F.col(f"old_{m}"), 6).alias(f"delta_{m}") for m in METRICS]
    return a.crossJoin(b).select("*", *deltas).withColumn("passed", F.col("delta_hit_at_3") + tolerance >= 0)


def gate(*checks: Column, rows: str = "*", minimum: int = 1) -> Column:
    """All checks hold on all rows and there are enough of them."""
    every = F.coalesce(F.bool_and(checks[0]), F.lit(False))
    for c in checks[1:]:
        every = every & F.coalesce(F.bool_and(c), F.lit(False))
    return every & (F.count(rows) >= minimum)


def finite_mean(value: str) -> list[Column]:
    """Mean over finite values, how many there are, and their share of all rows."""
    v = F.col(value)
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return [F.round(F.avg(ok), 6).alias("mean"), F.count(ok).alias("n_scored"), F.round(F.count(ok) / F.count("*"), 6).alias("coverage")]


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | low.contains(phrase)
    return out


def citations(answer: Column) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def inspect_answer(answer: Column, n_contexts: Column) -> Column:
    """Array of the reasons to look at an answer."""
    cited = citations(answer)
    bad = F.exists(cited, lambda c: (c < 1) | (c > n_contexts))
    reasons = [(is_refusal(answer), "refusal_answer"), ((n_contexts > 0) & (F.size(cited) == 0), "missing_citation"), (bad, "invalid_citation"), (n_contexts != 3, "context_count_not_3"), (F.length(answer) < 50, "short_answer"), (answer.contains("\\n"), "literal_escaped_newlines")]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))


def at_positions(rows: DataFrame, row_id: str, shares: tuple[float, ...]) -> DataFrame:
    """row_id, place: the ids at the given shares of the table's length in the order of ids; 1.0 is the last row.

    Ids are sorted by range and numbered within their task, so only a count a task comes to the driver.
    """
    sorted_ids = rows.select(row_id).repartitionByRange(row_id).sortWithinPartitions(row_id)
    ids = materialize(sorted_ids.withColumn("_at", F.monotonically_increasing_id()), "positions")
    counts = sorted((r["task"], r["n"]) for r in ids.groupBy(F.shiftright("_at", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    total, wanted = sum(n for _, n in counts), []
    for place, share in enumerate(shares):
        at = min(int(total * share), total - 1)
        for task, n in counts:
            if at < n:
                wanted.append((place, (task << 33) + at))
                break
            at -= n
    held = rows.sparkSession.createDataFrame(wanted, "place int, _at long")
    return ids.join(F.broadcast(held), "_at").select(row_id, "place")


#: Where in the order of rows a sample is filled up from.
COVERAGE = (0.0, 0.25, 0.5, 0.75, 1.0)


def spot_checks(rows: DataFrame, row_id: str, mandatory: Column, latency: str, length: str, slowest: int = 2, target: int = 0) -> DataFrame:
    """row_id and the sorted reasons of rows to check by hand: mandatory ones (array of reasons), the slowest, the
    shortest and the longest answer. Extremes are top-k's, not sorts of all rows.

    While these are fewer than target, rows at fixed shares of the table, then rows from its start, are added; those passed
    on the way get the reason too.
    """
    always = rows.select(row_id, F.explode(mandatory).alias("reason"))
    top = lambda reason, n, *order: rows.orderBy(*order, row_id).limit(n).select(row_id, F.lit(reason).alias("reason"))
    picks = always.unionByName(top("latency_outlier", slowest, F.col(latency).desc())).unionByName(top("shortest_answer", 1, F.col(length))).unionByName(top("longest_answer", 1, F.col(length).desc()))
    if target:
        first = rows.select(row_id).distinct().orderBy(row_id).limit(target)
        # at most five and target rows, so one task numbers them
        walk = at_positions(rows, row_id, COVERAGE).unionByName(first.withColumn("place", F.row_number().over(Window.orderBy(row_id)) + len(COVERAGE)))
        picked = picks.select(row_id).distinct()
        order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        fresh = walk.join(picked.withColumn("_picked", F.lit(True)), row_id, "left").withColumn("_new", (F.col("_picked").isNull() & (F.row_number().over(Window.partitionBy(row_id).orderBy("place")) == 1)).cast("long"))
        before = fresh.withColumn("_before", F.coalesce(F.sum("_new").over(order), F.lit(0))).crossJoin(F.broadcast(picked.agg(F.count("*").alias("_n"))))
        picks = picks.unionByName(before.filter(F.col("_n") + F.col("_before") < target).select(row_id, F.lit("deterministic_coverage_sample").alias("reason")))
    return picks.groupBy(row_id).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def numeric_suffix(value: Column) -> Column:
    """The number after the last underscore, to sort test_9 before test_10."""
    return F.substring_index(value, "_", -1).try_cast("long")


def generation_summary(rows: DataFrame, questions: DataFrame, by: str, retrieval: str, generation: str, answer: str) -> DataFrame:
    """One row: questions, completed and failed ones, mean latencies, p50, p95 (nearest rank) and largest total, mean length
    of an answer. A question without a row failed."""
    joined = questions.select(by).join(rows.withColumn("_done", F.lit(True)), by, "left").withColumn("_total", F.col(retrieval) + F.col(generation))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return joined.agg(
        F.count("*").alias("total_questions"), F.count("_done").alias("completed"), F.count_if(F.col("_done").isNull()).alias("failed"), mean(retrieval).alias("mean_retrieval"), mean(generation).alias("mean_generation"), mean("_total").alias("mean_total"),
        F.round(nearest_rank("_total", 0.5), 6).alias("p50_total"), F.round(nearest_rank("_total", 0.95), 6).alias("p95_total"), F.round(F.max("_total"), 6).alias("max_total"), mean(F.length(answer)).alias("mean_answer_chars"),
    )
