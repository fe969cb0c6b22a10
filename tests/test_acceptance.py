"""Traces, smoke checks, reports, histories and resumed work on frames with literal expectations."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import acceptance as A
from lexmill.operators import evaluation as E
from lexmill.operators.prepared import token_id


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_traces(spark):
    paths = spark.createDataFrame([(1, 10, 1, "dense", 0), (1, 11, 1, "bm25", 2), (1, 10, 2, "bm25", 2), (2, 12, 1, "sparse", 1)], "query_id int, doc_id int, rank int, path string, path_order int")
    coarse = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (2, 12, 1)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 13)], "query_id int, doc_id int")
    questions = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = A.traces(questions, paths, coarse, coarse.filter("rank <= 1"), gold)
    assert rows(got, "query_id", "bm25_rank", "l1_count", "l2_count", "l3_count", "eliminated_at")[1:] == [(2, None, 1, 1, 1, "l1"), (3, None, 0, 0, 0, "l1")]
    assert rows(got, "query_id", "dense_count", "bm25_rank", "l1_rank", "l2_rank", "l3_rank", "eliminated_at")[0] == (1, 1, 1, 2, 1, 1, "none")


def test_smoke_errors(spark):
    hit = "query_id int, doc_id string, article_no string, rank int, source_level string, citation_eligible boolean, official_url string, effective_date string, citation_label string, activation_status string, excerpt string"
    hits = spark.createDataFrame([(1, "a", "5", 1, "A", True, "https://x/1", "2020", "no. 5", "ACTIVE", "pay and rest"), (2, "b", "6", 1, "B", None, None, "", "none", "PENDING", " ")], hit)
    want = spark.createDataFrame([(1, "a", "5", "https://x", "2020", ["pay", "rest"]), (2, "b", "6", "https://x", "2020", ["pay"]), (3, "c", "7", "https://x", "2020", [])], "query_id int, doc_id string, article_no string, official_url_prefix string, effective_date string, required_terms array<string>")
    got = {r["query_id"]: r for r in A.smoke_errors(hits, want).collect()}
    assert (got[1]["errors"], got[1]["passed"]) == ([], True)
    assert got[2]["errors"] == sorted("level_not_a not_eligible missing_url missing_date blank_excerpt other_url other_date label_without_article not_active missing_term".split())
    assert (got[3]["errors"], got[3]["n_documents"], got[3]["passed"]) == (["expected_not_found"], 0, False)
    assert "not_active" not in {r["query_id"]: r for r in A.smoke_errors(hits, want, allow_pending=True).collect()}[2]["errors"]


def test_locate_facts(spark):
    pages = spark.createDataFrame([("d", 1, "pay is due"), ("d", 2, "the pay  is due now"), ("d", 3, "pay is due"), ("e", 1, None)], "doc_id string, page_no int, text string")
    asked = [
        ("d", "right", 0, "pay is due", [3]), ("d", "folded", 0, "pay is due", [2]), ("d", "nowhere", 0, "pay is due", [9]), ("d", "all", 0, " pay is due ", None),
        ("d", "twice", 0, "is due", [1]), ("d", "twice", 1, "is due", [1]), ("d", "blank", 0, " ", None), ("d", "absent", 0, "rest", None), ("e", "null", 0, "rest", None),
    ]
    got = A.locate_facts(spark.createDataFrame(asked, "doc_id string, fact_id string, candidate_no int, quote string, preferred array<int>"), pages)
    want = [("all", 1, "exact", 0, 10), ("folded", 2, "normalized", 4, 15), ("nowhere", 1, "exact", 0, 10), ("right", 3, "exact", 0, 10), ("twice", 1, "exact", 4, 10)]
    assert rows(got, "fact_id", "page_no", "match_type", "char_start", "char_end") == want


def test_reports(spark):
    reviews = spark.createDataFrame([(1,), (2,), (2,)], "r int")
    found = spark.createDataFrame([(1, "LC-1", "possible_conflict", "q"), (1, "LC-1", "observation", "q"), (1, "LC-2", "possible_conflict", "p"), (1, "LC-3", "possible_conflict", "s"), (1, "LC-4", "possible_conflict", "t")], "r int, rule_id string, finding_type string, query string")
    text = spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (1, None)], "r int, text string")
    none = text.filter("false")
    assert rows(A.law_queries(reviews, found, "r"), "r", "rule_id") == [(1, "LC-1"), (1, "LC-2"), (1, "LC-3"), (1, "LC-4"), (2, "LC-BASE")]
    assert rows(A.case_queries(found, "r"), "rule_id", "case_no") == [("LC-1", 1), ("LC-2", 2), ("LC-3", 3)]
    columns = ("r", "findings", "conflicts", "pending_questions", "warnings", "workflow_status")
    assert rows(A.report_rows(reviews, found, text, none, "r"), *columns) == [(1, 5, 4, 1, 0, "COMPLETED"), (2, 0, 0, 0, 1, "COMPLETED")]
    assert rows(A.report_rows(reviews, found, none, text, "r"), *columns)[0] == (1, 5, 4, 0, 1, "PARTIAL")
    states = spark.createDataFrame([("confirmed", "v"), ("deferred", "v"), (None, "v")], "s string, v string")
    assert [r[0] for r in states.select(A.resolved_value(F.col("s"), F.col("v"))).collect()] == ["v", None, None]


def test_history(spark):
    messages = [("7", 0, "user", "new"), ("7", 1, "system", "x"), ("contract-review:7", 0, "user", "old"), ("8", 0, "user", ""), ("contract-review:8", 0, "assistant", "old")]
    got = A.report_history(spark.createDataFrame([(7, 7), (8, 8), (9, None)], "review_id int, session_id int"), spark.createDataFrame(messages, "thread string, turn int, role string, text string"))
    assert rows(got, "review_id", "thread", "text") == [(7, "7", "new"), (8, "contract-review:8", "old")]


def test_chosen_titles(spark):
    held = [("a  law", 1, 3), ("a law", 2, 1), ("b", 3, 3), ("b", 4, 3), ("c", 5, 1), ("d", 6, 1), ("d", 7, None)]
    got = A.chosen_titles(spark.createDataFrame([("a law",), ("b",), ("c",), ("d",), ("e",)], "title string"), spark.createDataFrame(held, "title string, candidate_id int, status_code int"))
    assert rows(got, "title", "outcome") == [("a law", "chosen"), ("b", "several_effective"), ("c", "not_effective"), ("d", "several_not_effective"), ("e", "not_found")]
    assert got.filter("title = 'a law'").first()["chosen"] == 1


def test_remaining(spark):
    work, schema = spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k int, model string"
    assert rows(A.remaining(work, spark.createDataFrame([(2, "m")], schema), "k", model="m"), "k") == [(1,), (3,)]
    assert A.remaining(work, spark.createDataFrame([], schema), "k", model="m").count() == 3
    for done, why in (([(2, "n")], "of_another_run"), ([(2, None)], "of_another_run"), ([(2, "m"), (2, "m")], "repeated"), ([(9, "m")], "unknown")):
        with pytest.raises(ValueError, match=why):
            A.remaining(work, spark.createDataFrame(done, schema), "k", model="m")


def test_retrieved_by_sets_of_rules(spark):
    """Distinct documents of each review's queries, against sets; reviews aren't joined with documents."""
    from lexmill.operators.review_graph import retrieved

    asks = {r: {f"R{(r * k) % 7}" for k in range(1, 1 + r % 4)} for r in range(1, 60)}
    docs = {f"R{n}": {d for d in range(40) if d % (n + 2) == 0} for n in range(6)}  # R6 finds none
    queries = spark.createDataFrame([(r, q) for r, some in asks.items() for q in some], "review int, rule_id string")
    hits = spark.createDataFrame([(q, d) for q, some in docs.items() for d in some] * 2, "rule_id string, doc_id int")
    got = retrieved(queries, hits, "review", "n")
    want = {r: (len(set().union(*[docs.get(q, set()) for q in some])), "R6" in some) for r, some in asks.items() if some}
    assert {r["review"]: (r["n"], r["n_missing"]) for r in got.collect()} == want
    assert "rule_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_vectors(spark):
    docs = spark.createDataFrame([(1, "rate rate pay"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: dict(zip(r["indices"], r["weights"], strict=True)) for r in A.bm25_vectors(docs).collect()}
    ids = {r[0]: r[1] for r in spark.createDataFrame([("rate",), ("pay",)], "t string").select("t", token_id("t")).collect()}
    weight = lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 256))
    assert got == {1: {ids["rate"]: pytest.approx(weight(2)), ids["pay"]: pytest.approx(weight(1))}}


def test_bm25_index_sql(spark, tmp_path):
    """Words of one id count once in the SQL too, whatever their length; a weight of half a unit is rounded alike."""
    import duckdb

    from lexmill.plans import acceptance_plans

    pair = colliding()
    docs = [(1, " ".join(pair) + " pay"), (2, "x" * 64 + " " + "y" * 200 + " x x"), (3, None)] + [(n, "w " * n + "v " * (n * n)) for n in range(4, 60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    c.sql("create table benchmark (item_id bigint, text varchar)")
    got = sorted(tuple(r) for r in acceptance_plans.bm25_index(spark, str(tmp_path)).collect())
    assert got[0][1] == 2
    assert got == sorted(c.sql(acceptance_plans.SQL["bm25_index"]).fetchall())


def colliding() -> tuple[str, str]:
    """Two words of one token id."""
    from hashlib import blake2s

    seen: dict[bytes, str] = {}
    for n in range(1 << 20):
        digest = blake2s(f"w{n}".encode(), digest_size=4).digest()
        if digest in seen:
            return seen[digest], f"w{n}"
        seen[digest] = f"w{n}"
    raise AssertionError("no collision")


@pytest.mark.parametrize("target", [0, 3, 5, 6, 9, 40])
def test_spot_checks_fill_up(spark, target):
    """Against the walk row by row that the selection stands for."""
    data = [(i, 100 - i if i % 7 else 500 + i, (i * 37) % 101) for i in range(30)]
    must = F.when(F.col("k") == 5, F.array(F.lit("refusal_answer"))).otherwise(F.array().cast("array<string>"))
    got = E.spot_checks(spark.createDataFrame(data, "k int, late int, size int").repartition(4), "k", must, "late", "size", target=target)
    want = {5: {"refusal_answer"}}
    for i, _, _ in sorted(data, key=lambda r: (-r[1], r[0]))[:2]:
        want.setdefault(i, set()).add("latency_outlier")
    want.setdefault(min(data, key=lambda r: (r[2], r[0]))[0], set()).add("shortest_answer")
    want.setdefault(min(data, key=lambda r: (-r[2], r[0]))[0], set()).add("longest_answer")
    for at in [0, 7, 15, 22, 29, *range(30)]:
        if len(want) >= target:
            break
        want.setdefault(at, set()).add("deterministic_coverage_sample")
    assert {r["k"]: r["reasons"] for r in got.collect()} == {k: ",".join(sorted(v)) for k, v in want.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, late int, size int")
    assert E.spot_checks(none, "k", F.array().cast("array<string>"), "late", "size", target=5).count() == 0
    assert A.bm25_vectors(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert A.answer_summary(spark.createDataFrame([], "a string, n int"), "a", "n").first()["answers"] == 0


def random_facts(n=400):
    """Facts of 60 reviews in words of the cards, with nulls, capitals and ties of order, and their findings by plain Python."""
    import random
    import re

    from lexmill.operators import labor_rules as L

    pick = random.Random(7).choice
    words = [a for _, _, aliases, _, _ in L.CARDS for a in aliases] + ["Salary", "TERM", "other", "", None]
    said = ["自愿放弃", "社保", "单方", "调整工资", "面议", "违约金", "随时解除", "两年", " ", "\n", "", None]
    facts = [(pick(range(60)), pick(range(3)), pick(words), pick(words), pick(said)) for _ in range(n)] + [(99, None, None, None, None)]
    want = set()
    for review in {f[0] for f in facts}:
        own = sorted((f for f in facts if f[0] == review), key=lambda f: (f[1] is not None, f[1] or 0, f[4] or ""))
        for rule, _, aliases, query, required in L.CARDS:
            values = [v or "" for _, _, c, name, v in own if any(a.lower() in f"{c or ''} {name or ''}".lower() for a in aliases)]
            hit = [(kind, risk) for r, pattern, kind, risk in L.CONDITIONS if r == rule and re.search(pattern, L.SEPARATOR.join(values))]
            if values and hit:
                want.add((review, rule, *hit[0], query))
            if required and not values:
                want.add((review, rule, "missing_information", "unconfirmed", query))
    return facts, want


FACTS = "review_id int, fact_id int, category string, name string, value string"


def test_review_findings_brute_force(spark):
    from lexmill.operators import labor_rules as L

    facts, want = random_facts()
    df = spark.createDataFrame(facts, FACTS)
    got = [tuple(r) for r in L.findings(df).select("review_id", "rule_id", "finding_type", "risk_level", "query").collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r["review_id"] for r in L.review_findings(df).collect()} == {f[0] for f in facts}


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Scan ")


def test_report_rows_from_held_reviews(spark):
    """The same rows as from frames, with one shuffle and one read of the facts."""
    from lexmill.operators import labor_rules as L

    facts, _ = random_facts()
    df = spark.createDataFrame(facts, FACTS)
    found, reviews = L.findings(df), df.select("review_id")
    texts = F.when(F.col("review_id") % 5 == 0, F.array(F.lit("a"), F.lit("a"), F.lit(""), F.lit(None), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    asked = F.transform(F.filter("found", lambda f: f["finding_type"] == "missing_information"), lambda f: f["query"])
    held = L.review_findings(df).withColumns({"questions": asked, "warnings": texts})
    got = A.held_report_rows(held, "review_id")
    assert shuffles(got) == (1, 1)
    want = A.report_rows(reviews, found, found.filter("finding_type = 'missing_information'").select("review_id", F.col("query").alias("text")), held.select("review_id", F.explode("warnings").alias("text")), "review_id")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_report_rows_plan(spark):
    from lexmill.plans import acceptance_plans as P

    assert shuffles(P.report_rows(spark, "/root/testdata/sf0.001")) == (1, 1)


def test_law_queries_from_held_reviews(spark):
    """The same rows as from frames, also for reviews without findings, with one shuffle and one read of the facts."""
    from lexmill.operators import labor_rules as L
    from lexmill.plans import acceptance_plans as P

    df = spark.createDataFrame(random_facts()[0], FACTS)
    held = L.review_findings(df).withColumn("found", F.when(F.col("review_id") % 3 != 0, F.col("found")).otherwise(F.slice("found", 1, 0)))
    got = A.held_law_queries(held, "review_id")
    want = A.law_queries(df.select("review_id"), L.findings(df).filter("review_id % 3 <> 0"), "review_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert shuffles(P.law_queries(spark, "/root/testdata/sf0.001")) == (1, 1)
