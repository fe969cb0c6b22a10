"""Operators on small frames with literal expectations."""

from pyspark.sql import functions as F

from lexmill.operators import conversation as C
from lexmill.operators import evaluation as E
from lexmill.operators import governance as G
from lexmill.operators import labor_rules as L
from lexmill.operators import retrieval as R
from lexmill.operators import review as V
from lexmill.operators import store


def test_scores_of_golden_question(spark):
    hits = spark.createDataFrame([(1, "noise", 1), (1, "a", 2), (1, "a", 3)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, doc_id string")
    got = {r["query_id"]: r for r in E.retrieval_scores(hits, gold).collect()}
    assert tuple(got[1])[1:] == (2, 0, 1, 0.5, 0.5)
    assert tuple(got[2])[1:] == (None, 0, 0, 0.0, 0.0)
    questions = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert tuple(E.retrieval_summary(E.retrieval_scores(hits, gold), questions).first()) == (3, 2, 0.0, 0.333333, 0.166667, 0.166667)


def test_fusion_traps(spark):
    rows = [(1, 10, 0.9, 1, "dense"), (1, 11, 0.1, 2, "dense"), (1, 11, 5.0, 1, "sparse"), (1, 12, 4.0, 1, "bm25"), (1, 13, 1.0, 2, "bm25")]
    paths = spark.createDataFrame(rows, "query_id int, doc_id int, score double, rank int, path string")
    s = spark.createDataFrame([(1, 0.8)], "query_id int, s double")
    got = {r["doc_id"]: r for r in R.fuse(paths, s).collect()}
    assert got[11]["sparse"] == 0.0  # a lone hit scales to 0
    assert got[10]["score"] == 0.5  # the floor of a strong dense hit
    assert got[12]["score"] == 0.4
    final = R.funnel(paths, s).orderBy("rank").collect()
    assert [r["doc_id"] for r in final] == [10, 12, 11]  # ties go to the smaller id
    reranked = spark.createDataFrame([(1, 13, 0.9), (1, 11, 0.8)], "query_id int, doc_id int, relevance double")
    assert [r["doc_id"] for r in R.funnel(paths, s, reranked=reranked).orderBy("rank").collect()] == [13, 11]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert tuple(df.agg(E.nearest_rank("v", 0.5), E.linear_percentile("v", 0.5)).first()) == (2.0, 2.5)


def test_answers(spark):
    df = spark.createDataFrame([("I cannot answer [4] " + "x" * 60,), ("ok",), ("fine [1][2] " + "y" * 60,)], "a string")
    assert [r[0] for r in df.select(E.inspect_answer(F.col("a"), F.lit(3))).collect()] == [["refusal_answer", "invalid_citation"], ["missing_citation", "short_answer"], []]


def test_governance(spark):
    rows = [(1, "A", True, "ACTIVE"), (2, "B", True, "PENDING"), (3, "C", True, "ACTIVE"), (4, "A", None, "ACTIVE"), (5, "A", True, None)]
    df = spark.createDataFrame(rows, "i int, level string, ok boolean, status string")
    pick = lambda **k: [r["i"] for r in df.filter(G.eligible(F.col("level"), F.col("ok"), F.col("status"), **k)).collect()]
    assert pick() == [1]
    assert pick(allow_pending=True) == [1, 2, 5]
    modes = spark.createDataFrame([("x" * 50, 0.0), ("x" * 50, 0.5), ("x" * 20, 0.0), (" 　" * 40, 0.0)], "t string, r double")
    assert [r[0] for r in modes.select(G.page_mode(F.col("t"), F.col("r"))).collect()] == ["native", "hybrid", "hybrid", "scanned"]
    assert spark.range(1).select(G.errors(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean"))).first()[0] == ["a", "c"]


def test_clauses_and_headings(spark):
    assert [r[0] for r in spark.createDataFrame([("第一条 合同期限",), ("劳动报酬",), ("这是正文，很长。",), ("",), ("2.1 试用期：",)], "t string").select(V.heading(F.col("t"))).collect()] == ["合同期限", "劳动报酬", None, None, "试用期"]
    assert spark.range(1).select(V.clause_type(F.lit("工作地点")), V.clause_type(F.lit("知识产权")), V.clause_type(F.lit("别的"))).first()[:] == ("work_location", "intellectual_property", "other")
    lines = [(1, 1, 0, ""), (1, 1, 1, "H1"), (1, 1, 2, "x"), (1, 2, 0, "y"), (1, 2, 1, "H2"), (1, 2, 2, "z")]
    df = spark.createDataFrame(lines, "d int, p int, n int, t string")
    got = V.clauses(df, "d", "p", "n", "t", F.col("t").startswith("H")).orderBy("clause_id").collect()
    assert [(r["clause_id"], r["title"], r["page_start"], r["page_end"], r["n_lines"]) for r in got] == [("clause_001", "H1", 1, 2, 4), ("clause_002", "H2", 2, 2, 2)]


def test_articles(spark):
    lines = ["", "intro", "第一章 总则", "第一条 甲", "text", "", "第一节 乙", "第二条", "more", "第二章 丙", "第三条 丁"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "d int, n int, t string")
    t = F.col("t")
    got = V.articles(df, "d", "n", "t", t.rlike("^第.+章"), t.rlike("^第.+节"), t.rlike("^第.+条")).orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [(0, None, None, None, "intro"), (1, "第一条 甲", "第一章 总则", None, "第一条 甲\ntext"), (2, "第二条", "第一章 总则", "第一节 乙", "第二条\nmore"), (3, "第三条 丁", "第二章 丙", None, "第三条 丁")]


def test_quotes(spark):
    df = spark.createDataFrame([("b c", "a b c"), ("b  c", "a b\n c"), ("x", "a"), ("", "a"), ("(b) *", "a (b)\t* c")], "q string, t string")
    got = [r[0] and tuple(r[0]) for r in df.select(V.locate_quote(F.col("q"), F.col("t"))).collect()]
    assert got == [("exact", 2, 5), ("normalized", 2, 6), None, None, ("normalized", 2, 7)]


def test_facts(spark):
    rows = [(1, "A", "x", "1年"), (2, "a", "X", "2年"), (3, "a", "y", "1"), (4, "a", "y", None), (5, "B", "z", "2024年1月2日"), (6, "b", "z", "2024-1-2")]
    got = V.mark_contradictions(spark.createDataFrame(rows, "i int, c string, n string, v string"), "v", "c", "n").collect()
    assert {r["i"] for r in got if r["contradicted"]} == {1, 2}
    facts = spark.createDataFrame([(1, 1, "社会保险", "x", "自愿放弃社保"), (1, 2, "other", "工资", "5000"), (2, 1, "misc", "misc", "无")], "review_id int, fact_id int, category string, name string, value string")
    found = {(r["review_id"], r["rule_id"]): (r["finding_type"], r["risk_level"]) for r in L.findings(facts).collect()}
    assert found[1, "LC-010"] == ("possible_conflict", "high")
    assert (1, "LC-006") not in found
    assert found[2, "LC-010"] == ("missing_information", "unconfirmed")
    assert len([k for k in found if k[0] == 2]) == 7


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect()), key=str) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(map(tuple, store.merge_fields(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert {(r["k"], r["next_version"]) for r in store.next_version(old.selectExpr("k", "k * 3 AS version"), new, "k").collect()} == {(2, 7), (3, 1)}
    known = spark.createDataFrame([("h1", "s1"), ("h2", "s9")], "sha256 string, source string")
    rows = spark.createDataFrame([("h1", "s1"), ("h2", "s2"), ("h3", "s3")], "sha256 string, source string")
    assert {(r["sha256"], r["route"]) for r in store.route_ingest(rows, known).collect()} == {("h1", "skip"), ("h2", "sync"), ("h3", "store")}


def test_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "c int, t int, r string, x string")
    assert [tuple(r) for r in C.condense(df, "c", "t", "r", "x").collect()] == [(1, 7, "user: m0\nai: m1")]
    assert C.question_answers(df, "c", "t", "r", "x").count() == 3
