"""Tasks, payloads, artifacts and streams on frames with literal expectations."""

import json

from pyspark.sql import functions as F

from lexmill.operators import tasks as K


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_adapted_hit(spark):
    df = spark.createDataFrame([({"doc_id": "d", "chunk_text": "x" * 600, "article_no": "3", "user_id": "u"},), ({},)], "p map<string,string>")
    first, bare = column(df, K.adapted_hit(F.col("p")))
    assert (first["doc_id"], len(first["text"]), len(first["context_text"]), first["metadata"]) == ("d", 600, 500, {"article_no": "3"})
    assert (bare["doc_id"], bare["text"], bare["metadata"]) == ("", "", {})


def test_report_citations(spark):
    good = (1, "A", True, 1, "https://law/1", "2020", "《x》第一条", "said", "ACTIVE")
    bad = (2, None, None, None, " http://law", " ", "", None, "OLD")
    wait = (3, "A", True, 2, "https://law/1", "2020", "序言", "said", "PENDING_LEGAL_REVIEW")
    sources = spark.createDataFrame([good, bad, wait], "r int, source_level string, citation_eligible boolean, rank int, official_url string, effective_date string, citation_label string, quote string, legal_activation_status string")
    reports = spark.createDataFrame([(1,), (2,), (3,), (4,)], "r int")
    got = {r["r"]: (r["errors"], r["passed"]) for r in K.report_citations(reports, sources, "r", "https://law/").collect()}
    assert got[1] == ([], True)
    assert got[2][0] == sorted("wrong_level not_eligible bad_rank other_url missing_date missing_label missing_quote bad_status".split())
    assert got[3][0] == ["label_without_article", "not_active"]
    assert got[4] == (["no_sources"], False)
    lenient = {r["r"]: r["errors"] for r in K.report_citations(reports, sources, "r", "https://law/", allow_pending=True).collect()}
    assert lenient[3] == ["label_without_article"]


def test_states(spark):
    rows = [(1, "queued", None), (2, "ready", "running"), (3, "ready", "ready"), (4, "failed", "running"), (5, "needs_confirmation", None), (6, None, None)]
    tasks = spark.createDataFrame(rows, "k int, status string, extraction_status string")
    assert pairs(K.unfinished(tasks), "k", "step") == [(1, "process"), (2, "extract")]
    assert column(tasks.orderBy("k"), K.terminal(F.col("status"), F.col("extraction_status"))) == [False, False, True, True, False, False]
    assert column(tasks.orderBy("k"), K.terminal(F.col("status"), F.col("extraction_status"), False)) == [False, True, True, True, True, False]


def test_owned_reports_and_requests(spark):
    tasks = spark.sql("select * from values (1, 'a', timestamp '2024-01-05', null, null), (2, 'a', timestamp '2023-01-05', null, null), (3, 'b', timestamp '2024-01-05', timestamp '2024-01-06', null), (4, 'b', timestamp '2024-01-05', null, timestamp '2024-01-06') t(k, user_id, created_at, expires_at, deleted_at)")
    reports = spark.createDataFrame([(k, v, f"r{v}") for k in (1, 2, 3, 4) for v in (1, 2)], "k int, report_version int, report string")
    assert pairs(K.owned_reports(tasks, reports, "k", F.lit("2024-01-07").cast("timestamp")), "k", "user_id", "report") == [(1, "a", "r2")]
    sent = spark.createDataFrame([(1, "x", 1, 10), (1, "x", 2, 11), (2, "y", 1, 12)], "k int, request_id string, created_at int, confirmation_id int")
    asked = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (1, "a", "new")], "k int, user_id string, request_id string")
    assert pairs(K.handled_requests(asked, sent, tasks, "k"), "k", "request_id", "confirmation_id") == [(1, "x", 11)]
    flipped = K.flipped(tasks.select("k", "user_id"), spark.createDataFrame([(2,), (9,)], "k int"), "k", user_id="z")
    assert pairs(flipped, "k", "user_id") == [(1, "a"), (2, "z"), (3, "b"), (4, "b")]


def test_approval(spark):
    schema = "name string, sha256 string"
    got = K.approval_state(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], schema))
    assert pairs(got, "name", "state") == [("a", "unchanged"), ("b", "changed"), ("c", "missing"), ("d", "added")]


def test_tool_contexts(spark):
    texts = [json.dumps({"context": "[1] src\none\ntwo\n\n\n\nbare"}), json.dumps({"context": "(empty)"}), json.dumps({"contexts": ["a", " "], "context": "[1]\nx"}), "no json", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert column(df, K.tool_contexts(F.col("t"))) == [["one\ntwo", "bare"], [], ["a"], [], [], []]


def test_stream_events(spark):
    bodies = [':keepalive\n\ndata: {"a":1}\n\nevent: t\ndata: {"b":2}\ndata: {"c":3}\n\ndata: broken\n\ndata: {"d":4}', "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i")
    assert column(df, K.stream_events(F.col("b"))) == [['{"a":1}', '{"b":2}'], [], None]


def test_answers_and_questions(spark):
    schema = "a string, c array<string>, d array<struct<rank:int,chunk_id:string>>"
    rows = spark.createDataFrame([("x", ["c"], [(1, "k")]), (" ", [], None), ("x", ["c"], [(1, "k"), (3, "")])], schema)
    assert column(rows, K.answer_errors(F.col("a"), F.col("c"), F.col("d"))) == [[], ["missing_answer", "missing_contexts", "missing_documents"], ["counts_differ", "ranks_not_contiguous", "missing_chunk_id"]]
    asked = [("1", "q", ("d", ["t"])), ("2", " ", (None, [])), ("2", "q", ("d", ["t", " "])), (None, "q", ("d", None))]
    found = K.question_errors(spark.createDataFrame(asked, "question_id string, query string, expected struct<doc_id:string,required_terms:array<string>>"), ["doc_id"])
    assert sorted(r["errors"] for r in found.collect()) == [[], ["missing_id", "repeated_id", "bad_terms"], ["repeated_id", "bad_terms"], ["repeated_id", "missing_query", "missing_doc_id", "bad_terms"]]
    titles = spark.createDataFrame([("法", "第一条"), (None, None)], "t string, n string")
    assert column(titles, K.direct_question(F.col("t"), F.col("n"))) == ["根据《法》第一条，该条文规定了什么？", "根据《法律文件》该条，该条文规定了什么？"]


def test_manifest(spark):
    chunks = spark.createDataFrame([("a", "xx"), ("a", "y"), ("b", "z")], "d string, t string")
    one, two = (K.manifest(c, "d", "t", 8, 100, 10).first() for c in (chunks, chunks.repartition(3).orderBy(F.desc("t"))))
    assert (one["documents"], one["chunks"], one["characters"]) == (2, 3, 4) and one == two
    bad = K.manifest(chunks.filter("false"), "d", "t", 0, 10, 10)
    assert column(bad, K.manifest_errors(F.lit(5))) == [["no_documents", "no_chunks", "bad_dimension", "bad_overlap", "other_count"]]


def test_rendered_and_context(spark):
    blocks = spark.createDataFrame([("a", 0, " T ", "T"), ("a", 1, "", "T"), ("a", 2, "one", "T"), ("a", 3, "T", "T"), ("b", 0, None, None)], "d string, n int, x string, title string")
    assert pairs(K.rendered(blocks, "d", "n", "x", "title"), "d", "markdown", "n_paragraphs") == [("a", "# T\n\none\n\nT\n", 2), ("b", "# \n", 0)]
    tasks = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "k int, facts string")
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 3, None)], "k int, page_no int, text string")
    got = dict(pairs(K.contract_context(tasks, pages, "k", {"facts": "facts"}, 1000), "k", "context"))
    assert got[1] == 'facts:\n{"a":1}\n\npages:\n[第 1 页]\none\n\n[第 2 页]\ntwo\n\n[第 3 页]\n'
    assert got[2].startswith("facts:\n{}\n\npages:\n[")
    assert all(len(c) <= 20 for _, c in pairs(K.contract_context(tasks, pages, "k", {"facts": "facts"}, 20), "k", "context"))
