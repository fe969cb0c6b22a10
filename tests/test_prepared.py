"""Checks of prepared corpora, review facts and small readers on frames with literal expectations."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import conversation as C
from lexmill.operators import evaluation as E
from lexmill.operators import prepared as P
from lexmill.operators import retrieval as R
from lexmill.operators import review as V
from lexmill.operators import store
from lexmill.sources import readers, sinks
from lexmill.storage import materialize


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_article_and_chunk_errors(spark):
    articles = spark.createDataFrame([("a", "one two", sha("one two"), 2), ("b", "", sha(""), 1), ("c", "x", sha("x"), 1), ("c", "x", sha("x"), 1), ("d", "y", "wrong", 1)], "article_id string, text string, sha256 string, chunk_count int")
    rows = [("a", 0, "p1", sha("one two"), 0, 3, "one", sha("one"), "one", 2), ("a", 2, "p2", sha("one two"), 4, 7, "tow", sha("tow"), " ", 2), ("c", 0, "p3", sha("x"), 0, 9, "x", sha("x"), "x", 1), ("e", 0, "p3", "?", 0, 1, "e", "?", "e", 1)]
    chunks = spark.createDataFrame(rows, "article_id string, chunk_index int, point_id string, article_sha256 string, start int, end int, excerpt string, excerpt_sha256 string, chunk_text string, chunk_count int")
    got = {r["article_id"]: r["errors"] for r in P.article_errors(articles, chunks).collect()}
    assert got == {"a": ["not_contiguous"], "b": ["missing_text", "no_chunks", "wrong_count"], "c": ["repeated_id"], "d": ["hash_differs", "no_chunks", "wrong_count"]}
    got = {(r["article_id"], r["chunk_index"]): r["errors"] for r in P.chunk_errors(articles, chunks).collect()}
    assert got == {("a", 0): [], ("a", 2): ["excerpt_differs", "blank_text"], ("c", 0): ["repeated_point", "beyond_article"], ("e", 0): ["repeated_point", "unknown_article", "hash_differs"]}


def test_chunk_texts_are_not_shuffled(spark, monkeypatch):
    """Chunks are written and joined without their texts; one whose place says something else is still found."""
    kept = {}
    monkeypatch.setattr(P, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    text = "some words " * 400
    articles = spark.createDataFrame([(1, text, sha(text), 5)], "article_id long, text string, sha256 string, chunk_count int")
    rows = [(1, k, f"p{k % 4}", sha(text), k * 800, min(k * 800 + 1000, len(text)), text[k * 800 : k * 800 + 1000]) for k in range(5)]
    rows[2] = (*rows[2][:6], rows[2][6].replace("words", "WORDS"))
    chunks = spark.createDataFrame(rows, "article_id long, chunk_index int, point_id string, article_sha256 string, start int, end int, excerpt string")
    chunks = chunks.withColumns({"excerpt_sha256": F.sha2("excerpt", 256), "chunk_text": F.col("excerpt")})
    got = {r["chunk_index"]: r["errors"] for r in P.chunk_errors(articles, chunks).collect()}
    assert got == {0: ["repeated_point"], 1: [], 2: ["excerpt_differs"], 3: [], 4: ["repeated_point"]}
    assert not {"excerpt", "chunk_text"} & set(kept["chunk-marks"].columns) and kept["repeated-points"].count() == 1


def test_source_errors(spark):
    names = "doc_id title source_level target_collection status effective_date official_url raw_file markdown_file raw_sha256 raw_found markdown_sha256 markdown_found".split()
    good = ("d", "t", "A", "legal", "有效", "2024-01-01", "https://x", "raw/a.docx", "md/a.md", "h", "h", "m", "m")
    bad = (None, "", "B", "other", "废止", "2024", "http://x", "", "../a.md", "h", "g", "m", "n")
    rows = spark.createDataFrame([good, bad], ", ".join(f"{n} string" for n in names))
    found = [r[0] for r in rows.select(P.source_errors("legal")).collect()]
    assert found[0] == []
    assert found[1] == "missing_id missing_title level_not_a wrong_collection not_in_force bad_date not_https missing_file outside_folder raw_hash_differs markdown_hash_differs".split()


def test_vectors(spark):
    rows = [([3.0, 4.0], {1: 0.5}), ([0.0, 0.0], {}), ([1.0, float("nan")], {-1: 1.0}), ([1.0], {5: 0.0}), (None, {1: 1.0})]
    df = spark.createDataFrame(rows, "v array<double>, s map<int,double>")
    assert [r[0] for r in df.select(P.vector_errors(F.col("v"), 2, F.col("s"))).collect()] == [[], ["zero_vector", "no_sparse"], ["not_finite", "bad_token"], ["wrong_dimension", "bad_weight"], ["missing_vector", "wrong_dimension", "not_finite", "zero_vector"]]
    assert df.select(P.normalised(F.col("v"))).first()[0] == [0.6, 0.8]


def test_token_ids_and_collisions(spark):
    words = spark.createDataFrame([("learning",), ("rate",), ("学习",)], "token string")
    want = {w: int.from_bytes(hashlib.blake2s(w.encode(), digest_size=4).digest(), "big") for w in ("learning", "rate", "学习")}
    assert {r[0]: r[1] for r in words.select("token", P.token_id("token")).collect()} == want
    assert tuple(P.collisions(words).first()) == (3, 3, 0)
    assert tuple(P.collisions(words.unionAll(words)).first()) == (6, 3, 6)


def walked(value, names, path="$"):
    """Brute force: paths of keys among the names in parsed JSON."""
    pairs = [(f".{k}", k, v) for k, v in value.items()] if isinstance(value, dict) else [(f"[{i}]", None, v) for i, v in enumerate(value)] if isinstance(value, list) else []
    return [p for step, k, v in pairs for p in ([path + step] if k in names else []) + walked(v, names, path + step)]


def test_key_paths_brute_force():
    import json
    import random

    rng = random.Random(1)

    def some(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice([None, True, -1.5e3, 7, "a\"]}{", "é\n", ""])
        return [some(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice(["a", "b", "token", "", "x\"y"]) + rng.choice(["", "1"]): some(depth - 1) for _ in range(rng.randrange(4))}

    names = frozenset({"token", "a", 'x"y', ""})
    for _ in range(3000):
        value = some(5)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert P.key_paths(text, names) == walked(value, names), text
        at = rng.randrange(len(text) + 1)
        broken = text[:at] + rng.choice('{}[]:,"0 a') + text[at + rng.randrange(2) :]
        try:
            pairs = json.loads(broken, object_pairs_hook=lambda x: x)
        except ValueError:
            assert P.key_paths(broken, names) is None, broken
        else:
            assert P.key_paths(broken, names) is not None, (broken, pairs)


def test_key_paths_at_any_depth(spark):
    deep = '{"a":[' * 50_000 + '{"token":1}' + "]}" * 50_000
    got = spark.createDataFrame([(deep,), ("[" * 3000,), ("[" * 3000 + "]" * 3000,)], "p string").select(P.private_key_paths(("token",))("p").alias("f")).collect()
    assert [len(r["f"]) for r in got] == [1, 0, 0]
    assert got[0]["f"][0] == "$" + ".a[0]" * 50_000 + ".token"


def test_private_paths(spark):
    payloads = [json.dumps({"a": [{"token": 1}, {"b": {"path": "x"}}], "token": 2}), "[1, 2]", "no json", None]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r[0] for r in df.select(P.private_key_paths(("token", "path"))("p")).collect()] == [["$.a[0].token", "$.a[1].b.path", "$.token"], [], [], []]


def test_facts(spark):
    rows = [("v", "extracted", 1, 0.9, False), ("v", "confirmed", 1, 1.4, False), ("未知", "extracted", 1, 0.9, False), ("v", "contradicted", 1, 0.9, False), ("v", "extracted", 0, 0.9, None)]
    df = spark.createDataFrame(rows, "value string, given string, n int, sure double, flagged boolean")
    df = df.withColumns(V.built_fact(F.col("value"), F.col("given"), F.col("n"), F.col("sure"), F.col("flagged")))
    got = df.select("status", "needs_confirmation", "confidence", V.allowed_actions(F.col("status"), F.col("needs_confirmation"), F.col("value"), F.col("n")).alias("a"), V.initial_state(F.col("needs_confirmation"), F.col("value"))["state"].alias("s")).collect()
    assert [r["status"] for r in got] == ["extracted", "confirmed", "missing", "contradicted", "needs_confirmation"]
    assert [r["needs_confirmation"] for r in got] == [False, False, True, True, True]
    assert got[1]["confidence"] == 1.0
    assert [len(r["a"]) for r in got] == [4, 5, 4, 4, 3]
    assert [r["s"] for r in got] == ["confirmed", "confirmed", "unreviewed", "unreviewed", "unreviewed"]


def test_retrieval_in_blocks(spark):
    """Queries and vectors dealt in blocks of one give what one block gives; a passage's place doesn't matter."""
    docs = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 3)} w{i}") for i in range(30)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w3"), (2, "gamma gamma"), (3, ""), (4, "nothing")], "item_id long, text string")
    whole = sorted(map(tuple, R.lexical_hits(docs, asked, 5).collect()))
    blocks = list(R.query_blocks(asked, "item_id", "text", max_bytes=1))
    assert len(blocks) == 4
    assert {r[0] for r in whole} == {1, 2}
    assert [r[1] for r in whole if r[0] == 1 and r[3] == "bm25" and r[5] == 1] == [3]
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    few = vectors.filter("vec_id < 3")
    assert sorted(map(tuple, R.dense_hits(vectors, few, 4, max_bytes=1).collect())) == sorted(map(tuple, R.dense_hits(vectors, few, 4).collect()))
    said = "one two three four five six seven eight nine"
    held = spark.createDataFrame([(1, f"xx{said}yy"), (2, said.replace("five", "5")), (3, "x nine y"), (1, f"a {said}")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, said), (8, "nine"), (9, None)], "item_id long, text string")
    assert sorted(map(tuple, R.containing_pairs(held, passages).collect())) == [(7, 1), (7, 1), (8, 1), (8, 1), (8, 2), (8, 3)]


def test_small_readers(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    assert tuple(readers.json_object(spark, str(tmp_path / "one.json")).first()) == (1, "x")
    folder = tmp_path / "trio"
    folder.mkdir()
    for role in ("corpus", "questions"):
        spark.range(2).toPandas().to_parquet(folder / f"{role}.parquet")
    found = readers.parquet_roles(spark, str(folder), ("corpus", "questions"))
    assert {k: v.count() for k, v in found.items()} == {"corpus": 2, "questions": 2}
    with pytest.raises(ValueError):
        readers.parquet_roles(spark, str(folder), ("answers",))
    sinks.csv(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_small_expressions(spark):
    ids = spark.createDataFrame([("test_10",), ("test_9",), ("x",)], "i string")
    assert [r[0] for r in ids.orderBy(E.numeric_suffix(F.col("i"))).collect()] == ["x", "test_9", "test_10"]
    assert spark.range(1).select(T.embedding_text(F.lit("t"), F.lit(""), F.lit("body"))).first()[0] == "t\nbody"
    assert [r[0] for r in spark.createDataFrame([("contract_review", "7"), ("chat", None)], "m string, c string").select(C.scope_label(F.col("m"), F.col("c"))).collect()] == ["contract:7", "chat"]
    assert [r[0] for r in spark.createDataFrame([("试用期限", "zh"), ("Two Words", "en")], "t string, l string").select(T.tokens(F.col("t"), F.col("l"))).collect()] == [["试用", "用期", "期限"], ["two", "words"]]
    pages = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "d string, o int")
    assert sorted(map(tuple, store.numbered_pages(pages, "d", "o").collect())) == [("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]
    passages = spark.createDataFrame([(1, "a  b"), (2, "zz")], "k int, passage string")
    texts = spark.createDataFrame([(1, "x a\nb y"), (2, "nothing")], "k int, text string")
    assert [r["k"] for r in V.contained(passages, texts, "k").collect()] == [1]
