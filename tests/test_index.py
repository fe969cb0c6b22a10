"""Indexes against scans of all rows, and automaton search against trying every pair."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import index
from lexmill.operators import retrieval as R
from lexmill.plans import retrieval_plans
from lexmill.session import table
from lexmill.storage import materialize, shared_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 60)))) for i in range(800)] + [(800, None), (801, "")]
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(30)] + [(30, "unheard of"), (31, None), (32, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")


@pytest.mark.parametrize("segment_docs", [100, 1 << 20])
def test_text_index_equals_scan(spark, texts, segment_docs):
    folder = shared_path(spark, "index")
    index.build_text_index(texts[0], folder, buckets=8, segment_docs=segment_docs)
    want = R.lexical_hits(*texts, paths=("bm25",)).drop("path", "path_order")
    assert rows(index.search_text_index(spark, folder, texts[1])) == rows(want)
    assert rows(index.search_text_index(spark, folder, texts[1], k=1)) == [r for r in rows(want) if r[3] == 1]


def test_search_reads_only_its_terms(spark, texts, tmp_path):
    """Folders of other terms are gone, and the search doesn't miss them."""
    folder = str(tmp_path / "index")
    index.build_text_index(texts[0], folder, buckets=32)
    asked = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    want = rows(index.search_text_index(spark, folder, asked))
    needed = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(index.bucket("t", 32)).collect()}
    for kind in ("blocks", "terms"):
        for path in (tmp_path / "index" / kind).glob("bucket=*"):
            if int(path.name.split("=")[1]) not in needed:
                shutil.rmtree(path)
    assert len(want) == 10
    assert rows(index.search_text_index(spark, folder, asked)) == want


def test_early_stop(spark, texts, monkeypatch):
    """Of a common and a rare term, documents that only have the common one aren't even found."""
    folder = shared_path(spark, "index")
    docs = texts[0].unionByName(spark.createDataFrame([(1000 + i, "rare rare rare w0") for i in range(12)], "doc_id long, text string"))
    index.build_text_index(docs, folder, buckets=4)
    asked = spark.createDataFrame([(1, "rare w0")], "item_id long, text string")
    kept = {}
    monkeypatch.setattr(index, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    got = rows(index.search_text_index(spark, folder, asked))
    assert got == rows(R.lexical_hits(docs, asked, paths=("bm25",)).drop("path", "path_order"))
    assert kept["candidates"].count() < 20  # of more than 700 documents


def test_vector_index_recall(spark):
    """Recall of the registered query against all pairs; scores are exact; no query finds itself."""
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval_plans.ann_topk(spark, SF).collect()}
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval_plans.dense_topk(spark, SF).collect()}
    assert len(got) == len(want)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got.keys() & want.keys())
    assert all(q != d for q, d in got)


def test_vector_index_chunks_and_clusters(spark):
    """A hot cell is dealt in chunks; with every cell probed the rows are those of the scan."""
    rng = random.Random(8)

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    centre = [rng.gauss(0, 1) for _ in range(8)]
    data = [(i, unit([c + rng.gauss(0, 0.2) for c in centre])) for i in range(150)] + [(200 + i, unit([rng.gauss(0, 1) for _ in range(8)])) for i in range(150)] + [(900, None), (901, [])]
    vectors, folder = spark.createDataFrame(data, "vec_id long, embedding array<double>"), shared_path(spark, "vectors")
    facts = index.build_vector_index(vectors, folder, max_sample=100)
    assert facts["n"] == 300
    assert facts["recall"] >= 0.95
    asked = vectors.filter("vec_id % 7 = 0")
    want = rows(R.dense_hits(vectors.filter("size(embedding) > 0"), asked.filter("size(embedding) > 0")))
    assert rows(index.search_vector_index(spark, folder, asked, probes=100, chunk=20)) == want


def test_automaton_search(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choices("ab ", k=40))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, "".join(rng.choices("ab ", k=rng.randrange(1, 5)))) for i in range(20)] + [(20, ""), (21, "ab"), (22, "ab"), (23, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, j) for i, p in items for j, t in docs if p is not None and t is not None and p in t)
    for max_bytes in (1, 1 << 20):
        assert sorted((r["query_id"], r["doc_id"]) for r in R.containing_pairs(d, q, max_bytes=max_bytes).collect()) == want
    hits = {}
    for i, p in items:
        words = (p or "")[:100].split()
        for j, t in docs:
            if t is not None and any(w in t for w in words[:5]):
                hits.setdefault(i, []).append((-round(sum(w in t for w in words) / len(words), 6), j))
    want = sorted((i, j, -s, n) for i, found in hits.items() for n, (s, j) in enumerate(sorted(found)[:10], 1))
    for max_bytes in (1, 1 << 20):
        assert rows(R.keyword_hits(d, q, max_bytes=max_bytes)) == want
    plans = [df._jdf.queryExecution().toString() for df in (R.keyword_hits(d, q), R.containing_pairs(d, q))]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_dense_topk_table(spark):
    assert retrieval_plans.ann_topk(spark, SF).count() == 10 * table(spark, SF, "embeddings").filter("vec_id % 20 = 0").count()


def test_text_index_shuffles_no_pairs(spark, texts, monkeypatch):
    """A task hands on its k best documents a query, also of texts that all share their words; segments bound what it holds."""
    folder, kept = shared_path(spark, "index"), {}
    docs = spark.createDataFrame([(i, "all the same words here" + " and" * (i % 7)) for i in range(400)] + [(None, "all words")], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", "the same words and here") for i in range(20)], "item_id string, text string")
    index.build_text_index(docs.coalesce(2), folder, buckets=4, segment_docs=50)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= 50 and blocks.select("segment").distinct().count() >= 8
    monkeypatch.setattr(index, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    got = rows(index.search_text_index(spark, folder, asked))
    assert kept["candidates"].count() <= 20 * 10 * blocks.select("segment").distinct().count()
    assert got == rows(R.lexical_hits(docs, asked, paths=("bm25",)).drop("path", "path_order"))


def test_best_of_segment_stops_early():
    """Documents of a weak term aren't sought, but what it adds counts; strings that sort otherwise than they came are ranked."""
    strong, weak = (2.0, 4.0, [(2.0, np.array([3, 1]), np.array([2.0, 1.9]))]), (0.1, 0.2, [(2.0, np.arange(5), np.full(5, 2.0))])
    which, scores = index.best_of_segment([weak, strong], 3.0, 5, 10)
    assert list(which) == [3, 1] and list(scores) == [4.2, 4.0]
    which, scores = index.best_of_segment([weak, strong], 0.0, 5, 4)
    assert list(which) == [3, 1, 0, 2] and list(scores) == [4.2, 4.0, 0.2, 0.2]
