"""Publication of a prepared corpus: gates, stops between write and checkpoint, exact counts, activation and its way back."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.ids import text_sha256
from lexmill.sources import deltas
from lexmill.streaming import publish
from lexmill.streaming.ingest import Changed

TEXTS = {1: "first article of law", 2: "second", 3: "the third one is longer than the others", 4: "four"}


def corpus(spark, folder, size=8, **faults):
    """Paths of articles and their chunks, a file an article; faults: expressions that replace a chunk's columns."""
    articles = spark.createDataFrame([(i, t, -(-len(t) // size)) for i, t in TEXTS.items()], "article_id long, text string, chunk_count int").withColumn("sha256", text_sha256(F.col("text")))
    cuts = [(i, k // size, k, min(k + size, len(t)), t[k : k + size], f"{i}#{k // size}", -(-len(t) // size)) for i, t in TEXTS.items() for k in range(0, len(t), size)]
    chunks = spark.createDataFrame(cuts, "article_id long, chunk_index int, start long, end long, excerpt string, point_id string, chunk_count int")
    chunks = chunks.join(articles.select("article_id", F.col("sha256").alias("article_sha256")), "article_id").withColumns({"excerpt_sha256": text_sha256(F.col("excerpt")), "chunk_text": F.concat(F.lit("law: "), "excerpt"), "vector": F.lit("a column of that name")})
    chunks = chunks.withColumns({name: F.expr(e) for name, e in faults.items()})
    articles.write.mode("overwrite").parquet(f"{folder}/articles")
    for i in TEXTS:
        chunks.filter(F.col("article_id") == i).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
    return f"{folder}/articles", f"{folder}/chunks"


def embed(chunks):
    return chunks.withColumn("vector", F.array(F.length("chunk_text").cast("double"), F.lit(1.0)))


def run(spark, paths, out, vectors=embed, **more):
    return publish.publish(spark, *paths, str(out), "laws", more.pop("target", "laws"), vectors, 2, files=more.pop("files", 1), **more)


def test_every_chunk_is_a_point_once(spark, tmp_path):
    paths = corpus(spark, str(tmp_path / "in"))
    found = run(spark, paths, tmp_path / "out").collect()
    wanted = {(f"{i}#{k}", i, k, f"law: {t[8 * k:8 * k + 8]}") for i, t in TEXTS.items() for k in range(-(-len(t) // 8))}
    assert {(r["point_id"], r["article_id"], r["chunk_index"], r["chunk_text"]) for r in found} == wanted and len(found) == len(wanted)
    assert all(r["vector"] == [float(len(r["chunk_text"])), 1.0] for r in found)
    state = publish.state_of(spark, str(tmp_path / "out"))
    assert (state["status"], state["n_points"]) == ("complete", len(wanted))
    with pytest.raises(publish.Refused, match="complete"):
        run(spark, paths, tmp_path / "out")
    assert run(spark, paths, tmp_path / "out", resume=True).count() == len(wanted)


@pytest.mark.parametrize(
    ("faults", "errors"),
    [
        ({"chunk_index": "CASE WHEN article_id = 3 THEN chunk_index * 2 ELSE chunk_index END"}, {"article not_contiguous": 1}),
        ({"excerpt_sha256": "CASE WHEN point_id = '1#0' THEN 'x' ELSE excerpt_sha256 END"}, {"chunk hash_differs": 1}),
        ({"point_id": "CASE WHEN article_id = 2 THEN '1#0' ELSE point_id END"}, {"chunk repeated_point": 2}),
        ({"chunk_text": "CASE WHEN article_id = 4 THEN NULL ELSE chunk_text END"}, {"chunk blank_text": 1}),
        ({"article_sha256": "CASE WHEN article_id = 4 THEN NULL ELSE article_sha256 END"}, {"chunk other_article": 1}),
    ],
)
def test_faulty_corpus_is_refused_before_writing(spark, tmp_path, faults, errors):
    paths = corpus(spark, str(tmp_path / "in"), **faults)
    with pytest.raises(publish.Refused) as refused:
        run(spark, paths, tmp_path / "out")
    assert refused.value.found == errors
    assert not (tmp_path / "out").exists()


def test_gates(spark, tmp_path):
    paths = corpus(spark, str(tmp_path / "in"))
    with pytest.raises(publish.Refused, match="protected"):
        publish.publish(spark, *paths, str(tmp_path / "out"), "rag_chunks_2", "rag_chunks_2", embed, 2)
    with pytest.raises(publish.Refused, match="for other"):
        run(spark, paths, tmp_path / "out", target="other")
    with pytest.raises(publish.Refused, match="PENDING"):
        run(spark, paths, tmp_path / "out", status="PENDING")
    with pytest.raises(publish.Refused, match="no run"):
        run(spark, paths, tmp_path / "out", resume=True)
    assert not (tmp_path / "out").exists()
    assert run(spark, paths, tmp_path / "out", status="PENDING", allow_pending=True, files=100).count() == 10


def test_resumes_after_a_stop(spark, tmp_path):
    """The second batch's embedding fails; then a run is stopped after a commit but before the stream's checkpoint."""
    paths, out, calls = corpus(spark, str(tmp_path / "in")), tmp_path / "out", []

    def failing(chunks):
        calls.append(1)
        return chunks.withColumn("vector", F.lit(None).cast("array<double>")) if len(calls) == 2 else embed(chunks)

    with pytest.raises(Exception, match="batch 1"):
        run(spark, paths, out, failing)
    assert publish.state_of(spark, str(out))["status"] == "in_progress"
    held = deltas.read(spark, f"{out}/points").count()
    assert 0 < held < 10
    (commit,) = [x for x in (out / "checkpoint" / "commits").iterdir() if x.name == "0"]
    commit.unlink()  # as if the job had died between the table's commit and the stream's
    (out / "checkpoint" / "commits" / f".{commit.name}.crc").unlink(missing_ok=True)
    with pytest.raises(publish.Refused, match="in_progress"):
        run(spark, paths, out)
    found = run(spark, paths, out, resume=True)
    assert found.count() == found.select("point_id").distinct().count() == 10
    assert publish.state_of(spark, str(out))["status"] == "complete"


def test_another_corpus_is_refused(spark, tmp_path):
    paths = corpus(spark, str(tmp_path / "in"))
    run(spark, paths, tmp_path / "out", files=100)
    other = corpus(spark, str(tmp_path / "other"), size=9)
    with pytest.raises(Changed):
        run(spark, other, tmp_path / "out", resume=True)


def test_lost_and_foreign_points_are_found(spark, tmp_path):
    paths, out = corpus(spark, str(tmp_path / "in")), tmp_path / "out"
    points = run(spark, paths, out, files=100)
    deltas.delete(f"{out}/points", points.filter("point_id = '1#0'"))
    with pytest.raises(publish.Refused) as refused:
        run(spark, paths, out, resume=True)
    assert refused.value.found == {"n": 9, "missing": 1, "unexpected": 0, "doubled": 0}
    deltas.upsert(f"{out}/points", points.limit(1).withColumn("point_id", F.lit("x")))
    with pytest.raises(publish.Refused) as refused:
        run(spark, paths, out, resume=True)
    assert (refused.value.found["missing"], refused.value.found["unexpected"]) == (1, 1)


def test_doubled_vectors_are_refused(spark, tmp_path):
    paths = corpus(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="batch 0"):
        run(spark, paths, tmp_path / "out", lambda c: embed(c).unionByName(embed(c)), files=100)
    assert deltas.read(spark, f"{tmp_path}/out/points").count() == 0


def test_points_are_written_once(spark, tmp_path, monkeypatch):
    """Points are checked where they are committed; no second copy of them is made, and a refused batch's is deleted."""
    paths, out, written = corpus(spark, str(tmp_path / "in")), tmp_path / "out", []
    monkeypatch.setattr(publish, "materialize", lambda df, name: written.append(name) or df)
    with pytest.raises(Exception, match="batch 0"):
        run(spark, paths, out, lambda c: embed(c).unionByName(embed(c)), files=100)
    assert len(list((out / "points" / "data").iterdir())) == 1  # the empty base
    assert run(spark, paths, out, files=100, resume=True).count() == 10
    assert not written


def test_activation_goes_back_on_faults(spark, tmp_path):
    paths, out = corpus(spark, str(tmp_path / "in")), str(tmp_path / "out")
    articles = spark.read.parquet(paths[0])
    with pytest.raises(publish.Refused, match="no complete run"):
        publish.activate(spark, out, articles, "ops", "2025-01-01", lambda p: {})
    run(spark, paths, out, files=100)
    assert publish.active_points(spark, out).count() == 0
    few = articles.filter("article_id < 3")
    version = publish.activate(spark, out, few, "ops", "2025-01-01", lambda p: {"none": int(p.count() == 0)})
    seen = {(r["article_id"], r["activated_by"], r["activated_at"]) for r in publish.active_points(spark, out).collect()}
    assert seen == {(1, "ops", "2025-01-01"), (2, "ops", "2025-01-01")}
    with pytest.raises(publish.Refused, match="rolled back") as refused:
        publish.activate(spark, out, articles, "eve", "2025-01-02", lambda p: {"article 3": p.filter("article_id = 3").count(), "none": 0})
    assert refused.value.found == {"article 3": 5}

    def broken(points):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        publish.activate(spark, out, articles, "eve", "2025-01-02", broken)
    assert {(r["article_id"], r["activated_by"], r["activated_at"]) for r in publish.active_points(spark, out).collect()} == seen
    assert deltas.manifest(spark, f"{out}/activation").parts == deltas.manifest(spark, f"{out}/activation", version).parts
    with pytest.raises(publish.Refused, match="no points"):
        publish.activate(spark, out, spark.createDataFrame([(99,), (None,)], "article_id long"), "ops", "2025-01-03", lambda p: {})


def test_empty_corpus(spark, tmp_path):
    paths = corpus(spark, str(tmp_path / "in"))
    for name, path in zip(("articles", "chunks"), paths):
        spark.read.parquet(path).limit(0).coalesce(1).write.parquet(str(tmp_path / "none" / name))
    assert run(spark, (str(tmp_path / "none" / "articles"), str(tmp_path / "none" / "chunks")), tmp_path / "out").count() == 0
    assert publish.state_of(spark, str(tmp_path / "out"))["n_points"] == 0
