"""Stateful streams, tables with versions and resumable ingest: restarts, repetition, disorder and rival writers."""

import itertools

import pytest
from pyspark.sql import functions as F

from lexmill.functions.chunks import preferred_chunks
from lexmill.sources import deltas
from lexmill.sources.sinks import points
from lexmill.streaming import ingest, stateful


def put(spark, folder, *events):
    rows = [(o, i, k, at, until) for o, i, k, at, until in events]
    df = spark.createDataFrame(rows, "owner string, id string, kind string, at string, expires_at string")
    df.withColumns({c: F.to_timestamp(c) for c in ("at", "expires_at")}).coalesce(1).write.mode("append").parquet(folder)


def test_failed_removals_are_tried_again(spark, tmp_path):
    """A row is due at each sweep until it is removed; a new expiry counts; a row that is gone in time is never due."""
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    day = "2024-01-{:02d} 00:00:00".format
    put(spark, events, ("u", "a", "put", day(1), day(5)), ("u", "b", "put", day(1), day(5)), ("u", "c", "put", day(1), day(5)), ("v", "d", "put", day(1), day(5)), ("v", "e", "put", day(1), None), ("clock", "clock", "clock", day(4), None))
    purge = lambda due: due.withColumn("removed", F.col("id") != "a")
    assert stateful.sweep(spark, events, out, purge).count() == 0
    put(spark, events, ("u", "b", "put", day(5), day(20)), ("v", "d", "gone", day(4), None), ("clock", "clock", "clock", day(10), None))
    assert {(r["id"], r["attempt"], r["removed"]) for r in stateful.sweep(spark, events, out, purge).collect()} == {("a", 1, False), ("c", 1, True)}
    put(spark, events, ("clock", "clock", "clock", day(12), None))
    assert {(r["id"], r["attempt"]) for r in stateful.sweep(spark, events, out, purge).collect()} == {("a", 1), ("c", 1), ("a", 2)}
    put(spark, events, ("clock", "clock", "clock", day(25), None))
    fine = lambda due: due.withColumn("removed", F.lit(True))
    assert {(r["id"], r["attempt"], r["removed"]) for r in stateful.sweep(spark, events, out, fine).collect()} == {("a", 1, False), ("c", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)}
    put(spark, events, ("clock", "clock", "clock", day(28), None))
    assert stateful.sweep(spark, events, out, fine).count() == 5


def test_owners_share_state_keys(spark, tmp_path):
    """Some tens of owners are one key of the state; no owner's rows touch another's, also of equal ids, odd names or none."""
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    owners = [*[f"o{i}" for i in range(400)], 'a","b', "a\n", None]
    day = "2024-01-{:02d} 00:00:00".format
    put(spark, events, *[(o, "x", "put", day(1), day(5 if n % 2 else 20)) for n, o in enumerate(owners)], ("clock", "clock", "clock", day(10), None))
    purge = lambda due: due.withColumn("removed", F.lit(True))
    due = stateful.sweep(spark, events, out, purge, stores=1).collect()
    assert {r["owner"] for r in due} == set(owners[1::2])
    assert len(due) == len(owners[1::2])
    assert spark.read.parquet(f"{out}/buckets").first()["n"] < len(owners) / 32


def test_message_files_are_not_one_task(spark, tmp_path, monkeypatch):
    """Each arrival of messages is written by as many tasks as read it, and merged before the next."""
    from lexmill.plans import stream_plans

    talk = [(c, t, "user", f"said {c} {t}") for c in range(50) for t in range(6)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found, merge = [], stateful.merge_threads

    def seen(session, messages, out, *args, **kwargs):
        found.append(len(session.read.schema(stateful.MESSAGE).parquet(messages).inputFiles()))
        return merge(session, messages, out, *args, **kwargs)

    monkeypatch.setattr(stream_plans.stateful, "merge_threads", seen)
    assert stream_plans.message_threads(spark, str(tmp_path)).count() == 50
    assert len(found) == 3
    assert min(b - a for a, b in itertools.pairwise([0, *found])) > 1


def test_threads_in_any_order(spark, tmp_path):
    """Messages, edits and removals in any order, repeated, over restarts: one result."""
    rows = [("t", "1", 1, 1, "user", "hi", False), ("t", "2", 2, 1, "assistant", "draft", False), ("t", "2", 9, 2, "assistant", "final", False), ("t", "3", 3, 1, "user", None, False), ("t", "3", 3, 2, "user", None, True), ("s", "1", 1, 1, None, "other", False)]
    results = set()
    for n, order in enumerate(list(itertools.permutations(rows))[::239]):
        folder, out = str(tmp_path / f"m{n}"), str(tmp_path / f"o{n}")
        for part in (order[:2], order[2:], order[1:4]):
            spark.createDataFrame(list(part), stateful.MESSAGE).coalesce(1).write.mode("append").parquet(folder)
            now = stateful.merge_threads(spark, folder, out)
        results.add(frozenset(tuple(r) for r in now.collect()))
    assert results == {frozenset({("t", "1", 1, 1, "user", "hi", False), ("t", "2", 2, 2, "assistant", "final", False), ("t", "3", 3, 2, "user", None, True), ("s", "1", 1, 1, None, "other", False)})}


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rival_writers(spark, tmp_path):
    folder = str(tmp_path / "t")
    base = deltas.create(kv(spark, (1, "a"), (1, "b"), (2, "c")), folder, "k")
    assert deltas.upsert(folder, kv(spark, (1, "x")), base) == 1
    with pytest.raises(deltas.Conflict):
        deltas.upsert(folder, kv(spark, (2, "y")), base)
    late = deltas.manifest(spark, folder, 0)._replace(version=1, note="late")
    with pytest.raises(deltas.Conflict):  # past the first check, at the rename
        deltas._commit(spark, folder, late)
    assert rows(deltas.read(spark, folder)) == [(1, "x"), (2, "c")]
    assert rows(deltas.read(spark, folder, 0)) == [(1, "a"), (1, "b"), (2, "c")]


def test_versions(spark, tmp_path):
    """Against a dictionary: upserts, deletes, replacement, rollback, compaction and vacuum."""
    folder = str(tmp_path / "t")
    deltas.create(kv(spark, (1, "a"), (2, "b"), (3, "c")), folder, "k")
    deltas.delete(folder, kv(spark, (3, None)))
    deltas.upsert(folder, kv(spark, (3, "d"), (4, "e"), (4, "f")))
    deltas.replace(folder, kv(spark, (2, "g")), kv(spark, (2, None), (4, None)))
    want = [(1, "a"), (2, "g"), (3, "d")]
    assert rows(deltas.read(spark, folder)) == want
    assert deltas.rollback(spark, folder, 2) == 4
    assert rows(deltas.read(spark, folder)) == [(1, "a"), (2, "b"), (3, "d"), (4, "e"), (4, "f")]
    deltas.rollback(spark, folder, 3)
    deltas.compact(spark, folder)
    assert rows(deltas.read(spark, folder)) == want
    assert [n for _, n, _ in deltas.history(spark, folder)] == ["create", "delete", "upsert", "replace", "rollback to 2", "rollback to 3", "compact"]
    assert deltas.vacuum(spark, folder) > 0
    assert rows(deltas.read(spark, folder)) == want
    with pytest.raises(ValueError, match="no version"):
        deltas.read(spark, str(tmp_path / "none"))


def test_bytes_follow_the_change(spark, tmp_path):
    folder = str(tmp_path / "t")
    deltas.create(spark.range(200_000).selectExpr("id as k", "sha2(string(id), 256) as v"), folder, "k")
    deltas.upsert(folder, kv(spark, (5, "x")), tag="batch 0")
    deltas.upsert(folder, kv(spark, (5, "y")), tag="batch 0")
    base, *change = deltas.manifest(spark, folder).parts
    assert sum(p[2] for p in change) < base[2] / 1000
    assert rows(deltas.read(spark, folder).filter("k = 5")) == [(5, "x")]
    assert len(deltas.history(spark, folder)) == 2


def batch_points(docs):
    return rows(points(preferred_chunks(docs, "text", 1200, 120), ingest.NAMESPACE).select("point_id", "doc_id", "chunk_text"))


def test_ingest_replaces_documents(spark, tmp_path):
    """A document that arrives again leaves none of its earlier points; blank ones are errors; settings may not change."""
    docs, out = str(tmp_path / "d.parquet"), str(tmp_path / "out")
    said = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
    long = "一句话。" * 900
    said((1, long), (2, "short"), (3, " "), (None, "nobody"))
    ingest.ingest_stream(spark, docs, out)
    said((1, "now short"), (4, long), (3, None))
    found = ingest.ingest_stream(spark, docs, out).select("point_id", "doc_id", "chunk_text")
    assert rows(found) == batch_points(spark.createDataFrame([(1, "now short"), (2, "short"), (4, long)], "doc_id long, text string"))
    errors = spark.read.parquet(f"{out}/errors")
    assert sorted((r["doc_id"], r["batch"]) for r in errors.filter("doc_id is not null").collect()) == [(3, 0), (3, 1)]
    with pytest.raises(ingest.Changed):
        ingest.ingest_stream(spark, docs, out, size=500)


def test_ingest_stopped_before_its_checkpoint(spark, tmp_path, monkeypatch):
    """A micro-batch that committed its points but not its checkpoint is repeated without lost or double points."""
    docs, out = str(tmp_path / "d.parquet"), str(tmp_path / "out")
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1).write.parquet(docs)
    upsert = deltas.upsert

    def stopped(*args, **named):
        upsert(*args, **named)
        raise RuntimeError("stopped")

    monkeypatch.setattr(deltas, "upsert", stopped)
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest_stream(spark, docs, out)
    monkeypatch.setattr(deltas, "upsert", upsert)
    found = ingest.ingest_stream(spark, docs, out).select("point_id", "doc_id", "chunk_text")
    assert rows(found) == batch_points(spark.read.parquet(docs))
    assert deltas.last_version(spark, f"{out}/points") == 1


def test_appended_rows(spark, tmp_path):
    """Appended rows stay beside those of their key until a later change names it; null keys, tags, rollback, compaction."""
    folder, rows = str(tmp_path / "t"), lambda *x: spark.createDataFrame(list(x), "k long, v string")
    read = lambda version=None: sorted(map(tuple, deltas.read(spark, folder, version).collect()), key=str)
    deltas.create(rows((1, "a"), (2, "b")), folder, "k")
    assert deltas.append(folder, rows((1, "c"), (3, "d"), (None, "n")), 0, "one") == 1
    assert deltas.append(folder, rows((9, "again")), tag="one") == 1
    with pytest.raises(deltas.Conflict):
        deltas.append(folder, rows((9, "late")), 0)
    first = sorted([(1, "a"), (2, "b"), (1, "c"), (3, "d"), (None, "n")], key=str)
    assert read() == first
    assert "Join" not in deltas.read(spark, folder)._jdf.queryExecution().toString()
    deltas.upsert(folder, rows((1, "e")))
    assert read() == sorted([(2, "b"), (3, "d"), (None, "n"), (1, "e")], key=str)
    deltas.append(folder, rows((1, "f"), (4, "g")))
    deltas.delete(folder, rows((4, ""), (2, "")))
    last = sorted([(3, "d"), (None, "n"), (1, "e"), (1, "f")], key=str)
    assert read() == last and read(1) == first
    deltas.compact(spark, folder)
    assert read() == last
    deltas.rollback(spark, folder, 1)
    assert read() == first
