"""Readers, sinks and streams on small files."""

import gzip
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.sources import readers, sinks
from lexmill.streaming import ingest


def test_text_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "a" / "b" / "y.txt").write_text("三", encoding="utf-8")
    (tmp_path / "z.pdf").write_text("no")
    got = {r["source"].rpartition("/")[2]: r["content"] for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"x.md": "one\ntwo", "y.txt": "三"}


def test_strict_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    schema = "id string, text string"
    path.write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": "b"}\n')
    assert readers.json_lines(spark, str(path), schema, ("id", "text"), "id").count() == 2
    for bad in ('{"id": "1"', "[1]", '{"id": "1", "text": " "}', "", '{"id": "1", "text": "a"}\n{"id": "1", "text": "b"}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            readers.json_lines(spark, str(path), schema, ("id", "text"), "id")


def test_docx_and_zip(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r["source"].rpartition("/")[2]: (r["content"], r["error"]) for r in readers.docx_files(spark, str(tmp_path)).collect()}
    assert got == {"x.docx": ("Hello you\na | b", None), "bad.docx": (None, "BadZipFile")}
    packed = io.BytesIO()
    with gzip.open(packed, "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("rows.jsonl.gz", packed.getvalue())
    rows = readers.zipped_json_lines(spark, str(tmp_path / "v.zip")).orderBy("record").collect()
    assert [(r["record"], json.loads(r["value"])["a"]) for r in rows] == [(1, 1), (2, 2)]


def test_archives_of_many_members(spark, tmp_path):
    """Members are read by many tasks; a broken member, a cut one, one that isn't UTF-8 and a broken file are errors in place."""
    import gzip
    import random

    packed = gzip.compress("".join(f"{random.Random(1).random()} {i}\n\n" for i in range(5000)).encode())
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(12):
            z.writestr(f"m{i:02}.gz", gzip.compress(f"a{i}\n \nb{i}\n".encode()))
        z.writestr("n-broken.gz", b"no gzip")
        z.writestr("n-cut.gz", packed[: len(packed) // 2])
        z.writestr("n-latin.gz", gzip.compress(b"fine\n\xff\n"))
        z.writestr("other.txt", b"not asked for")
    (tmp_path / "broken.zip").write_bytes(b"PK no zip")
    found = readers.zipped_json_lines(spark, str(tmp_path / "*.zip"), rows=7)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    rows = sorted(((r["source"].rsplit("/", 1)[-1], r["record"], r["value"], (r["error"] or "").split(":")[0]) for r in found.collect()), key=str)
    good = [r for r in rows if not r[3] and "!m" in r[0]]
    assert good == [(f"many.zip!m{i:02}.gz", n, f"{x}{i}", "") for i in range(12) for n, x in ((1, "a"), (2, "b"))]
    assert {(r[0], r[3]) for r in rows if r[3]} == {("broken.zip", "BadZipFile"), ("many.zip!n-broken.gz", "BadGzipFile"), ("many.zip!n-cut.gz", "EOFError"), ("many.zip!n-latin.gz", "UnicodeDecodeError")}
    assert not any("other" in r[0] for r in rows)
    cut = [r[1] for r in rows if "n-cut" in r[0]]
    assert sorted(cut) == list(range(1, len(cut) + 1))
    assert len(cut) > 100


def test_parsers(spark):
    df = spark.createDataFrame([("---\n{\"a\": 1}\n---\n## Body\nline\n",)], "c string")
    assert tuple(df.select(*readers.front_matter(F.col("c"), "## Body")).first()) == ('{"a": 1}', "line")
    qa = spark.createDataFrame([("## user\nq1\n## assistant\na1\n## user\n \n## assistant\na2",)], "c string")
    assert [tuple(r) for r in readers.qa_markdown(qa, "c").collect()] == [("q1", "a1")]
    said = spark.createDataFrame([("```json\n{\"x\": 1}\n```",), ("well {\"x\": 2} ok",), ("none",)], "t string")
    assert [r[0] for r in said.select(F.try_variant_get(readers.json_from_model(F.col("t")), "$.x", "int")).collect()] == [1, 2, None]
    pages = readers.form_feed_pages(spark.createDataFrame([(1, "a\fb\f\f ")], "d int, text string"), "d", "text")
    assert [(r["page_no"], r["text"]) for r in pages.collect()] == [(1, "a"), (2, "b")]


def test_question_sets(spark, tmp_path):
    """The limit counts items as they come, valid or not; then those without a question or an answer go."""
    import json

    items = [{"user": " q1 ", "assistant": "a1"}, {"user": "", "assistant": "a2"}, {"user": "q3"}, {"user": "q4", "assistant": None}, {"user": 5, "assistant": "a5\u3000"}, {"user": "q6", "assistant": "a6"}]
    lines, array = tmp_path / "set.jsonl", tmp_path / "set.json"
    lines.write_text("\n\n  \n".join(map(json.dumps, items)), encoding="utf-8")
    array.write_text(json.dumps(items), encoding="utf-8")
    for limit in (0, 1, 3, 5, 6, 20):
        want = [(q, a) for q, a in [("q1", "a1"), ("", "a2"), ("q3", ""), ("q4", ""), ("5", "a5"), ("q6", "a6")][:limit] if q and a]
        for path, kind in ((lines, "jsonl"), (array, "json")):
            assert [tuple(r) for r in readers.qa_pairs(spark, str(path), kind, limit).collect()] == want
    folder = tmp_path / "md" / "deep"
    folder.mkdir(parents=True)
    for name, said in {"a.md": "## User\nq1\n## assistant\na1\n## assistant\nmore", "b.md": "no pair", "c.md": "## user\n\n## assistant\na3", "d.md": "bare question ## assistant answer", "e.txt": "## user\nx\n## assistant\ny"}.items():
        (folder / name).write_text(said, encoding="utf-8")
    assert [tuple(r) for r in readers.qa_pairs(spark, str(tmp_path / "md"), "md").collect()] == [("q1", "a1"), ("bare question", "answer")]
    assert readers.qa_pairs(spark, str(tmp_path / "md"), "md", 1).count() == 1
    array.write_text("{}", encoding="utf-8")
    with pytest.raises(ValueError, match="array"):
        readers.qa_pairs(spark, str(array), "json")
    lines.write_text("{\"user\": \"q\"}\nnot JSON\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)json|malformed"):
        readers.qa_pairs(spark, str(lines), "jsonl").collect()


def test_versions_and_export(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    folder = str(tmp_path / "t")
    sinks.upsert_version(spark, folder, rows((1, "a"), (2, "b")), 1, "k")
    last = sinks.upsert_version(spark, folder, rows((2, "c")), 2, "k")
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [(1, "a"), (2, "c")]
    manifest = sinks.export(rows((1, "a"), (2, "b")), str(tmp_path / "e")).first()
    assert manifest["n_rows"] == 2
    again = sinks.export(rows((2, "b"), (1, "a")).repartition(2), str(tmp_path / "f")).first()
    assert again["digest"] == manifest["digest"]
    with pytest.raises(ValueError):
        sinks.guard("prod_x", False)
    with pytest.raises(ValueError):
        sinks.guard("mine", True)


def test_replace_pages(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = lambda *x: spark.createDataFrame(list(x), "review_id int, page_no int")
    sinks.replace_pages(rows((1, 1), (1, 2), (2, 1)), folder, "review_id")
    sinks.replace_pages(rows((1, 9)), folder, "review_id")
    assert sorted((r["review_id"], r["page_no"]) for r in spark.read.parquet(folder).collect()) == [(1, 9), (2, 1)]


def test_ingest_stream_resumes(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a" * 3000), (2, "b")], "doc_id long, text string").write.parquet(docs)
    first = ingest.ingest_stream(spark, docs, out).count()
    spark.createDataFrame([(3, "c")], "doc_id long, text string").write.mode("append").parquet(docs)
    points = ingest.ingest_stream(spark, docs, out)
    assert points.count() == first + 1
    assert points.select("point_id").distinct().count() == points.count()
    assert str(uuid.uuid5(uuid.NAMESPACE_DNS, "2#0")) in {r[0] for r in points.select("point_id").collect()}


def test_debounce_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    batch = ingest.debounce(events, "user_id", "ts", "30 minutes")
    folder = str(tmp_path / "e")
    events.repartition(1).write.parquet(folder)
    stream = ingest.stream_of(spark, folder).withWatermark("ts", "1 day")
    query = ingest.debounce(stream, "user_id", "ts", "30 minutes").writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM bursts").collect())) == sorted(map(tuple, batch.collect()))
