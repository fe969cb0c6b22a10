"""Streams: fingerprint dedup of arriving files, debounce, retention, chunked upserts."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.chunks import preferred_chunks
from lexmill.sources import deltas
from lexmill.sources.sinks import points
from lexmill.storage import exists, materialize, shared_path

NAMESPACE = uuid.NAMESPACE_DNS


def stream_of(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream; a single file is only taken as a pattern, so its last letter is a class of one."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, output: str = "append") -> DataFrame:
    """Run a stream over what is there, into a folder of its own in shared storage, and read that."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    stream.writeStream.outputMode(output).format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def fingerprint_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a distinct text, by digest; the state keeps digests only."""
    return docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars")).dropDuplicates(["sha256"])


def debounce(events: DataFrame, by: str, ts: str, quiet: str) -> DataFrame:
    """by, first_ts, last_ts, n of each burst: events less than quiet apart; works on streams (with a watermark) and on tables."""
    bursts = events.groupBy(by, F.session_window(ts, quiet).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return bursts.drop("w")


class Changed(ValueError):
    """The input or its settings aren't those that a folder was begun with."""


def claim(spark: SparkSession, out: str, **settings) -> str:
    """The signature of a run: refuse a folder that was begun with another one."""
    said = json.dumps(settings, sort_keys=True)
    at = f"{out}/signature"
    if not exists(spark, at):
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    before = spark.read.text(at).first()["value"]
    if before != said:
        raise Changed(f"{out} was begun with {before}, not {said}")
    return said


def ingest_stream(spark: SparkSession, path: str, out: str, size: int = 1200, overlap: int = 120, files: int = 1000) -> DataFrame:
    """Chunk arriving documents into points, and return the table of points as it is then.

    Points are kept by document: a document that arrives again replaces all of its points, and of a document that arrives
    twice in a micro-batch one row counts (the largest text hash). A document without text goes to `out`/errors and leaves
    earlier points as they are. Each micro-batch is one commit that is tagged with its number, so one that is repeated after
    a stop between write and commit of the checkpoint changes nothing. A folder goes on only with the settings that it was
    begun with.
    """
    claim(spark, out, source=path, size=size, overlap=overlap, namespace=str(NAMESPACE))
    at = f"{out}/points"
    if deltas.last_version(spark, at) < 0:
        empty = spark.createDataFrame([], "doc_id long, text string")
        deltas.create(points(preferred_chunks(empty, "text", size, overlap), NAMESPACE), at, "doc_id")

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("doc_id").agg(F.max(F.struct(F.sha2("text", 256).alias("sha256"), "text")).alias("d")).select("doc_id", "d.text")
        held = materialize(last, "arrived")
        blank = F.coalesce(F.trim("text"), F.lit("")) == ""
        errors = held.filter(blank | F.col("doc_id").isNull()).select("doc_id", F.lit("chunker").alias("step"), F.lit("no text or no id").alias("message"))
        errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        good = held.filter(~blank & F.col("doc_id").isNotNull())
        deltas.upsert(at, points(preferred_chunks(good, "text", size, overlap), NAMESPACE), tag=f"batch {number}")

    stream_of(spark, path, files).select("doc_id", "text").writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return deltas.read(spark, at)


def retention_sweep(rows: DataFrame, now: str, expires_at: str, created_at: str, days: int = 7) -> DataFrame:
    """Rows that a sweep at `now` finds expired; a missing expiry is days after creation."""
    from lexmill.operators.store import expires

    return rows.filter(expires(F.col(expires_at), F.col(created_at), days) <= F.to_timestamp_ntz(F.lit(now)))
