"""Exact deduplication as a stateful stream.

Two streams run one after the other, each until what is there has been read. The first reads the document files and writes
a ledger: id, SHA-256 of the text without white space, code points, and the content's locator (file and row in it). The
second reads the ledger into Spark's keyed state: by digest, without expiry, on disk in RocksDB, it retains the stable
identifier (the first copy's locator), the copy that stays with its id and locator, and the number of copies. Each of its
micro-batches hands on the entries that it changed; hits, rows of a digest that has more than one copy, fetch their texts
by locator and are compared byte by byte with the first copy, which never changes. Only files that hold a hit or its first
copy are read for that, and only copies that are new since the micro-batch before are compared. Digests with differing
bytes are noted and their rows are grouped again by their bytes in the end. A repeated micro-batch replaces its own parts,
and both streams resume from their checkpoints; the state is not read as a whole but by the entries handed on.

The text is hashed once. Entries are combined by digest before the shuffle, so a hot digest is one row a task; in the
joins AQE splits it. A micro-batch reads at most `max_bytes` of document files, or of ledger. The state has as many stores
as the first call finds splits of `store_bytes` in the files, `max_stores` at most, as each has a fixed cost; that number
belongs to the folder. Stores don't reserve disk ahead (allowFAllocate), which would be some MB each whatever it holds.

Edge cases: null and empty texts are equal; a null id loses to any other; rows of the same id and length are told apart
by locator, so one row of each group stays; extra columns aren't read; an empty table gives an empty result.
"""

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.text import BLANK_CLASS, whole_text
from lexmill.storage import join_sized, materialize, shared_path

def best() -> Column:
    """Its largest is the copy that stays: most code points, smallest id (a null is the worst), last locator.
    The bitwise not of an integer reverses its order without overflow."""
    return F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("not_id"), F.col("file"), F.col("row"))


def normal(text: Column | str) -> Column:
    return F.regexp_replace(whole_text(text), BLANK_CLASS + "+", "")


def documents_read(spark: SparkSession, path: str, streaming: bool, options: dict) -> DataFrame:
    """doc_id, text, file, row of the documents under path."""
    plain = spark.read.parquet(path)
    reader = spark.readStream.options(**options) if streaming else spark.read
    # a stream takes a single file only as a pattern, so the last letter is written as a class of one
    df = reader.schema(plain.select("doc_id", "text").schema).parquet(f"{path[:-1]}[{path[-1]}]" if streaming else path)
    return df.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


LEDGER = "doc_id long, digest binary, n_chars long, file string, row long, part long"


def locator(file: str = "file", row: str = "row") -> Column:
    """A number for a place in a file; 64 bits suffice to join a place with itself beside the row's number."""
    return F.xxhash64(file, row)


def write_ledger(spark: SparkSession, path: str, folder: str, max_bytes: int) -> None:
    """Append the ledger rows of all files under path that the folder doesn't have yet, a part a micro-batch."""
    docs = documents_read(spark, path, True, {"maxBytesPerTrigger": str(max_bytes)})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normal("text"), 256)).alias("digest"), F.length(whole_text("text")).cast("long").alias("n_chars"), "file", "row")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/ledger/part={number}")

    rows.writeStream.option("checkpointLocation", f"{folder}/ledger-checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stores_for(spark: SparkSession, path: str, store_bytes: int, max_stores: int) -> int:
    """How many state stores: splits of store_bytes in the files, from 4 up."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    return max(4, min(max_stores, -(-size // store_bytes)))


SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def run_state(spark: SparkSession, path: str, folder: str, max_bytes: int, stores: int) -> None:
    """Take the ledger's new rows into the state; write the entries that changed and the digests whose bytes clash."""
    session = spark.newSession()  # with settings of its own, which other queries don't see
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(stores), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        session.conf.set(k, v)
    rows = session.readStream.schema(LEDGER).option("maxBytesPerTrigger", str(max_bytes)).parquet(f"{folder}/ledger")
    first = F.min_by(F.struct("file", "row"), F.struct(F.col("_seen"), F.col("file"), F.col("row")))
    keyed = rows.withColumn("_seen", F.expr("_metadata.file_modification_time"))
    state = keyed.groupBy("digest").agg(first.alias("first"), F.max(best()).alias("best"), F.count("*").alias("copies"), F.max("part").alias("last"))

    def changed(batch: DataFrame, number: int) -> None:
        entries, reached = f"{folder}/state/batch={number}", f"{folder}/reached/batch="
        batch.write.mode("overwrite").parquet(entries)
        now = spark.read.schema(batch.schema).parquet(entries)
        now.agg(F.coalesce(F.max("last"), F.lit(-1)).alias("part")).write.mode("overwrite").parquet(f"{reached}{number}")
        since = spark.read.parquet(f"{reached}{number - 1}").first()["part"] if number else -1
        clashes(spark, path, folder, now, since).write.mode("overwrite").parquet(f"{folder}/clashes/batch={number}")

    state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(changed).start().awaitTermination()


def dedup_stream(spark: SparkSession, path: str, folder: str | None = None, max_bytes: int = 64 << 30, store_bytes: int = 256 << 20, max_stores: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row of every document under path.

    folder: in shared storage; a later call with the same one only processes files that are new since.
    """
    folder = folder or shared_path(spark, "dedup")
    write_ledger(spark, path, folder, max_bytes)
    run_state(spark, path, folder, max_bytes, stores_for(spark, path, store_bytes, max_stores))
    rows = spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    entries = spark.read.schema(f"{STATE}, batch long").parquet(f"{folder}/state")
    last = entries.groupBy("digest").agg(F.max_by(F.struct("best", F.col("copies").alias("group_size")), "batch").alias("e")).select("digest", "e.*")
    state = materialize(last, "state")  # both sides of the join are plain shuffles then, of which AQE splits a hot digest's rows
    joined = rows.join(state, "digest")
    clashing = spark.read.schema("digest binary, batch long").parquet(f"{folder}/clashes").select("digest").distinct()
    if not clashing.take(1):
        return _result(joined)
    texts = documents_read(spark, path, False, {}).select("file", "row", normal("text").alias("bytes"))
    again = rows.join(clashing, "digest", "left_semi").join(texts, ["file", "row"])
    same = again.groupBy("digest", "bytes").agg(F.max(best()).alias("best"), F.count("*").alias("group_size"))  # combined before the shuffle
    again = again.join(materialize(same, "again"), ["digest", "bytes"])
    return _result(joined.join(clashing, "digest", "left_anti").unionByName(again.select(*joined.columns)))


STATE = "digest binary, first struct<file:string,row:long>, best struct<n_chars:long,not_id:long,file:string,row:long>, copies long, last long"


def texts_in(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Documents of some of the files under path, named as their locators name them."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in files]
    return spark.read.schema(schema).parquet(*plain).select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def clashes(spark: SparkSession, path: str, folder: str, entries: DataFrame, since: int) -> DataFrame:
    """Digests among the changed entries of which a new copy's bytes differ from the first one's. New: of the ledger's parts
    from `since` on, which the micro-batch before reached. Only files that hold a new copy or the first one of such a digest
    are read, and of them only those rows go on."""
    groups = entries.filter(F.col("copies") > 1).select("digest", "first")
    rows = spark.read.schema(LEDGER).parquet(f"{folder}/ledger").filter(F.col("part") >= since).join(groups, "digest")
    rows = materialize(rows.select("digest", "file", "row", "first"), "new-copies")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    copies = rows.filter(~is_first).select("digest", locator().alias("place"), "row", F.lit(False).alias("is_first"))
    firsts = rows.filter(~is_first).groupBy("digest").agg(F.min("first").alias("first"))
    firsts = firsts.select("digest", locator("first.file", "first.row").alias("place"), F.col("first.row").alias("row"), F.lit(True).alias("is_first"))
    # names of files, which the driver lists in any case
    files = [r[0] for r in rows.filter(~is_first).select(F.explode(F.array("file", "first.file"))).distinct().collect()]
    if not files:
        return spark.createDataFrame([], "digest binary")
    # texts stay where they are while the places are measured to be few; beyond that those of files with hits are shuffled
    places = materialize(copies.unionByName(firsts).withColumnRenamed("row", "at"), "places")
    met = join_sized(texts_in(spark, path, files).select(locator().alias("place"), "row", "text"), places, "place", "inner").filter(F.col("row") == F.col("at"))
    texts = met.select("digest", "is_first", normal("text").alias("bytes"))
    known = texts.filter("is_first").select("digest", F.col("bytes").alias("first_bytes"))
    hits = texts.filter("not is_first").join(known, "digest")
    # distinct only after the write: an aggregate by digest right behind the join would keep AQE from splitting a hot one
    return hits.filter(F.col("bytes") != F.col("first_bytes")).select("digest")


def _is_best() -> Column:
    return (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))


def _result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.bitwise_not("best.not_id").alias("keep_id"), "group_size", _is_best().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "file", "row")
