"""Audit of how document filters interact, as a stream that retracts.

Every file is processed in micro-batches until what is there has been read (available now). A document's text gives a mask
of the filters that it fails by itself; whether it also repeats the text of a smaller id depends on all other documents and
on the order in which they come. So Spark's keyed state holds, for each text (by 128 bits of SHA-256), the smallest id so
far and what the rows with it added to the counters of their part. When a smaller id arrives, what the earlier rows added
is retracted from the counters of their mask and added to those of the mask with the repetition. A micro-batch writes the
sums of its changes by part and mask; a repeated one replaces its own; the sums of all are the counters. From a part's 32
counters come the results of all orders of the filters, without reading a document again.

Texts become digests and masks in the scan's tasks. Tasks combine before the shuffle: of the rows of a text in an Arrow
batch only those with the smallest id go on to the state, all others surely repeat and are counted by part and mask at
once. So a text that makes up a third of all rows is a row a batch. A call of Python a key costs a millisecond or two,
so a state key holds the texts of a bucket of digests, some tens of them; the number of buckets comes from the bytes that
a folder's first call finds (`bucket_bytes`) and belongs to the folder, like the number of stores. State is some tens of
bytes a distinct text, in RocksDB, without expiry. `folder` keeps state, changes and checkpoint: a later call with the
same one only reads files that are new.

Labels are joined to the narrow rows of each micro-batch; Spark broadcasts them only if they are small. A micro-batch takes at least a
`batches`th of the input and at most `max_bytes`.

Edge cases: a null or empty text has no words, fails A (and no other of A to D) and is equal to other such texts; a null id
is larger than all others; rows with one id and one text don't repeat each other; several labels of an id count as one
that is set where any is; a null part is the empty string; extra columns aren't read; an empty table gives an empty result.
"""

import hashlib
import itertools
import json
import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.llm.text import one_by_one
from lexmill.storage import exists, materialize, shared_path

NO_ID = 2**63 - 1
FILTERS = "ABCDE"
REPEATS = 16
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
FACTS = "bucket int, text string, part string, mask int, did long, n long, good long, toxic long"
CHANGES = "part string, mask int, n long, good long, toxic long"
STATE = "texts string"


def mask_of(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()
    short = len(words) < 200
    few = 100 * len(set(words)) < 50 * len(words)
    shouts = 100 * (len(data) - len(data.translate(None, UPPER))) > 2 * len(text)
    marks = len(data.translate(None, SYMBOLS)) < len(data)
    return short + 2 * few + 4 * shouts + 8 * marks


def judged(texts: pa.Array) -> pa.Array:
    """key, 128 bits of SHA-256, and mask of each text."""
    rows = [(hashlib.sha256(x.encode()).digest()[:16], mask_of(x)) for x in one_by_one(texts)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32()))], ["key", "mask"])


def combined(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each batch of key, mask, part, did, good, toxic: rows that may be a text's first, by text and its bucket, and sums of
    those that surely repeat, by part and mask (no text, a bucket below zero)."""
    for batch in batches:
        rows = list(zip(*(batch[c].to_pylist() for c in ("key", "mask", "part", "did", "good", "toxic")), strict=True))
        least: dict[bytes, int] = {}
        for key, _, _, did, _, _ in rows:
            least[key] = min(did, least.get(key, did))
        sums: dict[tuple, list[int]] = {}
        for key, mask, part, did, good, toxic in rows:
            at = (int.from_bytes(key[:8], "big") % buckets, key.hex(), part, mask, did)
            if did > least[key]:
                at = (-1 - zlib.crc32(f"{mask}{part}".encode()) % buckets, None, part, mask | REPEATS, None)
            n = sums.setdefault(at, [0, 0, 0])
            n[0], n[1], n[2] = n[0] + 1, n[1] + good, n[2] + toxic
        held = [(*k, *v) for k, v in sums.items()]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], [c.split()[0] for c in FACTS.split(", ")])


def first_ids(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the rows of a bucket's texts. State: by text, the smallest id and what its rows added."""
    changes: dict[tuple, list[int]] = {}
    texts = json.loads(state.get[0]) if state.exists else {}

    def add(part: str, mask: int, values: list[int], sign: int = 1) -> None:
        n = changes.setdefault((part, mask), [0, 0, 0])
        n[:] = [a + sign * v for a, v in zip(n, values, strict=True)]

    for frame in frames:
        columns = [frame[c].tolist() for c in ("text", "part", "mask", "did", "n", "good", "toxic")]
        for text, part, mask, did, *values in zip(*columns, strict=True):
            if text is None:
                add(part, mask, values)
                continue
            first, held = texts.get(text, (NO_ID + 1, []))
            if did < first:
                for p, *v in held:  # these were first until now
                    add(p, mask, v, -1)
                    add(p, mask | REPEATS, v)
                first, held = did, []
            if did == first:
                texts[text] = (first, [*held, [part, *values]])
            add(part, mask if did == first else mask | REPEATS, values)
    if texts:
        state.update((json.dumps(texts),))
    yield pd.DataFrame([(*at, *n) for at, n in changes.items()], columns=["part", "mask", "n", "good", "toxic"])


def marks_of(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """did, good, toxic of each labelled id, once."""
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    return labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("did")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def total_bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0


def run_stream(spark: SparkSession, path: str, labels: DataFrame, folder: str, max_bytes: int, stores: int, buckets: int) -> None:
    """Take all files under path that folder doesn't have yet; write each micro-batch's changes."""
    session = spark.newSession()  # with settings of its own, which other queries don't see
    settings = {"spark.sql.shuffle.partitions": str(stores), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"), "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    for k, v in settings.items():
        session.conf.set(k, v)
    schema = session.read.parquet(path).select("doc_id", "text", "source").schema
    # a stream takes a single file only as a pattern, so the last letter is written as a class of one
    docs = session.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.arrow_udf(judged, "struct<key:binary,mask:int>")(F.coalesce("text", F.lit(""))).alias("made"))
    # rows without an id take a number of their own to the join, so that they don't meet in one task
    rows = narrow.select("part", "made.*", F.coalesce("id", F.lit(NO_ID)).alias("did"), F.coalesce("id", F.xxhash64("made.key")).alias("to"), F.col("id").isNotNull().alias("known"))
    marks = marks_of(labels).select(F.col("did").alias("to"), F.lit(True).alias("known"), "good", "toxic")
    marked = rows.join(marks, ["to", "known"], "left").select("key", "mask", "part", "did", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    changes = marked.mapInArrow(lambda batches: combined(batches, buckets), FACTS).groupBy("bucket").applyInPandasWithState(first_ids, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
        sums.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def order_steps() -> Column:
    """An array of all orders of the filters and their steps, with the filter's bit and those of the ones before it."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": i + 1, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(counters: DataFrame) -> DataFrame:
    """A row a part, order and step, from counters: part, mask, n, good, toxic."""
    whole = 1 << len(FILTERS)
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(str(m)) for m in range(whole)]).alias(c)
    parts = materialize(counters.groupBy("part").agg(of("n"), of("good"), of("toxic")), "parts")
    masks = F.sequence(F.lit(0), F.lit(whole - 1))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(c: str, condition) -> Column:
        return F.aggregate(F.zip_with(c, masks, lambda v, m: F.when(condition(m), v).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, v: a + v)

    removed = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    orders = math.factorial(len(FILTERS))
    share = F.zip_with("n", masks, lambda v, m: F.when(m.bitwiseAND(bit) != 0, v * (F.lit(orders) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = parts.select("part", "n", "good", "toxic", F.explode(order_steps()).alias("s"))
    return rows.select(
        "part", "s.filter_order", "s.step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, v: a + v).alias("shapley"),
    )


def buckets_of(spark: SparkSession, folder: str, wanted: int) -> int:
    """How many buckets of texts the folder has; its first call's wish is kept."""
    at = f"{folder}/buckets"
    if exists(spark, at):
        return spark.read.parquet(at).first()["n"]
    n = max(64, min(2**31 - 1, wanted))
    spark.range(1).select(F.lit(n).alias("n")).write.parquet(at)
    return n


def audit_stream(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, max_bytes: int = 64 << 30, batches: int = 4, store_bytes: int = 1 << 30, bucket_bytes: int = 128 << 10) -> DataFrame:
    """The audit of all documents under path; folder: in shared storage, for later calls with more files."""
    folder = folder or shared_path(spark, "audit")
    total = total_bytes(spark, path)
    stores = max(8, min(4096, total // store_bytes))  # of the first call: later ones go by the checkpoint
    run_stream(spark, path, labels, folder, max(1, min(max_bytes, -(-total // batches))), stores, buckets_of(spark, folder, total // bucket_bytes))
    changes = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{folder}/changes")
    counters = changes.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n != 0")
    return audit(counters)
