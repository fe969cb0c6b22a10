"""Streams with state of their own: retention sweeps by timers, and message threads merged by message id.

Both run with Spark's stateful processors in RocksDB, in a session of their own, until what is there has been read; a later
call resumes from the checkpoint. What a micro-batch hands on goes to a folder of its own, which a repeated one replaces.
"""

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexmill.storage import exists

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
LEAST_INTERVAL = 30
#: Owners a state key.
OWNERS = 64
EVENT = "owner string, id string, kind string, at timestamp, expires_at timestamp"
DUE = "owner string, id string, expires_at timestamp, attempt int, swept_at timestamp"
MESSAGE = "thread string, id string, seq long, version long, role string, text string, removed boolean"


def own_session(spark: SparkSession, stores: int) -> SparkSession:
    """A session whose settings other queries don't see."""
    session = spark.newSession()
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(stores), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        session.conf.set(k, v)
    return session


class Retention(StatefulProcessor):
    """Of a bucket of owners' rows: when each expires, when it is next tried, and how often it was. One timer a bucket, at the
    earliest; a call of Python a key costs more than what it does for a row, so a key holds the rows of some tens of owners.

    A row is handed on when the watermark has passed its expiry, and again every interval until a `gone` event says that
    it has been removed; so a removal that fails keeps the row. A row that is put again gets its new expiry. A `gone` event
    from after the expiry doesn't undo that the row was due."""

    def __init__(self, interval: int):
        self.interval = 1000 * max(LEAST_INTERVAL, interval)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "rows string, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held, timer = self._load()
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"] == "gone")):
            name = json.dumps([r["owner"], r["id"]])
            known = held.get(name)
            if r["kind"] == "put":
                held[name] = [r["expiry"], r["expiry"], 0]
            elif known:
                if not known[2] and known[0] < r["at"]:
                    yield Row(owner=r["owner"], id=r["id"], expires=known[0], attempt=1, swept=timerValues.getCurrentWatermarkInMs())
                del held[name]
        yield from self._due(held, timer, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held, _ = self._load()
        yield from self._due(held, None, timerValues)

    def _load(self) -> tuple[dict[str, list[int]], int | None]:
        found = self.held.get()
        return (json.loads(found[0]), found[1]) if found else ({}, None)

    def _due(self, held: dict[str, list[int]], timer: int | None, timers: TimerValues) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs()
        for name, row in held.items():
            if row[1] < now:
                row[1:] = [now + self.interval, row[2] + 1]
                owner, i = json.loads(name)
                yield Row(owner=owner, id=i, expires=row[0], attempt=row[2], swept=now)
        first = min((row[1] for row in held.values()), default=None)
        if timer is not None and timer != (first and first + 1):
            self.handle.deleteTimer(timer)
        if first is not None and timer != first + 1:
            self.handle.registerTimer(first + 1)
        if held:
            self.held.update((json.dumps(held), first + 1))
        else:
            self.held.clear()


def owner_buckets(spark: SparkSession, events: str, out: str, stores: int) -> int:
    """How many buckets the owners are dealt into: some tens of owners a bucket by the first call's events. It is kept with the
    checkpoint, as state stays where it is."""
    at = f"{out}/buckets"
    if not exists(spark, at):
        found = spark.read.schema(EVENT).parquet(events).agg(F.approx_count_distinct("owner").alias("n")).first()["n"]
        spark.range(1).select(F.lit(max(4 * stores, found // OWNERS)).cast("long").alias("n")).write.parquet(at)
    return spark.read.parquet(at).first()["n"]


def sweep(spark: SparkSession, events: str, out: str, purge: Callable[[DataFrame], DataFrame], interval: int = 300, delay: int = 3600, stores: int = 8) -> DataFrame:
    """Take the new events into the state, try to remove what is due, and acknowledge what was removed.

    events: a folder of Parquet files (EVENT; kind: put, gone or clock, `at`: when it was recorded, which moves the clock);
    purge: from the due rows (DUE) to the same with `removed`; it may be called again for rows that were already removed.
    Acknowledgements are events that the next call reads. Returns all outcomes so far: owner, id,
    expires_at, attempt, swept_at, removed, batch. What is recorded more than `delay` seconds behind the clock is too late and
    left out, so `at` is when an event was recorded, not what it is about.
    """
    session = own_session(spark, stores)
    acknowledged = f"{out}/acknowledged"
    if not exists(spark, acknowledged):
        spark.createDataFrame([], EVENT).write.parquet(f"{acknowledged}/batch=-1")
    bucket = F.pmod(F.xxhash64("owner"), F.lit(owner_buckets(spark, events, out, stores))).alias("bucket")
    sources = [session.readStream.schema(EVENT).parquet(x).select(*[c.split()[0] for c in EVENT.split(", ")]) for x in (events, acknowledged)]
    rows = sources[0].unionByName(sources[1]).filter("kind != 'put' or expires_at is not null").withWatermark("at", f"{delay} seconds")
    ms = lambda c: F.unix_millis(F.col(c))
    due = rows.select(bucket, "owner", "id", "kind", F.col("at").alias("recorded"), ms("at").alias("at"), ms("expires_at").alias("expiry")).groupBy("bucket").transformWithState(Retention(interval), "owner string, id string, expires long, attempt int, swept long", "append", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        tried = purge(batch.select("owner", "id", F.timestamp_millis("expires").alias("expires_at"), "attempt", F.timestamp_millis("swept").alias("swept_at")))
        tried.select("owner", "id", "expires_at", "attempt", "swept_at", "removed").write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")
        done = spark.read.parquet(f"{out}/outcomes/batch={number}").filter("removed")
        gone = done.select("owner", "id", F.lit("gone").alias("kind"), (F.col("swept_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay))).alias("at"), F.lit(None).cast("timestamp").alias("expires_at"))
        gone.write.mode("overwrite").parquet(f"{acknowledged}/batch={number}")

    due.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(f"{DUE}, removed boolean, batch int").parquet(f"{out}/outcomes")


class Threads(StatefulProcessor):
    """A thread's messages by id. Of a message, the place is the smallest it was ever given, the content that of its last
    version, and a removal is a version; so order and repetition of what arrives don't matter, and no other message is
    rewritten. Changed messages are handed on whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "id string", "seq long, version long, role string, text string, removed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new: dict[str, tuple] = {}
        for r in rows:
            new[r["id"]] = merged(new.get(r["id"]), (r["seq"], r["version"], r["role"], r["text"], r["removed"]))
        for i, said in new.items():
            old = self.messages.getValue((i,))
            now = merged(tuple(old) if old else None, said)
            if old is None or now != tuple(old):
                self.messages.updateValue((i,), now)
                yield Row(thread=key[0], id=i, seq=now[0], version=now[1], role=now[2], text=now[3], removed=now[4])


def merged(one: tuple | None, two: tuple) -> tuple:
    """Of two states of a message: the smaller place, and the later version (of equal ones the larger content)."""
    if one is None:
        return two
    rest = max(one[1:], two[1:], key=lambda x: (x[0], *[(v is not None, v) for v in x[1:]]))
    return (min(one[0], two[0]), *rest)


def merge_threads(spark: SparkSession, messages: str, out: str, files: int = 1000, stores: int = 8) -> DataFrame:
    """Merge the new message files (a folder of Parquet, MESSAGE) into the threads; returns all messages as they are now.

    The folder `out` has each micro-batch's changed messages, of which the last state counts."""
    session = own_session(spark, stores)
    rows = session.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).parquet(messages)
    changed = rows.groupBy("thread").transformWithState(Threads(), MESSAGE, "update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    changed.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    changes = spark.read.schema(f"{MESSAGE}, batch int").parquet(f"{out}/changes")
    last = changes.groupBy("thread", "id").agg(F.max_by(F.struct("seq", "version", "role", "text", "removed"), "batch").alias("m"))
    return last.select("thread", "id", "m.*")
