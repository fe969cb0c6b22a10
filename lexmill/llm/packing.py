"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, in Arrow batches; longer ones are cut, the first piece taking what is left over. Only the
histogram of lengths (a number a length, at most `capacity` of them) reaches the driver. There the patterns of two or
three lengths that fill a sequence are enumerated, non-negative least squares fits how often each repeats to the
histogram, the counts are rounded within what is there, and best fit packs the residual lengths. The plan says which
ranks of each length go where; pieces get their rank among equals by a count a (length, salt) and a row number within.

The plan has at most about capacity^2 / 4 entries, whatever the input (88 thousand patterns at 1024, few of them used).
Hot lengths are spread over salts, so no task holds one length. Rerun tasks get the same ranks: they are fixed by a
number stored with each piece.

Edge cases: a null or empty text is one piece of its end token; an empty table gives an empty result; repeated rows and
repeated ids are packed row by row.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import one_by_one, whole_text
from lexmill.llm.tokens import encoder
from lexmill.storage import materialize, partitions

END = 2


def pieces(docs: DataFrame, tokenizer: str, text: str, doc_id: str, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces, with a unique number uid; materialised."""
    kind = docs.schema[doc_id].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            who, found = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids")}
            for row, said in enumerate(one_by_one(batch.column(1))):
                ids = np.append(np.asarray(encode(said), "<u4"), np.uint32(END)).astype("<u4")
                at, n = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    part = ids[at : at + n]
                    who.append(row)
                    for k, v in zip(found, (piece, at, n, zlib.crc32(part.tobytes()), part.astype(np.int32).tolist() if with_ids else None), strict=True):
                        found[k].append(v)
                    at, n = at + n, capacity
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            columns = {"doc_id": batch.column(0).take(pa.array(who, pa.int64()))} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items() if k != "ids" or with_ids}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    cut_up = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("t")).mapInArrow(cut, schema)
    return materialize(cut_up.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def patterns(capacity: int) -> np.ndarray:
    """Rows of three lengths that add up to capacity, in descending order; 0 where a pattern has two."""
    pairs = np.arange(1, capacity // 2 + 1)
    rows = [np.stack([capacity - pairs, pairs, 0 * pairs], 1)]
    for c in range(1, capacity // 3 + 1):
        b = np.arange(c, (capacity - c) // 2 + 1)
        rows.append(np.stack([capacity - c - b, b, 0 * b + c], 1))
    return np.concatenate(rows)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often each pattern repeats: non-negative least squares by accelerated projected gradients."""
    used = rows > 0
    padded = np.append(counts, 0.0)
    at = np.where(used, rows, len(counts))  # a dummy place for the missing third length

    def residual(x: np.ndarray) -> np.ndarray:
        made = np.bincount(at.ravel(), np.repeat(x, 3), len(padded))[: len(padded)]
        made[-1] = 0
        return made - padded

    gradient = lambda r: r[at].sum(1)
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = gradient(np.append(residual(v)[:-1] + counts, 0.0))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - gradient(residual(y)) / size)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / after * (new - x), after
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats): all of counts by best fit, longest first, equal sequences together."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            held, room[space] = room[space], []
            most = space // length
            for have, n in held:
                takes = min(n, left // most)
                if takes:
                    room.setdefault(space - most * length, []).append((have + [length] * most, takes))
                    left -= takes * most
                if n - takes and left and left < most:
                    room.setdefault(space - left * length, []).append((have + [length] * left, 1))
                    takes, left = takes + 1, 0
                if n - takes:
                    room[space].append((have, n - takes))
            if not room[space]:
                del room[space]
        most = capacity // length
        for k, n in ((most, left // most), (left % most, 1)):
            if k and n:
                room.setdefault(capacity - k * length, []).append(([length] * k, n))
    return [x for held in room.values() for x in held]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, repeats) for all lengths below capacity."""
    counts = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        if length < capacity:
            counts[length] = n
    if not counts.any():
        return []
    rows = patterns(capacity)
    rows = rows[(counts[rows[:, 0]] > 0) & (counts[rows[:, 1]] > 0) & ((rows[:, 2] == 0) | (counts[rows[:, 2]] > 0))]
    left, out = counts.tolist(), []
    if len(rows):
        x = fit(rows, counts.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.01:
                break
            lengths = [int(v) for v in rows[i] if v]
            n = min(round(float(x[i])) or 1, *(left[v] // lengths.count(v) for v in lengths))
            if n:
                out.append((lengths, n))
                for v in lengths:
                    left[v] -= n
    return out + best_fit(np.array(left), capacity)


def lookup(planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) with the first sequence and the offset of each run of ranks."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for lengths, n in planned:
        offset = 0
        for v in lengths:
            runs.append(((v << 44) + used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    runs.sort()
    return tuple(np.array([r[i] for r in runs], np.int64) for i in range(3))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer, text, doc_id, capacity, with_ids)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))
    salts = max(32, partitions(spark))
    short = rows.filter(F.col("length") < capacity).withColumn("salt", (F.col("uid") % salts).cast("int"))
    counts = short.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = short.withColumn("rank", within).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = table.value
        key = (length.to_numpy() << 44) + rank.to_numpy()
        at = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + key - keys[at], "offset": offsets[at]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    packed = ranked.withColumn("at", place("length", "rank")).select("*", "at.sequence_id", "at.offset").select(*columns)
    # full pieces need no company; their sequences are numbered apart from the others
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("uid").bitwiseOR(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(*columns))
