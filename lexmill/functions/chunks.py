"""Chunkers: fixed steps, sentence-aware steps with overlap, and recursive separators."""

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a chunk may end, and the separators of the recursive splitter in order.
PREFERRED = "\n。；："
SEPARATORS = ("\n\n", "\n", "。", "；", " ", "")


def fixed_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """df with chunk_index, start and chunk: a chunk every size - overlap characters, all in the JVM."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1))
    return df.withColumn("chunk_index", at).withColumn("start", F.col("chunk_index") * step).withColumn("chunk", F.substr(F.col(text), F.col("start") + 1, F.lit(size)))


def split_preferred(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of chunks of at most size characters that end after a preferred mark in their last two thirds, if there is one."""
    start, n = 0, len(text)
    while start < n:
        limit = min(n, start + size)
        end = n
        if limit < n:
            least = start + max(1, size // 3)
            mark = max(text.rfind(c, least, limit) for c in PREFERRED)
            end = mark + 1 if mark >= least else limit
        yield start, end
        if end == n:
            return
        start = end - overlap if end - overlap > start else end


def spans_of(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """Lists of start and end of each text's chunks. One text at a time is a Python string, and of spans eight bytes are kept."""
    at, ends = array("i"), array("i", [0])
    for text in texts:
        for span in split_preferred(text.as_py() or "", size, overlap):
            at.extend(span)
        ends.append(len(at) // 2)
    pairs = np.frombuffer(at, np.int32).reshape(-1, 2) if at else np.empty((0, 2), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["start", "end"]))


def preferred_chunks(df: DataFrame, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """df with chunk_index, start, end and chunk. Only offsets come from Python; texts are cut in the JVM."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return spans_of(texts, size, overlap)

    single = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    found = F.when(F.length(text) <= size, single).otherwise(spans(F.when(F.length(text) > size, F.col(text))))
    cut = df.filter(F.length(text) > 0).select("*", F.posexplode(found).alias("chunk_index", "_s"))
    return cut.withColumn("start", F.col("_s.start")).withColumn("end", F.col("_s.end")).drop("_s").withColumn("chunk", F.substr(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))


def recursive_chunks(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split by the first separator that occurs, long parts by the next ones, and join neighbours up to size with overlap."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(mark) if mark else text) if p]
    out: list[str] = []
    near: list[str] = []

    def flush() -> None:
        if joined := mark.join(near).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size and rest:
            flush()
            near.clear()
            out += recursive_chunks(part, size, overlap, rest)
            continue
        while near and len(mark.join([*near, part])) > size:
            if len(mark.join(near)) > overlap:
                flush()
                while near and (len(mark.join(near)) > overlap or len(mark.join([*near, part])) > size):
                    near.pop(0)
            else:
                near.pop(0)
        near.append(part)
    flush()
    return out


def recursive_column(text: Column) -> Column:
    """Array of chunks of 1000 characters with an overlap of 200."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([recursive_chunks(t or "") for t in texts])

    return split(text)
