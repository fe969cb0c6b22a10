"""Expressions shared by the operators on documents."""

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the result contracts: what counts as white space, and a word as a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text: Column | str) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words."""
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_id(doc_id: Column | str = "doc_id") -> Column:
    """doc_id as a join key: a null stands for one document below all others."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-(2**63)).cast("long"))


def hash_cutoff(df: DataFrame, key: Column, most: int) -> int:
    """The xxhash64 of key up to which df has `most` rows (all of them, if there are no more).

    A count gives the share of the hashes that surely holds so many; only that share's hashes are sorted, so what meets
    in one task doesn't grow with the table. Rows of equal keys fall on the same side.
    """
    n, h = df.count(), F.xxhash64(key)
    if n <= most:
        return 2**63 - 1
    share = min(1.0, (1.2 * most + 100) / n)
    near = df.select(h.alias("h")).filter(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    return near.orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column, of which one at a time is a Python string: a batch may hold thousands of long ones."""
    for x in texts:
        yield x.as_py()
