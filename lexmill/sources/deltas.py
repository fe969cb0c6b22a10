"""Keyed tables as a base and deltas, with one manifest a version.

A commit writes only the rows that change, into a folder of its own, and then a manifest that lists the folders in order.
The manifest is written beside its place and renamed to it, which fails if that version exists: of two writers that start
from one version, one is refused and its folder is never listed. Readers take a manifest as it is, so they see a version
whole. (That needs a store whose rename is atomic, as HDFS's is.) Old folders stay, so a table can be rolled back to any version, until vacuum drops what the kept versions don't list.

A key may have many rows (a document its points): a delta replaces all rows of the keys that it names. Keys of deltas are
joined by broadcast only if they are measured to be few; else both sides are shuffled. Rows may also be appended without
naming keys: what is only appended is read without a join. Compaction folds the deltas into a
new base; until then reading costs the base and the deltas since.
"""

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import exists, fresh, join_sized, remove


class Conflict(ValueError):
    """Another writer has committed that version."""


class Manifest(NamedTuple):
    version: int
    key: str
    schema: str
    #: kind, folder and bytes of each part, oldest first: "rows" are the base and what upserts wrote, "more" what was
    #: appended, and "keys" names the keys whose older rows are gone.
    parts: tuple[tuple[str, str, int], ...]
    note: str
    tags: tuple[str, ...]


def _path(folder: str, version: int) -> str:
    return f"{folder}/_versions/{version:012d}.json"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_version(spark: SparkSession, folder: str) -> int:
    """The last committed version, -1 without any."""
    at, fs = _files(spark, f"{folder}/_versions")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=-1)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    version = last_version(spark, folder) if version is None else version
    if version < 0:
        raise ValueError(f"{folder} has no version")
    at, fs = _files(spark, _path(folder, version))
    stream = fs.open(at)
    try:
        said = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(**{**said, "parts": tuple(map(tuple, said["parts"])), "tags": tuple(said["tags"])})


def _commit(spark: SparkSession, folder: str, new: Manifest) -> int:
    """Put a manifest in its place, or raise Conflict if that is taken."""
    target, fs = _files(spark, _path(folder, new.version))
    beside, _ = _files(spark, f"{folder}/_versions/_{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(json.dumps(new._asdict(), indent=1).encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(beside, target, none)
    except Exception as refused:
        fs.delete(beside, False)
        if fs.exists(target):
            raise Conflict(f"version {new.version} of {folder} exists; read it and try again") from refused
        raise
    return new.version


def _write(df: DataFrame, folder: str, kind: str) -> tuple[str, str, int]:
    name = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    at, fs = _files(df.sparkSession, f"{folder}/{name}")
    return kind, name, fs.getContentSummary(at).getLength()


def create(rows: DataFrame, folder: str, key: str) -> int:
    """Version 0 of a table."""
    return _commit(rows.sparkSession, folder, Manifest(0, key, rows.schema.json(), (_write(rows, folder, "rows"),), "create", ()))


def upsert(folder: str, rows: DataFrame, expected: int | None = None, tag: str | None = None, tags_kept: int = 1000) -> int:
    """Replace the rows of all keys in rows; expected: the version that rows were made from. A tag that is committed
    already, of one of the last tags_kept tagged commits, changes nothing; so a repeated micro-batch commits once."""
    return _change(folder, rows, None, expected, tag, tags_kept, "upsert")


def append(folder: str, rows: DataFrame, expected: int | None = None, tag: str | None = None, tags_kept: int = 1000, check: Callable[[DataFrame], None] | None = None) -> int:
    """Add rows and leave all others, also those of the same keys. check gets the rows as they are written; if it raises, they
    are deleted and nothing is committed."""
    return _change(folder, rows, None, expected, tag, tags_kept, "append", check)


def delete(folder: str, keys: DataFrame, expected: int | None = None, tag: str | None = None, tags_kept: int = 1000) -> int:
    """Drop all rows of the keys."""
    return _change(folder, None, keys, expected, tag, tags_kept, "delete")


def replace(folder: str, rows: DataFrame, keys: DataFrame, expected: int | None = None, tag: str | None = None, tags_kept: int = 1000) -> int:
    """Drop all rows of the keys and add rows, in one version; the keys of rows are among the keys."""
    return _change(folder, rows, keys, expected, tag, tags_kept, "replace")


def _change(folder: str, rows: DataFrame | None, keys: DataFrame | None, expected: int | None, tag: str | None, tags_kept: int, note: str, check: Callable[[DataFrame], None] | None = None) -> int:
    spark = (rows if rows is not None else keys).sparkSession
    now = manifest(spark, folder)
    if tag is not None and tag in now.tags:
        return now.version
    if expected is not None and expected != now.version:
        raise Conflict(f"{folder} is at version {now.version}, not {expected}")
    parts = list(now.parts)
    if note == "append":
        rows = rows.select(*read(spark, folder).columns)
        parts.append(_write(rows, folder, "more"))
        if check:
            path = f"{folder}/{parts[-1][1]}"
            try:
                check(spark.read.schema(rows.schema).parquet(path))
            except Exception:
                remove(spark, [path])
                raise
    elif rows is not None:
        rows = rows.select(*read(spark, folder).columns)
        kept = _write(rows, folder, "rows")
        if keys is None:
            keys = spark.read.parquet(f"{folder}/{kept[1]}").select(now.key)
        parts += [_write(keys.select(now.key).distinct(), folder, "keys"), kept]
    else:
        parts.append(_write(keys.select(now.key).distinct(), folder, "keys"))
    tags = (*now.tags, tag)[-tags_kept:] if tag is not None else now.tags
    return _commit(spark, folder, now._replace(version=now.version + 1, parts=tuple(parts), note=note, tags=tags))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of a version."""
    from pyspark.sql.types import StructType

    at = manifest(spark, folder, version)
    schema = StructType.fromJson(json.loads(at.schema))
    load = lambda i: spark.read.schema(schema).parquet(f"{folder}/{at.parts[i][1]}")
    keys = [i for i, p in enumerate(at.parts) if p[0] == "keys"]
    added = [i for i, p in enumerate(at.parts) if p[0] == "more"]
    if not keys:
        out = load(0)
        for i in added:
            out = out.unionByName(load(i))
        return out
    key, order = schema[at.key], fresh(schema.names, "_order")
    named = [spark.read.schema(StructType([key])).parquet(f"{folder}/{at.parts[i][1]}").withColumn(order, F.lit(i)) for i in keys]
    gone = named[0]
    for more in named[1:]:
        gone = gone.unionByName(more)
    last = gone.groupBy(at.key).agg(F.max(order).alias(order))  # after which part a key's rows count
    base = join_sized(load(0), last.select(at.key), at.key, "left_anti")
    later = None
    for i, p in enumerate(at.parts):
        if i and p[0] == "rows":
            some = load(i).withColumn(fresh(schema.names, "_part"), F.lit(i))
            later = some if later is None else later.unionByName(some)
    part, out = fresh(schema.names, "_part"), base.select(*schema.names)
    if later is not None:
        out = out.unionByName(later.join(last, at.key).filter(F.col(part) > F.col(order)).select(*schema.names))
    for i in added:
        some = load(i)
        if i < keys[-1]:  # keys named since may be among them
            some = join_sized(some, last, at.key).filter(F.col(order).isNull() | (F.col(order) < i))
        out = out.unionByName(some.select(*schema.names))
    return out


def compact(spark: SparkSession, folder: str) -> int:
    """Fold the deltas into a new base."""
    now = manifest(spark, folder)
    return _commit(spark, folder, now._replace(version=now.version + 1, parts=(_write(read(spark, folder, now.version), folder, "rows"),), note="compact"))


def rollback(spark: SparkSession, folder: str, version: int) -> int:
    """A new version with the contents of an older one; nothing is copied."""
    now, then = last_version(spark, folder), manifest(spark, folder, version)
    return _commit(spark, folder, then._replace(version=now + 1, note=f"rollback to {version}"))


def history(spark: SparkSession, folder: str) -> list[tuple[int, str, int]]:
    """Version, note and listed bytes of all versions."""
    found = (manifest(spark, folder, v) for v in range(last_version(spark, folder) + 1) if exists(spark, _path(folder, v)))
    return [(m.version, m.note, sum(p[2] for p in m.parts)) for m in found]


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Drop versions but for the last `keep`, and the data folders that those don't list; how many folders went. Not while
    a writer is at work, whose folder isn't listed yet."""
    last = last_version(spark, folder)
    listed = {p[1] for v in range(max(0, last - keep + 1), last + 1) for p in manifest(spark, folder, v).parts}
    at, fs = _files(spark, f"{folder}/data")
    gone = [f"{folder}/data/{x.getPath().getName()}" for x in fs.listStatus(at) if f"data/{x.getPath().getName()}" not in listed]
    remove(spark, [*gone, *[_path(folder, v) for v in range(last - keep + 1) if exists(spark, _path(folder, v))]])
    return len(gone)
