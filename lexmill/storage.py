"""Intermediate tables in the shared folder, and joins whose broadcast is decided by a measured size."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without one, a temporary folder is set as it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table of this application."""
    return f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables written inside are deleted at the end, but for those taken off the list."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made.remove(paths)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: the lineage is cut and any executor can reread it."""
    path = shared_path(df.sparkSession, name)
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores added until no column in taken has it (column names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def join_sized(left: DataFrame, right: DataFrame, key: str, how: str = "left", max_bytes: int = 8 << 20) -> DataFrame:
    """left join right on key. right, an already materialised table with one row a key, is broadcast only if its rows
    and keys are measured to take at most max_bytes; beyond that it is a shuffle join, whose hot keys AQE splits."""
    width = 16 * len(right.columns)
    size = right.agg(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + width).alias("b")).first()["b"]
    return left.join(F.broadcast(right) if (size or 0) <= max_bytes else right, key, how)


def spread(df: DataFrame) -> DataFrame:
    """df, a table just read, dealt over all cores if its files give only half of them a task, as one small file does.

    Larger tables come as they are: what is moved here is less than a split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
