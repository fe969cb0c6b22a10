"""Keyed tables on plain Parquet: upserts, merges, versions, retention, set comparisons."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_DAYS = 7


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All of new and the rows of old whose key isn't in it."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def merge_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with new's value of each field where new has one; no row is added."""
    given = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return old.join(given, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def latest(df: DataFrame, by: str, *order: str) -> DataFrame:
    """The last row of each key; one struct a key and task is shuffled, so a hot key is no burden."""
    rest = [c for c in df.columns if c != by and c not in order]
    return df.groupBy(by).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(by, *[F.col(f"_m.{c}") for c in [*order, *rest]])


def next_version(versions: DataFrame, owners: DataFrame, key: str, version: str = "version") -> DataFrame:
    """key, next_version of every owner: one more than its last, 1 if it has none."""
    last = versions.groupBy(key).agg(F.max(version).alias("_v"))
    return owners.select(key).distinct().join(last, key, "left").select(key, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("next_version"))


def expires(expires_at: Column | None, created_at: Column, days: int = RETENTION_DAYS) -> Column:
    """A missing expiry isn't for ever: it is days after the row was made."""
    default = created_at + F.make_dt_interval(F.lit(days))
    return default if expires_at is None else F.coalesce(expires_at, default)


def id_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: ids that are missing from actual or unexpected in it."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def route_ingest(rows: DataFrame, known: DataFrame, digest: str = "sha256", source: str = "source") -> DataFrame:
    """rows with route: skip if digest and source are known, sync if the digest is known elsewhere, else store."""
    seen = known.groupBy(digest).agg(F.max(source).alias("_source"))
    joined = rows.join(seen, digest, "left")
    return joined.withColumn("route", F.when(F.col("_source").isNull(), "store").when(F.col("_source") == F.col(source), "skip").otherwise("sync")).drop("_source")


def optimistic(state: DataFrame, changes: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """changes with accepted: whether they were made on the key's present revision."""
    now = state.select(key, F.col(revision).alias("_r"))
    return changes.join(now, key, "left").withColumn("accepted", F.coalesce(F.col("base_revision") == F.col("_r"), F.lit(False))).drop("_r")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def pairs_within(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, a, b: the unordered pairs of a group's values; for groups that are small by their nature."""
    a, b = df.select(by, F.col(value).alias("a")).distinct(), df.select(by, F.col(value).alias("b")).distinct()
    return a.join(b, by).filter("a < b")


def last_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """parents left-joined with the last of each one's children."""
    return parents.join(latest(children.select(key, *order, *keep), key, *order), key, "left")


def numbered_pages(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.withColumn("page_no", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
