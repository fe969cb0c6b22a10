"""Publication of a prepared corpus: gates, vectors, points committed batch by batch, exact count, activation with a way back.

A corpus comes as two Parquet folders, articles and their chunks (the columns that `prepared.article_errors` and
`prepared.chunk_errors` check). Nothing is written before all gates hold. Chunks then arrive as a stream; each micro-batch
gets its vectors and is appended to the table of points by one commit, tagged with its number, so a run that was stopped
between write and checkpoint goes on without losing or doubling a point, and readers needn't join. The run is complete when the table holds exactly the
chunks' points. What a run does is kept in a table of one row, `out`/state; a run is only taken up again by asking for it, and
only with the corpus that it was begun with.

Activation is a table of its own, a narrow row an article, so that it doesn't rewrite vectors: the rows are committed, a
check looks at the corpus as readers would see it, and if it finds fault the commit is rolled back.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import prepared
from lexmill.sources import deltas
from lexmill.storage import materialize
from lexmill.streaming.ingest import Changed, stream_of

#: Columns of a chunk that its point keeps.
KEPT = ("point_id", "article_id", "chunk_index", "start", "end", "excerpt_sha256", "chunk_text")


class Refused(ValueError):
    """A gate doesn't hold; found says how often each error occurs."""

    def __init__(self, message: str, found: dict[str, int] | None = None):
        super().__init__(f"{message}: {found}" if found else message)
        self.found = found or {}


def corpus_errors(articles: DataFrame, chunks: DataFrame) -> dict[str, int]:
    """How many articles or chunks have each error; the names are a fixed set."""
    found = prepared.article_errors(articles, chunks).select(F.explode("errors").alias("error"), F.lit("article").alias("of"))
    found = found.unionByName(prepared.chunk_errors(articles, chunks).select(F.explode("errors").alias("error"), F.lit("chunk").alias("of")))
    return {f"{r['of']} {r['error']}": r["n"] for r in found.groupBy("of", "error").agg(F.count("*").alias("n")).orderBy("of", "error").collect()}


def fingerprint(df: DataFrame) -> str:
    """Rows and a digest of their contents that ignores their order but not how often a row is there."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    said = df.select(each.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{said['n']}:{said['s'] or 0}:{said['x'] or 0}"


def state_of(spark: SparkSession, out: str) -> dict | None:
    """collection, signature, status and n_points of a run, or None before one."""
    at = f"{out}/state"
    return deltas.read(spark, at).first().asDict() if deltas.last_version(spark, at) >= 0 else None


def _begin(spark: SparkSession, out: str, collection: str, signature: str, resume: bool) -> str:
    """The run's status, after refusing one that isn't what was asked for."""
    before = state_of(spark, out)
    if before and before["signature"] != signature:
        raise Changed(f"{out} was begun with another corpus or collection")
    if before and not resume:
        raise Refused(f"{out} holds a run that is {before['status']}; resume it or take another place")
    if not before:
        if resume:
            raise Refused(f"{out} holds no run to resume")
        _say(spark, out, collection, signature, "in_progress", 0)
    return before["status"] if before else "in_progress"


def _say(spark: SparkSession, out: str, collection: str, signature: str, status: str, n: int) -> None:
    row = spark.createDataFrame([(collection, signature, status, n)], "collection string, signature string, status string, n_points long").coalesce(1)
    if deltas.last_version(spark, f"{out}/state") < 0:
        deltas.create(row, f"{out}/state", "collection")
    else:
        deltas.upsert(f"{out}/state", row)


def publish(
    spark: SparkSession, articles: str, chunks: str, out: str, collection: str, target: str, embed: Callable[[DataFrame], DataFrame], dimension: int, status: str = "ACTIVE", resume: bool = False, allow_pending: bool = False, files: int = 1000
) -> DataFrame:
    """Bring a prepared corpus into a collection and return the table of its points.

    target and status are what the corpus says of itself: the collection that it was prepared for, and whether it is
    active. embed adds the column vector to chunks. Raises Refused, before anything is written, if the collection is
    protected or another one, if the corpus isn't active (unless that is allowed), or if its articles or chunks have errors;
    and, after earlier batches were committed, if a batch gets vectors that are missing, doubled or faulty, or
    if in the end points are missing or unexpected. An empty corpus makes an empty table.
    """
    if spark.range(1).filter(prepared.protected(F.lit(collection), prepared.PROTECTED)).count():
        raise Refused(f"{collection} is protected")
    if collection != target:
        raise Refused(f"the corpus is for {target}, not {collection}")
    if status != "ACTIVE" and not allow_pending:
        raise Refused(f"the corpus is {status}")
    whole, parts = spark.read.parquet(articles), spark.read.parquet(chunks)
    if found := corpus_errors(whole, parts):
        raise Refused("articles or chunks have errors", found)
    signature = f"{collection} {fingerprint(whole)} {fingerprint(parts)} {dimension}"
    done = _begin(spark, out, collection, signature, resume) == "complete"
    at = f"{out}/points"
    if deltas.last_version(spark, at) < 0:
        empty = parts.select(*KEPT).limit(0).withColumn("vector", F.lit(None).cast("array<double>"))
        deltas.create(empty, at, "point_id")

    def batch(df: DataFrame, number: int) -> None:
        sent = df.count()

        def check(held: DataFrame) -> None:
            faults = held.agg(F.count("*").alias("rows"), F.count_distinct("point_id").alias("ids"), F.count_if(F.size(prepared.vector_errors(F.col("vector"), dimension)) > 0).alias("faulty")).first()
            if faults["rows"] != sent or faults["ids"] != sent or faults["faulty"]:
                raise Refused(f"batch {number} of {sent} chunks", faults.asDict())

        made = embed(df.select(*KEPT)).select(*KEPT, F.col("vector").cast("array<double>").alias("vector"))
        deltas.append(at, made, tag=f"batch {number}", check=check)  # written once; ids are unique by the gates, so no keys need be named

    if not done:
        stream_of(spark, chunks, files).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    n = _counted(deltas.read(spark, at), parts)
    if not done:
        _say(spark, out, collection, signature, "complete", n)
    return deltas.read(spark, at)


def _counted(points: DataFrame, chunks: DataFrame) -> int:
    """The number of points, which are the chunks' own, each once; ids and no texts are compared."""
    mine, theirs = (df.groupBy("point_id").agg(F.count("*").alias(name)) for df, name in ((points, "held"), (chunks, "wanted")))
    n, held, wanted = F.coalesce("held", F.lit(0)), F.col("held"), F.col("wanted")
    said = mine.join(theirs, "point_id", "full").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count_if(held.isNull()).alias("missing"), F.count_if(wanted.isNull()).alias("unexpected"), F.count_if(held > 1).alias("doubled")).first()
    if said["missing"] or said["unexpected"] or said["doubled"]:
        raise Refused("points differ from chunks", said.asDict())
    return said["n"]


def activate(spark: SparkSession, out: str, articles: DataFrame, by: str, at: str, check: Callable[[DataFrame], dict[str, int]]) -> int:
    """Make articles (article_id) active and return the version of `out`/activation that says so.

    check gets the points of all active articles as they are then, and returns how often each fault occurs; with any, or if it
    fails itself, activation goes back to what it was before, and Refused or its own error is raised. A run that isn't
    complete, or articles without points, are refused. Of two that activate at one time one gets a Conflict.
    """
    state = state_of(spark, out)
    if not state or state["status"] != "complete":
        raise Refused(f"{out} holds no complete run")
    rows = materialize(articles.select("article_id").distinct().withColumns({"activated_by": F.lit(by), "activated_at": F.lit(at)}), "activated")
    lost = rows.join(deltas.read(spark, f"{out}/points").select("article_id"), "article_id", "left_anti").count()
    if lost:
        raise Refused("articles to activate have no points", {"articles": lost})
    folder = f"{out}/activation"
    if deltas.last_version(spark, folder) < 0:
        deltas.create(rows.limit(0), folder, "article_id")
    before = deltas.last_version(spark, folder)
    version = deltas.upsert(folder, rows, before)
    try:
        faults = {k: v for k, v in check(active_points(spark, out)).items() if v}
    except Exception:
        deltas.rollback(spark, folder, before)
        raise
    if faults:
        deltas.rollback(spark, folder, before)
        raise Refused("activation was rolled back", faults)
    return version


def active_points(spark: SparkSession, out: str) -> DataFrame:
    """The points of active articles, with who activated them and when."""
    points, folder = deltas.read(spark, f"{out}/points"), f"{out}/activation"
    if deltas.last_version(spark, folder) < 0:
        return points.withColumns({"activated_by": F.lit(None).cast("string"), "activated_at": F.lit(None).cast("string")}).limit(0)
    return points.join(deltas.read(spark, folder), "article_id")
