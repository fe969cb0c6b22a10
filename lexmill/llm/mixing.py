"""Mixing sources to target weights.

Words are summed by source; targets share `budget_pct` percent of all words by the sources' weights and stop at
`most_times` a source's size, the excess being shared again until none is above. A source's rate is target / size; a
document is taken floor(rate) times, and once more if a hash of its id, read as a fraction, is below the rest.
Documents are drawn one by one, so what a source misses its target by has a standard deviation of the square root of
f (1 - f) times the sum of its squared sizes, f being the rate's fraction: a share that falls with the square root of the
number of documents, and a few per cent for a source of a few hundred. Drawing them in an order that balances sizes would
shuffle whole texts.

Sums by source are combined before the shuffle; sources are ranked by a range sort, and the water level is found in
rounds of one aggregate over the source table. Rates are broadcast only after their size is measured; beyond it the
join shuffles and AQE splits a hot source.

Edge cases: null texts have size 0; a null source is the last source; sources without words get target 0 and rate 0;
rows without an id are drawn by a hash of their text; repeated rows are drawn alike, so that reruns agree.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import WORD, whole_text
from lexmill.storage import fresh, join_sized, materialize

WEIGHTS = (5, 2, 1)


def word_count(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_key(source: str) -> Column:
    """A key that sorts as the source by code points, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def ranked(df: DataFrame, by: str, out: str, name: str) -> DataFrame:
    """Add out: the global rank (from 0) by a unique column, from a range sort and a count a partition."""
    parts = materialize(df.orderBy(by).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).collect()  # a row a partition
    start, starts = 0, {}
    for row in sorted(counts):
        starts[row["_p"]] = start
        start += row["_n"]
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[part] if starts else F.lit(0)
    return parts.withColumn(out, (base + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")


def targets(sizes: DataFrame, budget_pct: int = 150, most_times: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, source_size, target, rate of each source. sizes: doc key and size rows with columns key, size."""
    by_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    at = F.create_map(*[F.lit(x) for pair in enumerate(weights) for x in pair])
    table = ranked(by_source, "key", "rank", "sources").withColumn("weight", at[(F.col("rank") % len(weights)).cast("int")])
    table = materialize(table.drop("rank"), "weights")
    total = (table.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * budget_pct
    cap, level = most_times * F.col("source_size"), None  # cap is exact; level, in words a unit of weight, is one division
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        x = table.agg(F.sum(F.when(full, cap).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not x["open"]:
            break
        now = (total - 100 * x["held"]) / (100 * x["open"])
        if level is not None and now <= level:
            break
        level = now
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level)) if level is not None else cap.cast("double")
    table = table.withColumn("target", target)
    return materialize(table.select("key", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")), "targets")


def draw(doc_id: str, text: str, seed: int) -> Column:
    """A fraction from 0 below 1, fixed by the seed and the id (the text where the id is null)."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text"), whole_text(text))))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def mix_table(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, **shares) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("key"), word_count(text).alias("size"), draw(doc_id, text, seed).alias("u")), "sizes")
    df = join_sized(rows, targets(rows.select("key", "size"), **shares), "key")
    df = df.withColumn("copies", copies(F.col("rate"), F.col("u")))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, **shares) -> DataFrame:
    """docs, each row as often as the mix takes it. Words are counted for the sources first, then only rates meet the text."""
    key, n = fresh(docs.columns, "_key"), fresh(docs.columns, "_copies")
    rates = targets(docs.select(source_key(source).alias("key"), word_count(text).alias("size")), **shares).select(F.col("key").alias(key), "rate")
    rates = rates.withColumnRenamed("rate", n)
    df = join_sized(docs.withColumn(key, source_key(source)), rates, key)
    df = df.withColumn(n, copies(F.col(n), draw(doc_id, text, seed)))
    repeated = df.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
