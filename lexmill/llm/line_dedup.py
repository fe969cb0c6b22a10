"""Line deduplication across documents.

A line's key is the line with white space stripped at both ends and A-Z in lower case. Keys of `min_chars` code points
or more that stand in `min_docs` documents or more lose all their lines except in the document of the largest id.

Method: (two 64-bit hashes, document, place) of the keyed lines are range-partitioned by hash and sorted by document
and place within each range; a window streams over each key and tells the first document from later ones. The result is
a compressed keep bitmap a document: a map from word number to 64 keep bits, absent where all 64 lines stay.

Hot keys: a frequent-items sketch names the (at most `hot_items`) hashes that would fill half a partition or more. Their
lines don't enter the ranges: distinct documents are counted in two combining steps and the decisions, at most as many
rows as hot hashes were named (hash pairs aside), are broadcast. Both ways give the same decisions.

Edge cases: a null or empty text is one empty line; null ids count as one document below all others; repeated rows of
one id and text share a bitmap, rows of one id with different texts have one each and count as one document.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import BLANKS, lower_ascii, row_id, whole_text
from lexmill.storage import fresh, materialize, partitions

KEY = ["h1", "h2"]


def line_rows(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """h1, h2, did, th (hash of the whole text), pos of every line whose key is long enough."""
    df = docs.select(row_id(doc_id).alias("did"), whole_text(text).alias("t"))
    df = df.select("did", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    df = df.select("did", "th", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key")).filter(F.length("key") >= min_chars)
    return df.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "did", "th", "pos")


def hot_hashes(rows: DataFrame, parts: int, hot_items: int = 1000) -> list[int]:
    """The h1 of keys that would fill half a partition or more; a list of at most hot_items."""
    found = rows.agg(F.expr(f"approx_top_k(h1, {hot_items}, {8 * hot_items})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in found["top"] or [] if 2 * parts * x["count"] > found["n"]]


def dropped_lines(rows: DataFrame, min_docs: int, hot_items: int = 1000) -> DataFrame:
    """did, th, pos of the lines that go. rows: as from line_rows, materialised."""
    parts = partitions(rows.sparkSession)
    hot = hot_hashes(rows, parts, hot_items)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    ranged = rows.filter(~is_hot).repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY, F.col("did").desc(), "pos")
    by_key = Window.partitionBy(*KEY)
    rank = F.dense_rank().over(by_key.orderBy(F.col("did").desc()))  # met by the range sort: no other exchange or sort
    least = F.min("did").over(by_key)
    # the n-th document of a key proves n documents; for earlier ones the smallest id tells whether more follow
    if min_docs == 3:
        more = (F.col("rank") >= 3) | (F.col("least") < F.col("did"))
    else:
        more = F.max("rank").over(by_key) >= min_docs
    gone = ranged.withColumn("rank", rank).withColumn("least", least).withColumn("more", more).filter((F.col("rank") >= 2) & F.col("more")).select("did", "th", "pos")
    if not hot:
        return gone
    held = rows.filter(is_hot)
    decided = held.groupBy(*KEY, "did").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("did").alias("last")).filter(F.col("n") >= min_docs)
    return gone.unionByName(held.join(F.broadcast(decided), KEY).filter(F.col("did") < F.col("last")).select("did", "th", "pos"))


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3, hot_items: int = 1000) -> DataFrame:
    """did, th, keep map<int,bigint>, n_dropped for each text that loses lines."""
    rows = materialize(line_rows(docs, text, doc_id, min_chars), "lines")
    gone = dropped_lines(rows, min_docs, hot_items)
    # repeated rows give the same line more than once, and or-ing is indifferent to that
    by_word = gone.groupBy("did", "th", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone"))
    return by_word.groupBy("did", "th").agg(F.map_from_entries(F.collect_list(entry)).alias("keep"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lines: str | None = None, dropped: str | None = None, **limits) -> DataFrame:
    """docs with the kept lines as text; lines and dropped, where named, get the counts before and of the drop."""
    did, th, keep, n = (fresh(docs.columns, x) for x in ("_did", "_th", "_keep", "_n"))
    maps = keep_bitmaps(docs, text, doc_id, **limits).toDF(did, th, keep, n)
    df = docs.withColumn(did, row_id(doc_id)).withColumn(th, F.xxhash64(whole_text(text))).join(maps, [did, th], "left")
    parts = F.split(whole_text(text), "\n")
    bits = lambda i: F.coalesce(F.try_element_at(F.col(keep), F.shiftright(i, 6)), F.lit(-1).cast("long"))
    stays = lambda _, i: F.getbit(bits(i), i.bitwiseAND(F.lit(63))) == 1
    left = F.when(F.col(keep).isNull(), whole_text(text)).otherwise(F.array_join(F.filter(parts, stays), "\n"))
    added = ([F.size(parts).cast("long").alias(lines)] if lines else []) + ([F.coalesce(n, F.lit(0)).cast("long").alias(dropped)] if dropped else [])
    return df.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *added)
