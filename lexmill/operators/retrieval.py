"""Multi-path retrieval for a DataFrame of queries: BM25, sparse, dense, fusion, final top k, prompt context.

All operators are set-at-a-time. Scores are rounded to six places before ranking and ties go to the smaller id, so
ranks don't depend on the order of summation.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ENGLISH_TOKEN, english_tokens
from lexmill.storage import join_sized, materialize, spread

#: BM25 and fusion constants.
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
RRF_K = 60
EPS, FLOOR, FLOOR_FROM = 1e-6, 0.5, 0.85
PATHS = ("dense", "sparse", "bm25")


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, token, tf, length of each document's English words."""
    words = docs.select(F.col(doc_id).alias("doc_id"), english_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    exploded = words.select("doc_id", F.size("w").alias("length"), F.explode("w").alias("token"))
    return exploded.groupBy("doc_id", "length", "token").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps k rows a query and task before the shuffle."""
    best = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


@dataclass
class QueryBlock:
    """Some of the queries: ids, distinct words of all of them in order, and counts (words x queries)."""

    ids: list
    words: dict[str, int]
    counts: np.ndarray


def query_blocks(queries: DataFrame, query_id: str, text: str, max_bytes: int = 64 << 20) -> Iterator[QueryBlock]:
    """The queries by id, in blocks whose matrix of counts takes at most max_bytes (one query at least)."""
    ids: list = []
    words: dict[str, int] = {}
    entries: list[tuple[int, int, int]] = []

    def block() -> QueryBlock:
        counts = np.zeros((len(words), len(ids)))
        for word, q, n in entries:
            counts[word, q] = n
        return QueryBlock(ids, words, counts)

    for row in queries.select(F.col(query_id).alias("q"), english_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).orderBy("q").toLocalIterator():
        found = Counter(row["w"])
        if ids and 8 * (len(ids) + 1) * len(words.keys() | found.keys()) > max_bytes:
            yield block()
            ids, words, entries = [], {}, []
        for word, n in found.items():
            entries.append((words.setdefault(word, len(words)), len(ids), n))
        ids.append(row["q"])
    if ids:
        yield block()


TOKEN = re.compile(ENGLISH_TOKEN)


def postings(docs: DataFrame, block: QueryBlock, doc_id: str, text: str) -> DataFrame:
    """doc_id, length (all words), squares (sum of all words' squared counts), words and counts (the block's) of each
    document that has any of the block's words; materialised, as narrow as the queries' words are few. No shuffle."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            at, rows = [], []
            for i, said in enumerate(batch.column(1)):
                found = Counter(TOKEN.findall((said.as_py() or "").lower()))
                mine = sorted((numbers[w], n) for w, n in found.items() if w in numbers)
                if mine:
                    at.append(i)
                    rows.append((found.total(), sum(n * n for n in found.values()), [w for w, _ in mine], [n for _, n in mine]))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "length", "squares", "words", "counts"])

    return materialize(spread(docs.select(F.col(doc_id).alias("doc_id"), text)).mapInArrow(count, f"doc_id {kind}, length long, squares long, words array<int>, counts array<int>"), "postings")


def keep_best(scores: np.ndarray, docs: np.ndarray, best: list, k: int, skip: np.ndarray | None = None) -> None:
    """Merge scores (documents x queries, rounded) into best, a (scores, docs) pair a query: the k largest above zero,
    smaller ids first among equals. skip: a row a query, the id that doesn't count."""
    for q in range(scores.shape[1]):
        s, found = scores[:, q], best[q]
        if len(found[0]) == k:
            at = np.flatnonzero(s >= found[0][-1])
        else:
            at = np.flatnonzero(s > -np.inf)
        if skip is not None:
            at = at[docs[at] != skip[q]]
        if len(at) > k:
            at = at[s[at] >= np.partition(s[at], -k)[-k]]
        if len(at):
            both, ids = np.concatenate((found[0], s[at])), np.concatenate((found[1], docs[at]))
            order = np.lexsort((ids, -both))[:k]
            best[q] = (both[order], ids[order])


#: Documents scored at once.
ROWS = 512


def score_rows(block: QueryBlock, idf_: np.ndarray, lengths: np.ndarray, squares: np.ndarray, ends: np.ndarray, words: np.ndarray, counts: np.ndarray, path: str) -> np.ndarray:
    """Scores of one path (documents x queries), -inf where a document shares no word with a query. ends: where each
    document's words end."""
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(lengths)), sizes)
    table = np.zeros((len(lengths), len(block.words)))
    if path == "bm25":
        tf = counts.astype(float)
        table[row, words] = idf_[words] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.repeat(lengths, sizes) / AVERAGE_LENGTH)))
        out = table @ (block.counts > 0).astype(float)
        table[row, words] = 1
        shared = table @ (block.counts > 0).astype(float)
        return np.where(shared > 0, np.round(out, 6), -np.inf)
    table[row, words] = counts
    out = table @ block.counts
    if path == "sparse":
        return np.where(out > 0, out, -np.inf)
    norms = np.sqrt((block.counts**2).sum(0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(out > 0, np.round(out / (np.sqrt(squares)[:, None] * norms[None, :]), 6), -np.inf)


def lexical_hits(docs: DataFrame, queries: DataFrame, k: int = 10, paths: tuple[str, ...] = PATHS, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank, path, path_order: the k best documents of each query by each path.

    bm25 is Okapi's with idf from the corpus, sparse the inner product of word counts, dense their cosine (the stand-in
    where documents have no vectors). The corpus is tokenised once for all paths, into postings of the queries' words; each
    task multiplies its documents with the block of queries and hands on its k best a query, so no pair of a document and
    a query is shuffled but those. Queries come in blocks of a bounded size, each a pass over the corpus.
    """
    spark, out = docs.sparkSession, None
    ids, asked = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {asked}, doc_id {ids}, score double, path string, path_order int"
    for block in query_blocks(queries, query_id, text):
        found = postings(docs, block, doc_id, text)
        idf_ = np.zeros(len(block.words))
        if "bm25" in paths:
            n = docs.count()
            for r in found.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect():  # a row a word of the block
                idf_[r["w"]] = math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
        shared = spark.sparkContext.broadcast((block, idf_))
        best = found.mapInArrow(_scorer(shared, paths, k), schema)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id", "path").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scorer(shared, paths: tuple[str, ...], k: int):
    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idf_ = shared.value
        none = (np.empty(0), np.empty(0, object))
        best = {p: [none] * len(block.ids) for p in paths}
        kind = None
        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                docs = np.array(batch.column(0).to_pylist())
                lengths, squares = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                words, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
                ends = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
                for p in paths:
                    keep_best(score_rows(block, idf_, lengths, squares, ends, words, counts, p), docs, best[p], k)
        for order, p in enumerate(paths):
            for q, (scores, docs) in zip(block.ids, best[p], strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs)), pa.array(docs.tolist(), kind), pa.array(scores, pa.float64()), pa.array([p] * len(docs)), pa.array([order] * len(docs), pa.int32())], ["query_id", "doc_id", "score", "path", "path_order"])

    return best_of


def dense_hits(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", max_bytes: int = 64 << 20) -> DataFrame:
    """query_id, doc_id, score, rank: the k vectors with the largest inner product (unit vectors: the cosine, in doubles)
    with each query vector, itself left out.

    Query vectors are collected in blocks of at most max_bytes; each task multiplies its vectors with the block and hands
    on its k best a query, so the shuffle holds k rows a query and task.
    """
    spark, out = vectors.sparkSession, None
    ids, asked = vectors.schema[vec_id].dataType.simpleString(), queries.schema[vec_id].dataType.simpleString()

    def passes(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], float)))

        def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best, kind, asked_for = [(np.empty(0), np.empty(0, object))] * len(names), None, np.array(names)
            for whole in batches:
                kind = whole.schema.field(0).type
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    stored = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                    keep_best(np.round(stored @ matrix.T, 6), np.array(batch.column(0).to_pylist()), best, k, asked_for)
            for q, (scores, docs) in zip(names, best, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs)), pa.array(docs.tolist(), kind), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

        return vectors.filter(F.col(embedding).isNotNull()).select(vec_id, embedding).mapInArrow(best_of, f"query_id {asked}, doc_id {ids}, score double")

    block, size = [], 0
    for row in queries.filter(F.col(embedding).isNotNull()).select(vec_id, embedding).orderBy(vec_id).toLocalIterator():
        if block and size + 8 * len(row[1]) > max_bytes:
            out = passes(block) if out is None else out.unionByName(passes(block))
            block, size = [], 0
        block.append(tuple(row))
        size += 8 * len(row[1])
    if block:
        out = passes(block) if out is None else out.unionByName(passes(block))
    return top_k(out if out is not None else spark.createDataFrame([], f"query_id {asked}, doc_id {ids}, score double"), k)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds every phrase that isn't empty in one pass over a text."""
    made = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        if phrase:
            made.add_word(phrase, i)
    made.make_automaton()
    return made


def phrase_blocks(rows: DataFrame, max_bytes: int) -> Iterator[dict[str, list]]:
    """rows (name, phrase) in blocks of about max_bytes of text: the names of each phrase."""
    block: dict[str, list] = {}
    size = 0
    for name, phrase in rows.toLocalIterator():
        block.setdefault(phrase, []).append(name)
        size += len(phrase.encode())
        if size >= max_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def phrases_found(docs: DataFrame, phrases: dict[str, list], name_type: str, doc_id: str, text: str) -> DataFrame:
    """query_id, doc_id: names of the phrases that stand in each document; an empty one stands in all. Linear in the text."""
    kind, spark = docs.schema[doc_id].dataType.simpleString(), docs.sparkSession
    shared = spark.sparkContext.broadcast(phrases)
    name = spark.createDataFrame([], f"n {name_type}").toArrow().schema.field(0).type

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, owners, everywhere = automaton(list(shared.value)), list(shared.value.values()), shared.value.get("", [])
        for batch in batches:
            at, found = [], []
            for i, said in enumerate(batch.column(1)):
                if said.is_valid:
                    hits = {p for _, p in search.iter(said.as_py())} if len(search) else ()
                    mine = [n for p in hits for n in owners[p]] + everywhere
                    at += [i] * len(mine)
                    found += mine
            yield pa.RecordBatch.from_arrays([pa.array(found, name), batch.column(0).take(pa.array(at, pa.int64()))], ["query_id", "doc_id"])

    return spread(docs.select(F.col(doc_id).alias("doc_id"), text)).mapInArrow(find, f"query_id {name_type}, doc_id {kind}")


#: Words of a passage by which documents that may contain it are found.
KEY_WORDS = 5


def containing_pairs(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id", text: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """query_id, doc_id of the passages that stand in a document's text, character by character.

    A passage's words but its first and last stand whole in such a text, so passages and documents meet by the hash of
    KEY_WORDS of them, and only those that meet are compared. Shorter passages are searched for all at once by an automaton,
    in a pass over the documents for each max_bytes of them.
    """
    blank = r"\s+"
    items = passages.filter(F.col(text).isNotNull()).select(F.col(passage_id).alias("query_id"), F.col(text).alias("passage"))
    items = items.withColumn("w", F.array_remove(F.split("passage", blank), ""))
    long = items.filter(F.size("w") >= KEY_WORDS + 2).withColumn("key", F.xxhash64(*[F.get("w", i + 1) for i in range(KEY_WORDS)]))
    short = items.filter(F.size("w") < KEY_WORDS + 2).select("query_id", "passage")
    n = F.size("w")
    windows = F.when(n >= KEY_WORDS, F.transform(F.sequence(F.lit(0), n - KEY_WORDS), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(KEY_WORDS)])))
    words = spread(docs.select(doc_id, text)).select(doc_id, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), blank), "").alias("w"))
    keys = materialize(long.select("query_id", "key"), "passage-keys")
    wanted = materialize(keys.select("key").distinct(), "keys")
    met = join_sized(words.select(doc_id, F.explode(F.array_distinct(windows)).alias("key")), wanted, "key", "left_semi")
    pairs = materialize(met.join(keys, "key").select("query_id", doc_id).distinct(), "met")
    met_docs = join_sized(docs.select(doc_id, text), materialize(pairs.select(doc_id).distinct(), "met-docs"), doc_id, "left_semi")
    found = met_docs.join(pairs, doc_id).join(long.select("query_id", "passage"), "query_id").filter(F.contains(F.col(text), F.col("passage")))
    found = found.select("query_id", doc_id)
    for phrases in phrase_blocks(short, max_bytes):
        less = phrases_found(docs, phrases, passages.schema[passage_id].dataType.simpleString(), doc_id, text)
        found = found.unionByName(less.select("query_id", F.col("doc_id").alias(doc_id)))
    return found.select("query_id", F.col(doc_id).alias("doc_id"))


#: How much of a query keywords are taken from, and how many select documents.
KEYWORD_CHARS, KEYWORDS = 100, 5


@dataclass
class KeywordBlock:
    """Some of the queries: ids, distinct keywords, how often each query has each (words x queries), and which are its first."""

    ids: list
    words: list[str]
    counts: np.ndarray
    first: np.ndarray


def keyword_blocks(queries: DataFrame, query_id: str, text: str, max_bytes: int) -> Iterator[KeywordBlock]:
    """The queries by id in blocks whose matrices take at most max_bytes each (one query at least)."""
    ids, words, entries = [], {}, []

    def block() -> KeywordBlock:
        counts, first = np.zeros((len(words), len(ids))), np.zeros((len(words), len(ids)))
        for q, said in enumerate(entries):
            for place, word in enumerate(said):
                counts[words[word], q] += 1
                first[words[word], q] += place < KEYWORDS
        return KeywordBlock(ids, list(words), counts, first)

    split = F.array_remove(F.split(F.left(F.col(text), F.lit(KEYWORD_CHARS)), r"\s+"), "")
    for row in queries.filter(F.col(text).isNotNull()).select(F.col(query_id).alias("q"), split.alias("w")).filter(F.size("w") > 0).orderBy("q").toLocalIterator():
        if ids and 8 * (len(ids) + 1) * len(words.keys() | set(row["w"])) > max_bytes:
            yield block()
            ids, words, entries = [], {}, []
        for word in row["w"]:
            words.setdefault(word, len(words))
        ids.append(row["q"])
        entries.append(row["w"])
    if ids:
        yield block()


def keyword_hits(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", query_id: str = "item_id", text: str = "text", max_bytes: int = 64 << 20) -> DataFrame:
    """query_id, doc_id, score, rank: documents that contain one of a query's first keywords, by the share of all its
    keywords that they contain. Each task searches a text for all keywords of a block of queries at once, by an automaton,
    and hands on its k best a query; no pair of a document and a query is formed but those."""
    spark, out = docs.sparkSession, None
    ids, asked = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {asked}, doc_id {ids}, score double"
    for block in keyword_blocks(queries, query_id, text, max_bytes):
        shared = spark.sparkContext.broadcast(block)
        best = spread(docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), text)).mapInArrow(_keyword_scorer(shared, k), schema)
        out = best if out is None else out.unionByName(best)
    return top_k(out if out is not None else spark.createDataFrame([], schema), k)


def _keyword_scorer(shared, k: int):
    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        search, size = automaton(block.words), block.counts.sum(axis=0)
        best, kind = [(np.empty(0), np.empty(0, object))] * len(block.ids), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = np.zeros((batch.num_rows, len(block.words)))
                for i, said in enumerate(batch.column(1)):
                    found[i, list({p for _, p in search.iter(said.as_py())})] = 1
                scores = np.where(found @ block.first > 0, np.round(found @ block.counts / size, 6), -np.inf)
                keep_best(scores, np.array(batch.column(0).to_pylist()), best, k)
        for q, (scores, docs) in zip(block.ids, best, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs)), pa.array(docs.tolist(), kind), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

    return best_of


def named_paths(**paths: DataFrame) -> DataFrame:
    """Union of hit lists (query_id, doc_id, score, rank) with the path's name and order."""
    out = None
    for order, (name, df) in enumerate(paths.items()):
        part = df.select("query_id", "doc_id", "score", "rank", F.lit(name).alias("path"), F.lit(order).alias("path_order"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(paths: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score, n_paths: sum of 1 / (k + rank)."""
    return paths.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.count("*").alias("n_paths"))


def first_found(paths: DataFrame) -> DataFrame:
    """query_id, doc_id, first_path, first_rank: each hit once, in the order of paths, then ranks."""
    first = F.min(F.struct("path_order", "rank", "path"))
    return paths.groupBy("query_id", "doc_id").agg(first.alias("f")).select("query_id", "doc_id", F.col("f.path").alias("first_path"), F.col("f.rank").alias("first_rank"))


def minmax(paths: DataFrame) -> DataFrame:
    """paths with norm: the score scaled within its query and path; a lone hit gets 0."""
    w = Window.partitionBy("query_id", "path")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return paths.withColumn("norm", (F.col("score") - low) / (high - low + F.lit(EPS)))


def fuse(paths: DataFrame, specificity: DataFrame) -> DataFrame:
    """query_id, doc_id, a norm a path, score: (1 - S) dense + S (sparse + bm25) / 2, at least FLOOR where dense is strong.

    A path that didn't find a document counts 0. specificity: query_id, s.
    """
    norm = [F.coalesce(F.max(F.when(F.col("path") == p, F.col("norm"))), F.lit(0.0)).alias(p) for p in PATHS]
    wide = minmax(paths).groupBy("query_id", "doc_id").agg(*norm)
    s, lexical = F.col("s"), F.lit(0.5) * F.col("sparse") + F.lit(0.5) * F.col("bm25")
    mixed = (1 - s) * F.col("dense") + s * lexical
    floored = F.when(F.col("dense") > FLOOR_FROM, F.greatest(mixed, F.lit(FLOOR))).otherwise(mixed)
    return wide.join(specificity, "query_id").select("query_id", "doc_id", *[F.round(p, 6).alias(p) for p in PATHS], F.round(floored, 6).alias("score"))


def funnel(paths: DataFrame, specificity: DataFrame, coarse: int = 10, final: int = 3, reranked: DataFrame | None = None) -> DataFrame:
    """The final rows of each query. reranked (query_id, doc_id, relevance) orders the coarse ones; without it they stay as they are."""
    best = top_k(fuse(paths, specificity), coarse)
    if reranked is None:
        return best.filter(F.col("rank") <= final)
    joined = best.withColumnRenamed("rank", "coarse_rank").join(reranked, ["query_id", "doc_id"], "left")
    any_scored = F.count("relevance").over(Window.partitionBy("query_id")) > 0
    joined = joined.withColumn("order", F.when(any_scored, F.col("relevance")).otherwise(-F.col("coarse_rank"))).filter(F.col("order").isNotNull())
    return top_k(joined, final, score="order").drop("order", "relevance")


def context(hits: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """query_id, context: the hits' texts by rank, each under its rank and source."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] src:"), F.col(source), F.lit("\n"), F.col(text))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n")
    return hits.groupBy("query_id").agg(F.when(F.count("*") > 0, joined).otherwise("(empty)").alias("context"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents, vocabulary, tokens, mean length, and the constant that weights use instead of it."""
    words = docs.select(F.explode(english_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    sizes = words.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return sizes.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs")))).select("n_docs", "vocabulary_size", "n_tokens", F.round(F.col("n_tokens") / F.col("n_docs"), 6).alias("mean_length"), F.lit(AVERAGE_LENGTH).alias("average_document_length"))
