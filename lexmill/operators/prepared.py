"""Checks of a prepared corpus before it is published: source metadata, articles and their chunks, vectors, public payloads."""

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.functions.ids import text_sha256
from lexmill.operators.governance import errors, protected
from lexmill.storage import join_sized, materialize

#: What a source's metadata must say, and prefixes of collections that no ingest may touch.
IN_FORCE, LEVEL, STATUS_CODE = "有效", "A", 3
PROTECTED = ("rag_chunks", "watsonx_docsqa")
DATE = r"^\d{4}-\d{2}-\d{2}$"
#: Fixed value: the most a token id may be.
MAX_TOKEN = 30_000


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def inside(path: Column) -> Column:
    """Whether a relative path stays in its folder."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def source_errors(collection: str) -> Column:
    """Names of what is wrong with a source's metadata row: doc_id, title, source_level, target_collection, status,
    effective_date, official_url, raw_file, markdown_file, the two files' stated hashes and the ones found."""
    c = F.col
    return errors(
        missing_id=blank(c("doc_id").cast("string")), missing_title=blank(c("title")), level_not_a=c("source_level") != LEVEL, wrong_collection=c("target_collection") != collection, not_in_force=c("status") != IN_FORCE,
        bad_date=~c("effective_date").rlike(DATE), not_https=~c("official_url").startswith("https://"), missing_file=blank(c("raw_file")) | blank(c("markdown_file")), outside_folder=~inside(c("raw_file")) | ~inside(c("markdown_file")),
        raw_hash_differs=c("raw_sha256") != c("raw_found"), markdown_hash_differs=c("markdown_sha256") != c("markdown_found"),
    )


def activation_errors(collection: str, url_prefix: str) -> Column:
    """Names of what keeps a metadata row from being activated."""
    c = F.col
    return errors(
        protected_collection=protected(F.lit(collection), PROTECTED), wrong_collection=c("target_collection") != collection, level_not_a=c("source_level") != LEVEL, not_official=~F.coalesce(c("official_url"), F.lit("")).startswith(url_prefix),
        wrong_status_code=c("status_code") != STATUS_CODE, not_in_force=c("status") != IN_FORCE, bad_date=~F.coalesce(c("effective_date"), F.lit("")).rlike(DATE),
    )


def activated(df: DataFrame, by: str, at: str, passed: Column) -> DataFrame:
    """df with the audit columns of an activation; rows that didn't pass stay pending."""
    return df.withColumns({"activation_status": F.when(passed, "ACTIVE").otherwise("PENDING"), "activated_by": F.when(passed, F.lit(by)), "activated_at": F.when(passed, F.lit(at))})


def article_errors(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """article_id, errors of each article: missing parts, a repeated id, chunks missing, miscounted or not numbered 0..n-1.

    articles: article_id, text, sha256, chunk_count; chunks: article_id, chunk_index, chunk_count. Numbers are contiguous
    if there are as many different ones as chunks, from 0 to that count less 1, so no list of them is gathered. Texts are
    measured and hashed before they are grouped, so none is shuffled.
    """
    by_id = articles.groupBy("article_id").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("size"), F.min(text_sha256(F.col("text"))).alias("found"), F.min("sha256").alias("sha256"), F.min("chunk_count").alias("chunk_count"))
    held = chunks.groupBy("article_id", "chunk_index").agg(F.count("*").alias("same"), F.min("chunk_count").alias("lo"), F.max("chunk_count").alias("hi"))
    held = held.groupBy("article_id").agg(F.sum("same").alias("n_chunks"), F.count("*").alias("n_numbers"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    c, n = F.col, F.coalesce("n_chunks", F.lit(0))
    found = errors(
        missing_id=c("article_id").isNull(), repeated_id=c("n") > 1, missing_text=c("size").isNull() | (c("size") == 0), hash_differs=c("sha256") != c("found"), no_chunks=n == 0, wrong_count=c("chunk_count") != n,
        not_contiguous=(n > 0) & ((c("n_numbers") != n) | (c("first") != 0) | (c("last") != n - 1)), count_differs=(n > 0) & ((c("lo") != c("chunk_count")) | (c("hi") != c("chunk_count"))),
    )
    return by_id.join(held, "article_id", "left").select("article_id", found.alias("errors"))


def chunk_errors(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """article_id, chunk_index, errors of each chunk: its article, its place in it, its words and their hash.

    chunks: article_id, chunk_index, point_id, article_sha256, start, end, excerpt, excerpt_sha256, chunk_text. What a chunk
    says by itself is checked first and written with the digest of its excerpt, which is compared with the digest of its
    place; so of texts only the articles' are shuffled, once.
    """
    c, known, digest = F.col, F.coalesce("_known", F.lit(False)), lambda x: F.unhex(text_sha256(x))
    span = (c("start") >= 0) & (c("start") < c("end"))
    alone = {"bad_span": ~span, "hash_differs": c("excerpt_sha256") != text_sha256(c("excerpt")), "blank_text": blank(F.trim("chunk_text"))}
    marks = chunks.select("article_id", "chunk_index", "point_id", "article_sha256", "start", "end", digest(c("excerpt")).alias("_excerpt"), *[x.alias(f"_{name}") for name, x in alone.items()])
    marks = materialize(marks, "chunk-marks")
    repeated = materialize(marks.groupBy("point_id").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated-points")
    texts = articles.dropDuplicates(["article_id"]).select("article_id", F.col("text").alias("_text"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_known"))
    df = join_sized(marks, repeated, "point_id").join(texts, "article_id", "left")
    fits = span & (c("end") <= F.length("_text"))
    found = errors(
        missing_point=blank(c("point_id")), repeated_point=c("_n").isNotNull(), unknown_article=~known, other_article=known & (c("article_sha256") != c("_sha256")), bad_span=c("_bad_span"),
        beyond_article=known & span & ~fits, excerpt_differs=known & fits & (c("_excerpt") != digest(F.substr("_text", c("start") + 1, c("end") - c("start")))), hash_differs=c("_hash_differs"), blank_text=c("_blank_text"),
    )
    return df.select("article_id", "chunk_index", found.alias("errors"))


def vector_errors(vector: Column, dimension: int, sparse: Column | None = None) -> Column:
    """Names of what is wrong with a dense vector and, where given, a map from token id to weight."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checks = {"missing_vector": vector.isNull(), "wrong_dimension": F.size(vector) != dimension, "not_finite": ~finite, "zero_vector": ~F.exists(vector, lambda x: x != 0)}
    if sparse is not None:
        checks |= {"no_sparse": F.size(sparse) < 1, "bad_token": ~F.forall(F.map_keys(sparse), lambda k: (k >= 0) & (k < MAX_TOKEN)), "bad_weight": ~F.forall(F.map_values(sparse), lambda w: ~F.isnan(w) & (w > 0) & (w < float("inf")))}
    return errors(**checks)


def archive_summary(rows: DataFrame, record_id: str, doc: str, n_terms: Column) -> DataFrame:
    """One row: records, documents, repeated ids, least and most terms of a record."""
    by_id = rows.groupBy(record_id).agg(F.count("*").alias("n"), F.min(n_terms).alias("lo"), F.max(n_terms).alias("hi"))
    docs = rows.agg(F.count_distinct(doc).alias("documents"))
    return by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.min("lo").alias("min_terms"), F.max("hi").alias("max_terms")).crossJoin(F.broadcast(docs))


def normalised(vector: Column) -> Column:
    """A vector by its Euclidean length; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(size > 0, x / size).otherwise(x))


#: What JSON texts are made of; anything else is no JSON.
JSON_PART = re.compile(r'[ \t\n\r]*(?:(?P<mark>[{}\[\]:,])|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<bare>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.ASCII)


def key_paths(text: str, names: frozenset[str]) -> list[str] | None:
    """Paths of the keys among the names, in the text's order, or None if the text is no JSON. What is open is a list of
    frames, so any depth is read in one pass."""
    found, at, end = [], 0, len(text.rstrip(" \t\n\r"))
    open_: list[list] = []  # of each open object or array: its mark, what is expected next, key or number, length of its path
    path, want = ["$"], "value"
    while at < end:
        m = JSON_PART.match(text, at)
        if not m:
            return None
        at, mark, said = m.end(), m["mark"], m["text"]
        if mark in ("]", "}"):
            if not open_ or open_[-1][0] != mark or want not in ("next", "first"):
                return None
            open_.pop()
            want = "next"
        elif want == "next":
            if mark != "," or not open_:
                return None
            if open_[-1][0] == "]":
                open_[-1][1] += 1
                path[len(open_)] = f"[{open_[-1][1]}]"
            want = "key" if open_[-1][0] == "}" else "value"
            continue
        elif want == "key" or want == "first" and open_[-1][0] == "}":
            if said is None:
                return None
            key = json.loads(said)
            path[len(open_)] = f".{key}"
            if key in names:
                found.append("".join(path[: len(open_) + 1]))
            want = "colon"
        elif want == "colon":
            if mark != ":":
                return None
            want = "value"
        elif mark in ("{", "["):
            open_.append(["}" if mark == "{" else "]", 0])
            del path[len(open_) :]
            path.append("[0]")
            want = "first"
        elif mark:
            return None
        else:
            want = "next"
        if want == "next" and not open_ and at < end:
            return None
    return found if want == "next" and not open_ else None


def private_key_paths(names: tuple[str, ...]):
    """Column function: the paths ($.a.b[0]) of all keys of the JSON text that are among the names, at any depth, in the
    text's order; none for a text that is no JSON."""
    wanted = frozenset(names)

    @F.arrow_udf("array<string>")
    def paths(texts: pa.Array) -> pa.Array:
        return pa.array([key_paths(x.as_py() or "", wanted) or [] for x in texts], pa.list_(pa.string()))

    return paths


def payload_errors(payload: Column, names: tuple[str, ...], sentinels: tuple[str, ...]) -> Column:
    """Names of the private parts of a public payload: keys at any depth, and sentinels anywhere in its text."""
    return errors(private_keys=F.size(private_key_paths(names)(payload)) > 0, **{f"sentinel_{i + 1}": payload.contains(s) for i, s in enumerate(sentinels) if s})


@F.arrow_udf(LongType())
def token_id(tokens: pa.Array) -> pa.Array:
    """Stable unsigned 32-bit id of a token: the first four bytes of its BLAKE2s digest of that size, big-endian."""
    from hashlib import blake2s

    return pa.array([None if (t := x.as_py()) is None else int.from_bytes(blake2s(t.encode(), digest_size=4).digest(), "big") for x in tokens], pa.int64())


def collisions(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """One row: words, ids, and words that share their id with another one. vocabulary: a row a word."""
    by_id = vocabulary.select(token_id(token).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count("*").alias("ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))


def rebuilt(points: DataFrame, drop: list[str], vectors: dict[str, Column]) -> DataFrame:
    """A collection's rows for its next version: legacy columns dropped, vectors added; write it to a new place."""
    return points.drop(*drop).withColumns(vectors)
