"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors of one label and dimension that are equal bit by bit form a class, of which one vector is compared. A normalised
vector's projections on random Gaussian directions, shifted and cut into steps of `width`, give its hashes; `hashes` of
them make a bucket, and it has a bucket in each of several tables. Vectors that share a bucket are compared by their exact
cosine in double precision. Two unit vectors at distance d agree in one hash with the known probability agree(d, width):
the number of hashes is what leaves about `room` unrelated vectors of the largest label in a bucket, and the number of
tables is what misses a pair at the threshold with probability `miss` (closer pairs far less often). So recall is the
same at every size, and comparisons a vector grow with a small power (about 0.24) of the label's size.

Buckets are dealt in cells of about equal numbers of entries, one group of the shuffle each; a bucket of more than `chunk`
vectors is dealt in chunks, and each pair of chunks is an entry of its own, so no bucket is capped and none meets in one
task. A pair counts in the first table that it shares, which its hashes tell, so tables needn't be reconciled. Groups
return sums of links by class and a spanning forest, never pairs. Only hashes of large buckets are joined back.

Edge cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, links with
nothing; vectors of different dimensions don't link; a null id ranks above all others and is kept unless it links to a
known one; rows with repeated ids get a row each; extra columns aren't read; an empty table gives an empty result.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.storage import join_sized, materialize

NO_ID = 2**63 - 1
UNRELATED = math.sqrt(2)


def agree(distance: float, width: float) -> float:
    """The probability that two vectors at a distance have equal p-stable hashes (Datar et al., 2004)."""
    u = width / distance
    return math.erf(u / math.sqrt(2)) - math.sqrt(2 / math.pi) / u * (1 - math.exp(-u * u / 2))


def shape(n: int, threshold: float, width: float, room: int, miss: float) -> tuple[int, int]:
    """Hashes a bucket and tables for n vectors of a label."""
    near, far = agree(math.sqrt(2 - 2 * threshold), width), agree(UNRELATED, width)
    hashes = max(2, math.ceil(math.log(max(n, 1) / room) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log1p(-(near**hashes)))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def with_class(rows: DataFrame, embedding: str, label: str, vec_id: str) -> DataFrame:
    """did (the id, or NO_ID), made: cls (digest of label and components) and vec (their bytes), both null if nothing can link."""
    kind = "float" if rows.schema[embedding].dataType.elementType.typeName() == "float" else "double"
    scalar = np.float32 if kind == "float" else np.float64

    @F.arrow_udf("struct<cls:binary,vec:binary>")
    def make(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        cls, vec = [], []
        for x, at in zip(vectors, labels, strict=True):
            v = None
            if x.is_valid and at.is_valid and len(x.values) and not x.values.null_count:
                v = x.values.to_numpy(zero_copy_only=False).astype(scalar) + scalar(0)  # the sum makes -0.0 a 0.0
                v = v.tobytes() if np.isfinite(v).all() and v.any() else None
            vec.append(v)
            cls.append(v and xxhash.xxh3_128_digest(v + f"{len(v)}:{at.as_py()}".encode()))
        return pa.StructArray.from_arrays([pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], ["cls", "vec"])

    key = F.col(label).cast("string")
    return rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("did"), key.alias("label"), make(F.col(embedding).cast(f"array<{kind}>"), key).alias("made")), scalar


def with_buckets(classes: DataFrame, scalar: type, hashes: int, tables: int, width: float, seed: int) -> DataFrame:
    """classes with keys: a number for each table's bucket, which label, dimension and table are part of."""

    @F.arrow_udf("array<long>")
    def make(vecs: pa.Array, labels: pa.Array) -> pa.Array:
        out: list = [None] * len(vecs)
        sizes: dict[int, list[int]] = {}
        for i, x in enumerate(vecs):
            sizes.setdefault(len(x.as_buffer()) // scalar().itemsize, []).append(i)
        for dim, at in sizes.items():
            rng = np.random.default_rng([seed, dim])
            direction, shift = rng.standard_normal((dim, hashes * tables)), rng.uniform(0, width, hashes * tables)
            for some in (at[i : i + 1024] for i in range(0, len(at), 1024)):
                v = units(np.stack([np.frombuffer(vecs[i].as_buffer(), scalar) for i in some]))
                steps = np.floor((v @ direction + shift) / width).astype(np.int32).reshape(len(some), tables, hashes)
                for i, row in zip(some, steps, strict=True):
                    of = f"{dim}:{labels[i].as_py()}".encode()
                    out[i] = [xxhash.xxh64_intdigest(row[t].tobytes() + of, t) - 2**63 for t in range(tables)]
        return pa.array(out, pa.list_(pa.int64()))

    return classes.withColumn("keys", make("vec", "label"))


def _linked(left: np.ndarray, right: np.ndarray, threshold: float, same: bool, keys: np.ndarray, at: tuple[np.ndarray, np.ndarray], key: int):
    """For each row of left with links: its number, and those of right that it links with and meets here first."""
    for i in range(0, len(left), 128):
        near = left[i : i + 128] @ right.T >= threshold
        if same:
            near = np.triu(near, i + 1)
        r, c = np.nonzero(near)
        if len(r):
            mine, other = keys[at[0][r + i]], keys[at[1][c]]
            here = mine[np.arange(len(r)), (mine == other).argmax(axis=1)] == key
            r, c = r[here] + i, c[here]
        if len(r):
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            yield from zip(r[starts].tolist(), np.split(c, starts[1:]), strict=True)


def compare(pdf: pd.DataFrame, threshold: float, scalar: type) -> pd.DataFrame:
    """Of the buckets of a cell: a row a class with the number of its links (b null), and a spanning forest of them (links 0)."""
    out: list[tuple] = []
    did, cls, n, vec, held = (pdf[c].tolist() for c in ("did", "cls", "n", "vec", "keys"))
    for (key, i, j), rows in pdf.groupby(["key", "i", "j"], sort=False).indices.items():
        if len(rows) < 2:
            continue
        v, chunk = units(np.stack([np.frombuffer(vec[r], scalar) for r in rows])), pdf["chunk"].to_numpy()[rows]
        keys, times = np.array([held[r] for r in rows], np.int64), np.array([n[r] for r in rows], np.int64)
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        root, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for x, near in _linked(v[left], v[right], threshold, i == j, keys, (left, right), key):
            x, near = int(left[x]), right[near]
            links[x] += times[near].sum()
            links[near] += times[x]
            others, first = np.unique(root[near], return_index=True)
            for o, y in zip(others.tolist(), near[first].tolist(), strict=True):
                if o != root[x]:
                    out.append((did[rows[x]], cls[rows[x]], did[rows[y]], cls[rows[y]], 0))
                    root[root == o] = root[x]
        out += [(did[rows[x]], cls[rows[x]], None, None, int(links[x])) for x in np.flatnonzero(links)]
    return pd.DataFrame(out, columns=["a_did", "a_cls", "b_did", "b_cls", "links"], dtype="object")


def bucket_links(hashed: DataFrame, scalar: type, threshold: float, chunk: int = 1024, cell: int = 4096) -> DataFrame:
    """What compare returns, for all buckets. hashed: did, cls, n, vec, keys of each class."""
    large = materialize(hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > chunk), "large-buckets")
    entries = join_sized(hashed.select("did", "cls", "n", "vec", "keys", F.explode("keys").alias("key")), large, "key")
    parts = F.coalesce(F.ceil(F.col("held") / chunk), F.lit(1)).cast("int")
    dealt = entries.withColumn("chunk", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "did", "cls", "n", "vec", "keys")
    more = large.agg(F.sum(F.col("held") * (F.ceil(F.col("held") / chunk) - 1))).first()[0] or 0
    total = (hashed.agg(F.sum(F.size("keys"))).first()[0] or 0) + more
    cells = dealt.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-total // cell)))).alias("cell"))
    return cells.applyInPandas(lambda pdf: compare(pdf, threshold, scalar), "a_did long, a_cls binary, b_did long, b_cls binary, links long")


def near_embeddings(rows: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", threshold: float = 0.93, width: float = 1.5, room: int = 512, miss: float = 1e-4, seed: int = 13, **limits) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: how many other rows it links with, the smallest id that links reach,
    and whether that is its own."""
    made, scalar = with_class(rows, embedding, label, vec_id)
    made = materialize(made.select("did", "label", "made.*"), "vectors")
    best = made.filter("cls is not null").groupBy("cls").agg(F.min("did").alias("did"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = materialize(best, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashed = materialize(with_buckets(classes, scalar, *shape(most, threshold, width, room, miss), width, seed), "hashed")
    found = materialize(bucket_links(hashed, scalar, threshold, **limits), "links")
    counts = found.filter("b_cls is null").groupBy(F.col("a_cls").alias("cls")).agg(F.sum("links").alias("links"))
    links = found.filter("b_cls is not null").select(*[F.struct(F.col(f"{k}_did").alias("did"), F.col(f"{k}_cls").alias("cls")).alias(k) for k in "ab"])
    roots = components(links).select(F.col("node.cls").alias("cls"), F.col("root.did").alias("component"))
    named = classes.select("cls", "did", "n").join(counts, "cls", "left").join(roots, "cls", "left")
    # written first, so that both sides of the next join are plain shuffles and AQE splits a hot class's rows
    named = materialize(named.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "did").alias("component")), "named")
    linked = made.filter("cls is not null").select("did", "cls").join(named, "cls").select("did", "n_links", "component")
    alone = made.filter("cls is null").select("did", F.lit(0).cast("long").alias("n_links"), F.col("did").alias("component"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(known("did").alias("vec_id"), "n_links", known("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))
