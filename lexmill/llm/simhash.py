"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints (64-bit majority of the XXH64 of word shingles) are made in Arrow batches. A row a distinct fingerprint then
stands for all its documents. Fingerprints are split into `blocks` blocks; two that differ in at most `max_bits` bits
agree in some choice of blocks - max_bits of them, so they meet in the bucket of that choice. Buckets of at most
`small` fingerprints join in the JVM and keep pairs at the Hamming distance; larger ones are dealt in chunks, and each
pair of chunks returns a spanning forest of its links (found by comparing whole blocks of fingerprints), not the pairs.
So no bucket is capped, none meets in one task, and all components are exact.

Three of six blocks are 32 bits: random buckets stay small up to billions of distinct fingerprints.

Similarity. A few of 64 bits are far from a Jaccard similarity of 0.8, at which a seventh of the bits differs; blocks that
such pairs must share would be six bits wide. Given a `similarity`, the fingerprint therefore is 256 bits wide, over
distinct shingles, and its blocks are hashes of a sample of the shingles instead of a stretch of the bits: a block has the
least shingle under each of `SAMPLED` orders that all documents share, so two documents agree in it with probability
similarity ** SAMPLED, in one of `SAMPLES` blocks almost surely (0.998 at 0.8), and unrelated ones hardly ever, whatever
the corpus's size. Pairs that share a block and are near by fingerprint are then compared by the sets of their shingles
themselves, and only those of at least the similarity link; the fingerprint lets all but about one in a thousand of them
through. A text whose shingles equal another's is the same node. While a text is judged, a list of its words and of its
shingles' hashes is held, some tens of bytes a word.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; a null id ranks above all others; repeated rows get a row each. Links and components are of fingerprints, never
of ids, so different texts with null or repeated ids have nothing to do with each other. Extra columns are passed through
by keep_first, whatever their names.
"""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.text import one_by_one, whole_text
from lexmill.storage import fresh, join_sized, materialize

NO_ID = 2**63 - 1
PIECE = 4 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint; the text is cut into pieces at white space, so memory stays bounded."""
    low, at, carry, ones, n = text, 0, [], np.zeros(64, np.int64), 0
    while at < len(low) or not at:
        end = min(at + PIECE, len(low))
        while end < len(low) and not low[end : end + 1].isspace():
            end += 1
        words = carry + low[at:end].lower().split()
        at = max(end, at + 1)
        if len(words) < shingle and at < len(low):
            carry = words
            continue
        k = shingle if n or len(words) >= shingle else len(words)
        if k and len(words) >= k:
            ends = np.cumsum([len(w) + 1 for w in words])
            joined, starts = b" ".join(words), np.concatenate(([0], ends[:-1]))
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
            for i in range(0, len(hashes), 1 << 16):
                bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True) if n else 0


WIDE, SAMPLES, SAMPLED = 4, 12, 4
#: Odd multipliers: four that spread a hash over the wide fingerprint, and one for each order of shingles.
ODD = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(WIDE + SAMPLES * SAMPLED)], np.uint64)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, eight bytes a word."""
    words = text.lower().split()
    k = min(shingle, len(words))
    if not k:
        return np.empty(0, np.uint64)
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[k:], at]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)), np.uint64, len(words) - k + 1))


def wide_fingerprint(text: bytes, shingle: int = 5) -> tuple[list[int], list[int], bytes]:
    """WIDE signed words of the fingerprint, the hashes of its SAMPLES blocks, and a digest of all shingles."""
    found = hashes(text, shingle)
    sig = xxhash.xxh3_128_digest(found.tobytes())
    if not len(found):
        return [0] * WIDE, [0], sig
    ones, least = np.zeros(64 * WIDE, np.int64), np.full(SAMPLES * SAMPLED, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1 << 13):
        some = found[i : i + (1 << 13), None] * ODD[None, :]
        spread = some[:, :WIDE] ^ (some[:, :WIDE] >> np.uint64(32))
        ones += np.unpackbits((spread * ODD[1]).astype(">u8").view(np.uint8).reshape(-1, 8 * WIDE), axis=1).sum(axis=0, dtype=np.int32)
        np.minimum(least, some[:, WIDE:].min(axis=0), out=least)
    bits = np.packbits(2 * ones > len(found)).tobytes()
    words = [int.from_bytes(bits[8 * i : 8 * i + 8], "big", signed=True) for i in range(WIDE)]
    return words, [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(least.reshape(SAMPLES, SAMPLED))], sig


def bits_at(similarity: float) -> int:
    """How many bits of the wide fingerprint differ at a similarity: what is expected of two texts of one length, and 3
    standard deviations; pairs within it are compared by their shingles."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * WIDE * p + 3 * math.sqrt(64 * WIDE * p * (1 - p)))


def with_fingerprint(docs: DataFrame, out: str, text: str, shingle: int, wide: bool) -> DataFrame:
    """docs with the struct out: fp (a word or WIDE of them) and, if wide, the hashes of its blocks and the shingles' digest."""

    @F.arrow_udf("struct<fp:array<long>,keys:array<long>,sig:binary>" if wide else "struct<fp:array<long>>")
    def make(texts: pa.Array) -> pa.Array:
        each = (x.encode() for x in one_by_one(texts))
        if not wide:
            return pa.StructArray.from_arrays([pa.array([[fingerprint(x, shingle)] for x in each], pa.list_(pa.int64()))], ["fp"])
        rows = [wide_fingerprint(x, shingle) for x in each]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["fp", "keys", "sig"])

    return docs.withColumn(out, make(whole_text(text)))


def row_keys(doc_id: str, text: str) -> list[Column]:
    """did (id, or NO_ID) and th (hash of the text)."""
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long").alias("did"), F.xxhash64(whole_text(text)).alias("th")]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """did, th, fp (an array of one word) of every row; materialised."""
    out = fresh(docs.columns, "_made")
    made = with_fingerprint(docs.select(doc_id, text), out, text, shingle, False)
    return materialize(made.select(*row_keys(doc_id, text), F.col(out)["fp"].alias("fp")), "fingerprints")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """A mask for each choice of blocks - max_bits blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which rows of a and b (fingerprints, a row of words each) are at most max_bits apart."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return out <= max_bits


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component of each fingerprint and the links of a spanning forest, breadth first."""
    label, links, rest = np.full(len(fps), -1), [], np.arange(len(fps))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        label[front] = root = front[0]
        while len(front) and len(rest):
            some, front = front[:256], front[256:]
            near = _near(fps[some], fps[rest], max_bits)
            found = near.any(axis=0)
            links += zip(some[near[:, found].argmax(axis=0)].tolist(), rest[found].tolist(), strict=True)
            label[rest[found]] = root
            front, rest = np.concatenate((front, rest[found])), rest[~found]
    return label, links


def chunk_links(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Links between two chunks of a bucket, as few as keep its components, or within one chunk."""
    fps, chunk = np.array(pdf["fp"].tolist()).astype(np.uint64), pdf["chunk"].to_numpy()
    left, right = np.flatnonzero(chunk == chunk[0]), np.flatnonzero(chunk != chunk[0])
    label, links = _forest(fps[left], max_bits)
    if len(right):
        other, links = _forest(fps[right], max_bits)[0] + len(left), []
        root = list(range(len(pdf)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in range(0, len(left), 256):
            r, c = np.nonzero(_near(fps[left[i : i + 256]], fps[right], max_bits))
            _, first = np.unique(label[r + i] * len(pdf) + other[c], return_index=True)
            for x, y in zip((r[first] + i).tolist(), c[first].tolist(), strict=True):
                a, b = top(int(label[x])), top(int(other[y]))
                if a != b:
                    root[a] = b
                    links.append((int(left[x]), int(right[y])))
    else:
        links = [(int(left[a]), int(left[b])) for a, b in links]
    did, fp = pdf["did"].tolist(), pdf["fp"].tolist()
    return pd.DataFrame({f"{k}_{c}": [held[link[i]] for link in links] for i, k in enumerate("ab") for c, held in (("did", did), ("fp", fp))}, dtype="object")


def near_links(keyed: DataFrame, max_bits: int = 3, small: int = 32, chunk: int = 2048) -> DataFrame:
    """a, b (structs of did and fp): links that keep the components of all pairs at most max_bits apart that share a bucket.

    keyed: choice and key, which name a bucket; fp, once a bucket; did, which needn't be unique.
    """
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(keyed.join(sizes, ["choice", "key"]), "buckets")
    x, y = met.filter(F.col("n") <= small).alias("x"), met.filter(F.col("n") <= small).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("choice", "key")]
    apart = F.aggregate(F.zip_with("x.fp", "y.fp", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    pairs = x.join(y, [*on, F.col("x.fp") < F.col("y.fp")]).filter(apart <= max_bits).select(*[F.col(f"{side}.{c}").alias(f"{k}_{c}") for k, side in ("ax", "by") for c in ("did", "fp")])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = met.filter(F.col("n") > small).withColumn("chunk", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    groups = dealt.select("choice", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "did", "fp").groupBy("choice", "key", "i", "j")
    both = pairs.unionByName(groups.applyInPandas(lambda pdf: chunk_links(pdf, max_bits), "a_did long, a_fp array<long>, b_did long, b_fp array<long>"))
    return both.select(*[F.struct(F.col(f"{k}_did").alias("did"), F.col(f"{k}_fp").alias("fp")).alias(k) for k in "ab"])


def with_components(rows: DataFrame, max_bits: int = 3, blocks: int = 6, **limits) -> DataFrame:
    """rows (materialised: did, fp) with component, the smallest did that links reach, and root, a fingerprint of that did
    there: components of different texts may share a did, but not both."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("did").alias("did")), "nodes")
    keys = F.array(*[F.col("fp")[0].bitwiseAND(F.lit(m)) for m in block_masks(blocks, max_bits)])
    keyed = nodes.select(F.posexplode(keys).alias("choice", "key"), "did", "fp")
    return _named(rows, nodes, near_links(keyed, max_bits, **limits), "fp")


def _named(rows: DataFrame, nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """rows with component and root. nodes: did, one for each value of by; links: a and b, structs of both."""
    roots = components(links).select(F.col(f"node.{by}").alias(by), F.col("root.did").alias("component"), F.col(f"root.{by}").alias("root"))
    named = nodes.join(roots, by, "left").select(by, F.coalesce("component", "did").alias("component"), F.coalesce("root", by).alias("root"))
    # written first, so that both sides of the next join have plain shuffles and AQE splits a hot one's rows
    return rows.join(materialize(named, "named"), by)


def shingle_set(text: bytes, shingle: int) -> bytes:
    """The distinct shingles' hashes, 32 bits each, sorted."""
    return np.unique((hashes(text, shingle) >> np.uint64(32)).astype(np.uint32)).tobytes()


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sorted sets have at least that Jaccard similarity with one."""
    sizes = np.array([len(x) for x in others])
    out = (np.minimum(sizes, len(one)) >= similarity * np.maximum(sizes, len(one))) & (len(one) > 0)
    for some in np.array_split(np.flatnonzero(out), -(-int(sizes[out].sum()) // (1 << 20)) or 1):
        if len(some):
            joined = np.concatenate([others[i] for i in some])
            shared = np.add.reduceat(one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined, np.concatenate(([0], np.cumsum(sizes[some])[:-1])), dtype=np.int64)
            out[some] = shared >= similarity * (len(one) + sizes[some] - shared)
    return out


def compare_sets(pdf: pd.DataFrame, max_bits: int, similarity: float) -> pd.DataFrame:
    """Links of the buckets of a cell that keep the components of all similar pairs: those that join what isn't joined yet."""
    did, sig, fps = pdf["did"].tolist(), pdf["sig"].tolist(), np.array(pdf["fp"].tolist(), np.int64).astype(np.uint64)
    sets, chunk, out = [np.frombuffer(x, np.uint32) for x in pdf["shingles"]], pdf["chunk"].to_numpy(), []
    for (_, i, j), rows in pdf.groupby(["key", "i", "j"], sort=False).indices.items():
        left, right = rows[chunk[rows] == i], rows[chunk[rows] == j]
        label = np.arange(len(pdf))
        for at, x in enumerate(left.tolist()):
            rest = right[at + 1 :] if i == j else right
            rest = rest[label[rest] != label[x]]
            rest = rest[_near(fps[x : x + 1], fps[rest], max_bits)[0]]
            if len(rest):
                for y in rest[similar(sets[x], [sets[r] for r in rest], similarity)].tolist():
                    if label[y] != label[x]:
                        out.append((did[x], sig[x], did[y], sig[y]))
                        label[rows[label[rows] == label[y]]] = label[x]
    return pd.DataFrame(out, columns=["a_did", "a_sig", "b_did", "b_sig"], dtype="object")


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int, chunk: int = 1024, cell: int = 2048) -> DataFrame:
    """a, b (structs of did and sig): links that keep the components of all pairs of nodes that share a block, are near by
    fingerprint and have the similarity. nodes: did, uid, fp, keys, sig; texts: uid, text.

    Shingles are made again for the texts of shared blocks only, and go once to each block that they share.
    """
    keyed = nodes.select("sig", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = materialize(keyed.join(sizes, "key"), "met")
    live = materialize(nodes.join(met.select("sig").distinct(), "sig", "left_semi"), "live")

    @F.arrow_udf("binary")
    def make(values: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.encode(), shingle) for x in one_by_one(values)], pa.binary())

    sets = materialize(join_sized(texts, materialize(live.select("uid"), "wanted"), "uid", "left_semi").select("uid", make("text").alias("shingles")), "sets")
    full = live.join(sets, "uid").select("sig", "did", "fp", "shingles")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = met.join(full, "sig").withColumn("chunk", F.pmod(F.xxhash64("sig"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "did", "sig", "fp", "shingles")
    total = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / chunk))).first()[0] or 0
    cells = dealt.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-total // cell)))).alias("cell"))
    max_bits = bits_at(similarity)
    links = cells.applyInPandas(lambda pdf: compare_sets(pdf, max_bits, similarity), "a_did long, a_sig binary, b_did long, b_sig binary")
    return links.select(*[F.struct(F.col(f"{k}_did").alias("did"), F.col(f"{k}_sig").alias("sig")).alias(k) for k in "ab"])


def with_similar(rows: DataFrame, texts: DataFrame, similarity: float, shingle: int, **limits) -> DataFrame:
    """rows (materialised: did, uid, fp, keys, sig) with component, the smallest did that links reach, and root, a digest there."""
    first = F.min(F.struct("did", "uid", "fp", "keys"))
    nodes = materialize(rows.groupBy("sig").agg(first.alias("f")).select("sig", "f.*"), "nodes")
    return _named(rows, nodes, similar_links(nodes, texts, similarity, shingle, **limits), "sig")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, **limits) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    df = with_components(fingerprints(docs, text, doc_id, shingle), **limits)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return df.select(known("did").alias("doc_id"), F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), known("component").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float | None = 0.8, **limits) -> DataFrame:
    """One row of docs of each component: the smallest id, and of its rows the one with the smallest text hash.

    Links are of a Jaccard similarity of shingles of similarity or more, or without one at most max_bits of 64 bits.
    Rows are written once with their fingerprints and a number; what is dropped is a list of numbers.
    """
    wide = similarity is not None
    made, uid = fresh(docs.columns, "_made"), fresh(docs.columns, "_uid")
    held = materialize(with_fingerprint(docs, made, text, shingle, wide).withColumn(uid, F.monotonically_increasing_id()), "fingerprinted")
    rows = materialize(held.select(*row_keys(doc_id, text), F.col(uid).alias("uid"), f"`{made}`.*"), "rows")
    if wide:
        df = with_similar(rows, held.select(F.col(uid).alias("uid"), whole_text(text).alias("text")), similarity, shingle, **limits)
    else:
        df = with_components(rows, **limits)
    df = materialize(df.select("root", "component", "did", "th", "uid"), "components")
    best = df.filter(F.col("did") == F.col("component")).groupBy("root", "did").agg(F.min(F.struct("th", "uid")).alias("best"))
    kept = materialize(best.select(F.col("best.uid").alias("uid")), "kept")
    dropped = materialize(df.select("uid").join(kept, "uid", "left_anti").toDF(uid), "dropped")
    return join_sized(held, dropped, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
