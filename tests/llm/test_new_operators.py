"""Filter audit, phrase mining and near vectors against SQL and brute force, on rows full of edge cases."""

import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import oracle_rows, rows_of
from pyspark.sql import functions as F

from lexmill.llm import embedding_dups, filter_audit, phrases
from lexmill.llm.oracles import SQL
from lexmill.llm.queries import queries

Q = queries()


def write_labels(folder, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()), "toxic": pa.array([r[2] for r in rows], pa.int32())}), f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def labelled(edges):
    write_labels(edges, [(i, i % 2, int(i % 3 == 0)) for i in range(1, 60, 2)] + [(1, 0, 1), (None, 1, 1), (3, None, None), (9999, 1, 1)])
    return edges


def test_audit_oracle(spark, labelled):
    assert rows_of(Q["op11_filter_audit"](spark, labelled)) == oracle_rows(labelled, SQL["op11_filter_audit"], "documents", "labels")


def arriving(rng, n):
    """Rows of which many share a text; ids in no order, some null or repeated."""
    texts = [" ".join(rng.choice(["word", "Other", "THIRD", "a#b", "x"]) for _ in range(k)) for k in (0, 1, 5, 150, 250, 400)] + [" ".join(f"w{i}" for i in range(k)) for k in (10, 220, 230)]
    return [(rng.choice([None, *range(-20, 60)]), rng.choice([*texts, None, "", texts[-1]]), "en", rng.choice(["a", "b", "", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_retracts(spark, tmp_path, seed):
    """Files in several micro-batches and calls, smaller ids last: counters are those of all rows at once."""
    from conftest import write_documents

    rng = random.Random(seed)
    rows = sorted(arriving(rng, 160), key=lambda r: (r[0] is None, -(r[0] or 0)))
    write_labels(tmp_path, [(i, i % 2, int(i % 5 == 0)) for i in range(-20, 60, 3)])
    labels, docs, folder = spark.read.parquet(f"{tmp_path}/labels.parquet"), f"{tmp_path}/parts.parquet", f"{tmp_path}/state"
    schema = "doc_id long, text string, lang string, source string"
    cuts = [rows[:40], rows[40:80], rows[80:120], rows[120:]]
    for part in cuts[:2]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(docs)
    filter_audit.audit_stream(spark, docs, labels, folder, max_bytes=1)
    for part in cuts[2:]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(docs)
    got = filter_audit.audit_stream(spark, docs, labels, folder, max_bytes=1)
    assert rows_of(got) == oracle_rows(write_documents(tmp_path, rows), SQL["op11_filter_audit"], "documents", "labels")
    retracted = spark.read.parquet(f"{folder}/changes").filter("n < 0")
    assert retracted.count() > 0


def test_audit_extra_columns(spark, tmp_path):
    rows = [(1, "a b", "s", "x", 5), (2, "a b", None, "y", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, part string, mask int").write.parquet(f"{tmp_path}/d.parquet")
    labels = spark.createDataFrame([(1, 1, 0, "z")], "doc_id long, quality int, toxic int, did string")
    got = filter_audit.audit_stream(spark, f"{tmp_path}/d.parquet", labels)
    assert {r["part"] for r in got.collect()} == {"s", ""}
    assert got.count() == 2 * 600


def test_phrases_oracle(spark, edges):
    assert rows_of(Q["op12_phrases"](spark, edges)) == oracle_rows(edges, SQL["op12_phrases"], "documents")


def slow_phrases(rows, least, top):
    """All phrases of all pieces counted, scored and ranked."""
    import re

    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    key = lang, tuple(w[i : i + size])
                    f[key] = f.get(key, 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        mine = {p: v for (x, p), v in f.items() if x == lang}
        held = []
        for p, a in mine.items():
            longer = (q for q in mine if len(q) > len(p) and 100 * mine[q] >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if len(p) > 1 and not any(True for _ in longer):
                score, _, left, right = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k, mine[p[:k]], mine[p[k:]]) for k in range(1, len(p)))
                held.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(held)[:top], 1):
            out.append((-a, left, lang, n[lang], p.decode(), right, rank, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_brute_force(spark, seed, monkeypatch):
    """Few wanted phrases and low guesses, so that prefixes are bounded away and thresholds lowered; texts cut in stretches."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "naïve", "日本"]
    fixed = [rng.choices(vocabulary, k=rng.randrange(2, 6)) for _ in range(8)]
    rows = []
    for i in range(120):
        said = []
        for _ in range(rng.randrange(1, 25)):
            said += rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(vocabulary)]
            if rng.random() < 0.2:
                said.append(rng.choice([".", "\n", "x,", "\t", "A\x0bB"]))
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(said)))
    rows += [("en", None), ("fr", ""), ("en", "  \t "), ("en", "w1 " * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(f"extra {c}") for c in ("phrase", "head", "f", "n", "k", "rank", "score")})
    for least, top, guess in ((3, 5, 1), (2, 40, 2)):
        assert rows_of(phrases.collocations(docs, least=least, top=top, guess=guess, widen=2)) == slow_phrases(rows, least, top)


def test_phrases_in_stretches():
    """Counts don't depend on where texts are cut into stretches."""
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choices(["a", "b", "C", "é"], k=rng.randrange(6))) for _ in range(30)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 20), pa.array(texts)], ["lang", "text"])

    def counted():
        sums = Counter()
        for b in phrases.counted(iter([batch]), (1, 2, 3, 4), None):
            for last, f in zip(b["last"].to_pylist(), b["f"].to_pylist(), strict=True):
                sums[last] += f
        return sums

    whole = counted()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "SLICE", 7)
        m.setattr(phrases, "STRETCH", 50)
        assert counted() == whole


def vectors(rng):
    """Chains, copies, scaled copies, and vectors that link with nothing."""
    rows = []
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    for b in base:
        for _ in range(rng.randrange(2, 14)):
            v = [x + rng.gauss(0, 0.16) for x in b]
            rows += [(v, rng.choice([1, 2, None]))] * rng.choice([1, 1, 3])
    v = base[0]
    rows += [(v, 1), ([3.0 * x for x in v], 1), (v, 2), ([0.0] * 12, 1), ([-0.0] * 12, 1), (None, 1), ([], 1), ([float("nan")] + v[1:], 1), ([float("inf")] + v[1:], 1), ([None, *v[1:]], 1), (v[:7], 1), (v[:7], 1), ([1e300 * x for x in v], 1)]
    rng.shuffle(rows)
    return [(rng.choice([i, i, i, i % 7, None]), e, label) for i, (e, label) in enumerate(rows)]


def slow_links(rows, threshold=0.93):
    def usable(e, label):
        return label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    n, links = len(rows), Counter()
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if usable(a, x) and usable(b, y) and x == y and len(a) == len(b) and cosine(a, b) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = label[i], label[j]
                label = [min(p, q) if z in (p, q) else z for z in label]
    least = {}
    for (i, _, _), z in zip(rows, label, strict=True):
        least[z] = min(least.get(z, 2**63), 2**63 - 1 if i is None else i)
    known = lambda i: None if i == 2**63 - 1 else i
    return sorted(((known(least[z]), least[z] == (2**63 - 1 if i is None else i), links[k], i) for k, ((i, _, _), z) in enumerate(zip(rows, label, strict=True))), key=str)


@pytest.mark.parametrize("limits", [{}, {"chunk": 4, "cell": 8}])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_brute_force(spark, limits, kind):
    rows = vectors(random.Random(5))
    if kind == "float":
        import numpy as np

        rows = [(i, e and [None if x is None else float(np.float32(min(x, 1e38))) if math.isfinite(x) else x for x in e], label) for i, e, label in rows]
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], f"vec_id long, embedding array<{kind}>, label int, cls string, did string")
    assert rows_of(embedding_dups.near_embeddings(df, **limits)) == slow_links(rows)


def test_vectors_oracle(spark, tmp_path):
    rows = [r for r in vectors(random.Random(6)) if r[1] is None or None not in r[1]]
    rows = [(i, e if e is None or max(map(abs, e), default=0) < 1e30 else None, label) for i, e, label in rows]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}), f"{tmp_path}/embeddings.parquet")
    assert rows_of(Q["op13_embedding_dups"](spark, str(tmp_path))) == oracle_rows(str(tmp_path), SQL["op13_embedding_dups"], "embeddings")


def test_hashing_recall():
    """The share of pairs at the threshold that meet in a table is what the shape was made for, at every size."""
    rng = __import__("numpy").random.default_rng(3)
    for n in (100, 100_000, 10_000_000):
        hashes, tables = embedding_dups.shape(n, 0.93, 1.5, 512, 0.01)
        assert n * embedding_dups.agree(embedding_dups.UNRELATED, 1.5) ** hashes <= 512
        met = 0
        for _ in range(300):
            a, b = rng.standard_normal((2, 64))
            a /= (a @ a) ** 0.5
            b -= (a @ b) * a
            b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / (b @ b) ** 0.5
            d, shift = rng.standard_normal((64, hashes * tables)), rng.uniform(0, 1.5, hashes * tables)
            steps = [(((v @ d) + shift) // 1.5).reshape(tables, hashes) for v in (a, b)]
            met += (steps[0] == steps[1]).all(axis=1).any()
        assert met >= 290
