"""The pipeline's stages, each on what the one before kept, against the operators' own verdicts and brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexmill.llm import mixing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, edges, tmp_path_factory):
    """Rows after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{edges}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, edges).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_quality_rules(kept):
    verdicts = Counter((r["doc_id"], r["kept"]) for r in quality_rules.judge(kept[0]).collect())
    assert Counter(r["doc_id"] for r in kept[1].collect()) == Counter({i: n for (i, k), n in verdicts.items() if k})


def test_line_dedup(kept):
    docs = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-(2**63) if i is None else i)
    gone = lambda i, line: len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and (-(2**63) if i is None else i) < max(holders[key(line)])
    assert rows(kept[2]) == Counter((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in docs)


def test_near_duplicates(kept):
    """One row of each component stays, text and all; components by comparing the shingles of all pairs."""
    from test_llm_operators import chained, shingles

    none = 2**63 - 1
    docs = sorted((none if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept[2].collect())
    label = chained([shingles(t) for _, t in docs])
    groups = defaultdict(list)
    for doc, x in zip(docs, label, strict=True):
        groups[x].append(doc)
    left = Counter((none if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept[3].collect())
    assert sum(left.values()) == len(groups)
    for held in groups.values():
        least = min(i for i, _ in held)
        assert sum(left[doc] for doc in set(held)) == 1
        assert any(left[doc] for doc in held if doc[0] == least)


def test_mixing(kept):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_table(kept[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in kept[4].collect()) == Counter(want)


def test_packing(kept):
    packed = defaultdict(list)
    for r in kept[5].collect():
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in packed.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    firsts = Counter(r["doc_id"] for r in kept[5].collect() if r["piece"] == 0)
    assert firsts == Counter(r["doc_id"] for r in kept[4].collect())


def test_run_is_the_stages(spark, edges, kept):
    pick = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, edges)) == pick(kept[5])


def test_empty_table(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
