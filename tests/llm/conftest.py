import os
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(__file__))
WORDS = "the of and river stone lamp paper green quick seven under cloud table north".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies, hot lines and sources."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    line = "This very line stands in many documents of the table"
    rows = [(1, base, "en", "a"), (2, base + " ", "en", "a"), (3, "\t" + base.replace(" ", "  "), "en", "b"), (4, base[:-4] + "lamp", "en", "a"), (4, base[:-4] + "lamp", "en", "a")]
    rows += [(5, None, "en", "a"), (6, "", None, "b"), (7, " \n\t ", "en", None), (None, base, "en", "a"), (None, None, None, None), (8, "one two", "en", "c"), (8, "three", "en", "c")]
    rows += [(9, sentence(rng, 30_000), "en", "long"), (10, "word " * 400, "en", "a"), (11, "Äpfel ÉTÉ 日本語 \U0001f600 " * 30, "de", "b"), (12, "A" * 50 + "\n" + line, "en", "a")]
    for i in range(20, 60):
        rows.append((i, f"{sentence(rng, 30)}\n{line}\n  {line.upper()} \nshort\n{sentence(rng, 12)}.", "en", "hot" if i % 3 else "b"))
    rows += [(70, "##### $$$ *** " * 20, "en", "junk"), (71, "SHOUTING ALL THE TIME " * 12, "en", "junk"), (72, "x\r\ny\r\nx\r\n" + sentence(rng, 40), "en", "b"), (73, "Released under the MIT  License.\nApache License, Version 2.0; cc-by-nc", "en", "b")]
    return rows


def write_documents(folder, rows) -> str:
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    lengths = [None if t is None else len(t) for t in columns[1]]
    pq.write_table(pa.table([pa.array(c, k.type) for c, k in zip([*columns, lengths], kinds, strict=True)], schema=kinds), f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edges(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("edges")
    rows = [(c, t, r, s) for c in (1, 2, 3) for t, r, s in ((0, "user", "Hi <|end|>\nyou"), (1, "assistant", f"Answer {c % 2} \\n <|turn|>"))]
    rows += [(4, None, None, None), (4, 1, "assistant", ""), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (None, 0, "assistant", "alone"), (6, 0, "a\nb\\", "<"), (6, 1, "assistant", "|end|>\\")]
    rows += [(10 + i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"own {i}") for i in range(40) for t in range(4)]
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    pq.write_table(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)}), f"{folder}/conversations.parquet")
    return write_documents(folder, edge_documents())


@pytest.fixture(scope="session")
def nothing(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("nothing")
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}), f"{folder}/conversations.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), f"{folder}/pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}), f"{folder}/embeddings.parquet")
    return write_documents(folder, [])


@pytest.fixture(scope="session")
def clashing(spark, edges):
    """The edge documents with extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{edges}/documents.parquet")
    names = "_f _host _verdict _kept kept n_words _text _words _did did th _th _keep key _key _copies size rank uid salt fp rep piece length Offset _n found sequence_id".split()
    return df.withColumns({n: F.lit(f"extra {n}") for n in names})
