"""Learned language models: held-out accuracy, brute force over all segmentations, tables written and read again."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexmill.operators import language as L
from lexmill.plans import language_plans

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    """Of documents that the model hasn't seen, of more than 30 characters, 98 of 100 get their language."""
    docs = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["found_lang"], r["confidence"]) for r in language_plans.detected_languages(spark, SF).collect()}
    assert got.keys() == docs.keys()
    held = [i for i, (lang, text) in docs.items() if i % 3 and lang and text and len(text) > 30]
    assert len(held) > 500
    assert sum(got[i][0] == docs[i][0] for i in held) >= 0.98 * len(held)
    assert all(got[i] == ("und", 0.0) for i, (_, text) in docs.items() if len((text or "").strip()) <= 3)


def test_language_brute_force(spark):
    """Posteriors by plain sums over dictionaries of buckets; short, empty and null texts have the fallback."""
    train = [("abc abd", "x"), ("zzy zyx", "y"), ("abz", "x"), (None, "x"), ("q", None)]
    asked = ["abca", "zyzy", "zya", "ab", "", None, "abcz" * 30]
    rows = spark.createDataFrame(train, "text string, lang string")
    got = L.with_language(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string"), L.fit_language(rows), confidence="c").orderBy("i").collect()
    counts = {k: Counter(int(b) for t, lang in train if lang == k and t for b in L.run_buckets(t)) for k in "xy"}
    for r, t in zip(got, asked, strict=True):
        if t is None or len(t) <= 3:
            assert (r["found_lang"], r["c"]) == ("und", 0.0)
            continue
        runs = [int(b) for b in L.run_buckets(t)]
        score = {k: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * L.BUCKETS)) for b in runs) / len(runs) * min(len(runs), L.SHARP) for k, c in counts.items()}
        best = max(score, key=score.get)
        sure = 1 / sum(math.exp(s - score[best]) for s in score.values())
        assert r["c"] == pytest.approx(sure, abs=1e-9)
        assert r["found_lang"] == (best if sure >= 0.7 else "und")


def segmentations(run):
    if not run:
        return [[]]
    return [[run[:n], *rest] for n in range(1, len(run) + 1) for rest in segmentations(run[n:])]


def test_paths_and_counts_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        log_p = {"".join(rng.choices("abc", k=rng.randrange(1, 4))): -rng.uniform(0.5, 6) for _ in range(8)}
        run, unknown = "".join(rng.choices("abcd", k=rng.randrange(1, 9))), -9.0
        cost = lambda words: sum(log_p.get(w, unknown if len(w) == 1 else -math.inf) for w in words)  # noqa: B023, E731
        every = [s for s in segmentations(run) if cost(s) > -math.inf]
        words = L.best_path(run, log_p, 3, unknown)
        assert "".join(words) == run
        assert cost(words) == pytest.approx(max(map(cost, every)))
        total = sum(math.exp(cost(s)) for s in every)
        want = Counter()
        for s in every:
            for w in s:
                want[w] += 2 * math.exp(cost(s)) / total
        sums = Counter()
        L.expected_counts(run, log_p, 3, unknown, sums, 2)
        assert {w: pytest.approx(n, abs=1e-9) for w, n in want.items()} == dict(sums)


def test_words_are_found_again(spark):
    """A corpus without blanks, also of Chinese words: nine in ten boundaries are found, by a model that is read again."""
    rng = random.Random(7)
    for words in (["合同", "劳动", "工资", "的", "解除", "试用期", "应当", "支付", "单位", "规定"], ["the", "river", "stone", "lamp", "of", "quick", "green"]):
        said = [[rng.choice(words) for _ in range(rng.randrange(3, 20))] for _ in range(400)]
        docs = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(said)] + [(400, None), (401, "")], "i long, text string")
        model = L.fit_words(docs, longest=6)
        got = {r["i"]: r["words"] for r in L.with_words(docs, spark.read.parquet(*model.inputFiles())).collect()}
        assert got[400] == got[401] == []
        ends = lambda s: set(np.cumsum([len(w) for w in s]).tolist())
        both = sum(len(ends(s) & ends(got[i])) for i, s in enumerate(said))
        assert both >= 0.9 * sum(len(ends(s)) for s in said)
        assert both >= 0.9 * sum(len(ends(got[i])) for i in range(400))


def test_segmented_words_query(spark):
    got = {r["item_id"]: (r["words"], r["n_words"]) for r in language_plans.segmented_words(spark, SF).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert got.keys() == items.keys()
    for i, text in items.items():
        assert got[i][0].replace(" ", "") == "".join(L.LETTERS.findall(text.lower()))
        assert got[i][1] == len(got[i][0].split())
