"""Models of language that are learned from the corpus: which language a text is in, and where its words begin.

Language. Naive Bayes over hashed runs of one to three characters, fitted on at most `max_texts` labelled texts (by hash). A
text's evidence is the mean of its runs' log odds, weighed as `SHARP` runs at most, so that long texts aren't surer than
their runs agree. Texts of MIN_CHARS characters or fewer, and confidences below MIN_CONFIDENCE, have the fallback.

Words. A unigram model: candidate words are the frequent runs of up to `longest` characters, in at most `max_texts` texts,
whose parts stand together more often than by chance;
expectation maximisation over all segmentations gives their probabilities, and those that hardly occur are dropped. A text
is cut along its most probable path by dynamic programming over the lattice of known words; a single character is always
a word, so every text can be cut. Of equal paths the one whose last words are longer is taken.

Both models are small tables (bounded by `BUCKETS` a language, and by `most_words`) that are written and read again; tasks get
them by broadcast. Counts are combined in the tasks and before the shuffle.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import MIN_CHARS, MIN_CONFIDENCE
from lexmill.storage import materialize, spread

BUCKETS, LONGEST_RUN, SHARP = 1 << 14, 3, 40
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows by the hash of key, or all of fewer."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def run_buckets(text: str) -> np.ndarray:
    """The bucket of each run of one to LONGEST_RUN characters of the text in lower case, framed by spaces."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, run = [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(min(LONGEST_RUN, len(points))):
            run = run[: len(points) - n] * ODD[1] + (points[n:] + np.uint64(1)) * ODD[0]
            out.append((run * ODD[2]) >> np.uint64(64 - 14))
    return np.concatenate(out).astype(np.int64)


def fit_language(rows: DataFrame, text: str = "text", label: str = "lang", max_texts: int = 20_000) -> DataFrame:
    """lang, weights (a log probability a bucket, smoothed) of the labelled texts; materialised, a row a language."""
    known = rows.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for said, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(run_buckets(said.as_py()), minlength=BUCKETS)
                sums[lang] = sums.get(lang, 0) + found
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = spread(sampled(known, F.col("text"), max_texts)).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = F.log(F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x) + F.lit(0.5) * BUCKETS)
    by = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    weight = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.log(F.coalesce(F.col("m")[b], F.lit(0)) + F.lit(0.5)) - total)
    return materialize(by.select("lang", weight.alias("weights")), "language-model")


def with_language(rows: DataFrame, model: DataFrame, text: str = "text", lang: str = "found_lang", confidence: str = "confidence", fallback: str = "und") -> DataFrame:
    """rows with the most probable language of each text, or the fallback, and the confidence."""
    held = sorted((r["lang"], r["weights"]) for r in model.collect())  # a row a language
    shared = rows.sparkSession.sparkContext.broadcast(([x for x, _ in held], np.array([w for _, w in held], np.float64).reshape(len(held), -1)))

    @F.arrow_udf("struct<lang:string,confidence:double>")
    def find(texts: pa.Array) -> pa.Array:
        names, weights = shared.value
        out = []
        for x in texts:
            said = (x.as_py() or "").strip()
            if len(said) <= MIN_CHARS or not names:
                out.append((None, 0.0))
                continue
            runs = run_buckets(said)
            score = weights[:, runs].mean(axis=1) * min(len(runs), SHARP)
            odds = np.exp(score - score.max())
            out.append((names[int(odds.argmax())], float(1 / odds.sum())))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64())], ["lang", "confidence"])

    made = rows.withColumn("_found", find(F.col(text)))
    sure = F.col("_found.confidence") >= MIN_CONFIDENCE
    return made.withColumns({lang: F.when(sure, F.col("_found.lang")).otherwise(F.lit(fallback)), confidence: F.col("_found.confidence")}).drop("_found")


#: What words are made of; all else stands between runs.
LETTERS = re.compile(r"[^\W\d_]+")


def paths_ahead(run: str, log_p: dict[str, float], longest: int, unknown: float) -> list[list[tuple[int, float]]]:
    """For each end in the run: starts of the known words (or single characters) that end there, and their log probabilities."""
    out: list[list[tuple[int, float]]] = [[]]
    for end in range(1, len(run) + 1):
        found = [(start, log_p[run[start:end]]) for start in range(max(0, end - longest), end) if run[start:end] in log_p]
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, unknown))
        out.append(found)
    return out


def expected_counts(run: str, log_p: dict[str, float], longest: int, unknown: float, sums: Counter, times: int) -> None:
    """Add how often each word is expected in the run, over all its segmentations (forward and backward sums)."""
    edges, n = paths_ahead(run, log_p, longest, unknown), len(run)
    ahead = [0.0] + [-math.inf] * n
    for end in range(1, n + 1):
        best = max(ahead[s] + p for s, p in edges[end])
        ahead[end] = best + math.log(sum(math.exp(ahead[s] + p - best) for s, p in edges[end]))
    back = [-math.inf] * n + [0.0]
    for end in range(n, 0, -1):
        for s, p in edges[end]:
            a, b = back[s], back[end] + p
            back[s] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
    for end in range(1, n + 1):
        for s, p in edges[end]:
            sums[run[s:end]] += times * math.exp(ahead[s] + p + back[end] - ahead[n])


def best_path(run: str, log_p: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of the most probable segmentation."""
    edges, n = paths_ahead(run, log_p, longest, unknown), len(run)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start, p in edges[end]:
            if score[start] + p > score[end]:
                score[end], back[end] = score[start] + p, start
    words, end = [], n
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


WORDS_MADE = "word string, n double"


def cohesive(counts: DataFrame, ratio: float) -> DataFrame:
    """The words that are at least `ratio` times as frequent as any two parts would be side by side by chance; characters
    stay. Without this the likeliest words are whole phrases."""
    total = counts.filter(F.length("word") == 1).agg(F.sum("n")).first()[0] or 1.0
    splits = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.struct(F.substr("word", F.lit(1), k).alias("left"), F.substr("word", k + 1).alias("right")))
    cuts = counts.filter(F.length("word") > 1).select("word", "n", F.explode(splits).alias("s")).select("word", "n", "s.*")
    part = lambda side, n: counts.select(F.col("word").alias(side), F.col("n").alias(n))
    weak = cuts.join(part("left", "a"), "left").join(part("right", "b"), "right").filter(F.col("n") * total < ratio * F.col("a") * F.col("b"))
    return counts.join(weak.select("word").distinct(), "word", "left_anti")


def fit_words(rows: DataFrame, text: str = "text", longest: int = 4, least: int = 5, most_words: int = 200_000, max_texts: int = 20_000, rounds: int = 4, piece: int = 400, ratio: float = 5.0) -> DataFrame:
    """word, log_p of a unigram model of the runs of letters in the texts; materialised. Runs longer than `piece` are cut;
    ratio: how much more often than by chance a word's parts stand together."""
    known = rows.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    texts = materialize(spread(sampled(known, F.col("text"), max_texts)), "segment-texts")

    def summed(count) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Counter = Counter()
            for batch in batches:
                runs: Counter = Counter()
                for x in batch.column(0):
                    for run in LETTERS.findall(x.as_py()):
                        runs.update(run[i : i + piece] for i in range(0, len(run), piece))
                for run, times in runs.items():
                    count(run, times, sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(map(float, sums.values())))], ["word", "n"])

        return texts.mapInArrow(over, WORDS_MADE).groupBy("word").agg(F.sum("n").alias("n"))

    def substrings(run: str, times: int, sums: Counter) -> None:
        for n in range(1, longest + 1):
            for i in range(len(run) - n + 1):
                sums[run[i : i + n]] += times

    def model(counts: DataFrame, floor: float) -> DataFrame:
        """The most frequent words, as log probabilities; characters stay however rare they are."""
        kept = counts.filter((F.col("n") >= floor) | (F.length("word") == 1)).orderBy(F.col("n").desc(), "word").limit(most_words)
        kept = materialize(kept, "words")
        total = kept.agg(F.sum("n")).first()[0] or 1.0
        return materialize(kept.select("word", F.round(F.log(F.greatest(F.col("n"), F.lit(1e-6)) / total), 9).alias("log_p")), "word-model")

    candidates = materialize(summed(substrings).filter((F.col("n") >= least) | (F.length("word") == 1)), "substrings")
    found = model(cohesive(candidates, ratio), least)
    for _ in range(rounds):
        shared, unknown = _shared(found)
        found = model(summed(lambda run, times, sums, shared=shared, unknown=unknown: expected_counts(run, shared.value, longest, unknown, sums, times)), 0.5)
    return found


def _shared(model: DataFrame):
    """The model's words for tasks, and what a character that it doesn't know counts for."""
    log_p = {r["word"]: r["log_p"] for r in model.collect()}  # most_words at most
    return model.sparkSession.sparkContext.broadcast(log_p), min(log_p.values(), default=0.0) - math.log(10)


def with_words(rows: DataFrame, model: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """rows with the words of each text's runs of letters, along the most probable paths; null texts have none."""
    shared, unknown = _shared(model)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        longest = max(map(len, shared.value), default=1)
        return pa.array([[w for run in LETTERS.findall(x.as_py() or "") for w in best_path(run, shared.value, longest, unknown)] for x in texts], pa.list_(pa.string()))

    return rows.withColumn(out, cut(F.col(text)))
