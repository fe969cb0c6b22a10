"""Quality classifier with hierarchical empirical Bayes over sites.

Model. A document is good (y = 1) with its site's rate: a host's rate is drawn from a beta distribution around the global
mean, a path's from one around its host's. Given y, the text's evidence is independent of the site. So

    posterior odds of y = likelihood ratio of the text * odds of the path's rate.

The likelihood ratio is that of a logistic regression on counts of the text and on hashed words and word pairs, its odds
taken by the odds of its training labels. A path's rate is estimated from the other documents' classifier probabilities
(a document's own share is left out), shrunk to its host's rate, that one to the global mean. How many documents a prior
weighs is fitted by moments over all sites: the variance of the sites' means around their parents' less what sampling
within sites explains. Sums by site are combined before the shuffle, in whole parts of a unit, so that reruns agree to the
last digit; site tables are broadcast only after their size is measured.

The regression is fitted to at most `max_labels` labelled documents (by id hash). Hashed words get log ratios of their
shares in good and bad documents, which enter the regression as one feature; while it is fitted, that feature comes from
the half of the documents that a document isn't in.

Edge cases: null and empty texts have all counts zero; null hosts and paths are sites of their own; without labels of
both kinds every document has log odds zero and is kept; a document labelled more than once counts with its mean label,
one whose id repeats with the smallest of its texts; a score equal to `keep_at` is kept; repeated rows get a row each;
only the named columns are read; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import BLANK_CLASS, hash_cutoff, whole_text, words
from lexmill.storage import fresh, join_sized, materialize, spread

FEATURES = ("size", "word_length", "symbols", "upper", "digits", "marks", "repeats", "dup_lines", "words_seen")
UNIT, COARSE = 1_000_000, 10_000
BUCKETS = 8192


def buckets(w: Column) -> Column:
    """The bucket of each word and of each pair of neighbouring words."""
    n = F.size(w)
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: place(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(w, lambda x: place(x)), pairs)


def seen(w: str, weights: np.ndarray) -> Column:
    """Mean weight of a text's words and pairs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(buckets(F.col(w)), F.lit(0.0), lambda s, i: s + F.get(table, i))
    return total / F.greatest(2.0 * F.size(w) - 1, F.lit(1.0))


def with_features(docs: DataFrame, text: str, words_seen) -> tuple[DataFrame, str]:
    """docs with an array of counts of each text, and that column's name. words_seen: from the words' column to the last one."""
    t, w, out = (fresh(docs.columns, x) for x in ("_t", "_w", "_features"))
    df = docs.withColumn(t, whole_text(text)).withColumn(w, words(F.col(t)))
    without = lambda drop: F.length(t) - F.length(F.translate(F.col(t), drop, ""))
    chars = F.length(F.regexp_replace(t, BLANK_CLASS + "+", ""))
    lines = F.split(t, "\n")
    share = lambda part, of: (part / F.greatest(of, F.lit(1))).cast("double")
    features = F.array(
        F.log1p(F.size(w).cast("double")), share(chars, F.size(w)), share(without("#*$%&|<>"), F.size(w)), share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        share(without("0123456789"), chars), share(without("!?;:=@/\\"), F.size(w)), share(F.size(w) - F.size(F.array_distinct(w)), F.size(w)), share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        words_seen(w),
    )
    return df.withColumn(out, features).drop(t, w), out


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and coefficients (intercept last) of a ridge logistic regression by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / spread, -5, 5), np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, beta


@dataclass
class Model:
    """scales: (mean, spread, coefficient) a feature, then (0, 1, intercept); weights of buckets; log odds of the labels."""

    scales: list[tuple[float, float, float]]
    weights: np.ndarray
    base: float


def _bucket_weights(counts: dict[tuple[int, int], tuple[float, float]], folds: tuple[int, ...]) -> np.ndarray:
    """Log ratio of each bucket's share in good and in bad documents of the folds, smoothed."""
    good, bad = np.ones(BUCKETS), np.ones(BUCKETS)
    for (fold, bucket), (g, b) in counts.items():
        if fold in folds:
            good[bucket] += g
            bad[bucket] += b
    return np.round(np.log(good / good.sum()) - np.log(bad / bad.sum()), 6)


def fit(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str = "quality", max_labels: int = 20_000) -> Model | None:
    """None without labels of both kinds."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = materialize(chosen.filter(F.xxhash64("doc_id") <= F.lit(hash_cutoff(chosen, F.col("doc_id"), max_labels))), "labels")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    sample = join_sized(named, chosen, "doc_id", "inner").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample = spread(materialize(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")), "labelled"))  # max_labels rows at most
    # words are a column of their own, as each place of the buckets' expression would make them anew
    split = sample.withColumn("w", words(F.col("text"))).select("fold", "y", "w")
    found = split.select("fold", "y", F.explode(buckets(F.col("w"))).alias("bucket")).groupBy("fold", "bucket").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    counts = {(r["fold"], r["bucket"]): (r["good"], r["bad"]) for r in found.collect()}  # two rows a bucket
    halves = [_bucket_weights(counts, (1 - fold,)) for fold in (0, 1)]
    featured, f = with_features(sample, "text", lambda w: F.when(F.col("fold") == 0, seen(w, halves[0])).otherwise(seen(w, halves[1])))
    rows = sorted(featured.select("doc_id", F.col(f).alias("f"), "y").collect())
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    mean, deviation, beta = regression(np.array([r["f"] for r in rows], float), y)
    share = min(max(float(y.mean()), 0.01), 0.99)
    return Model([*zip(mean.tolist(), deviation.tolist(), beta[:-1].tolist(), strict=True), (0.0, 1.0, float(beta[-1]))], _bucket_weights(counts, (0, 1)), float(np.log(share / (1 - share))))


def log_odds(f: str, scales: list[tuple[float, float, float]]) -> Column:
    out = F.lit(scales[-1][2])
    for i, (mean, spread, b) in enumerate(scales[:-1]):
        out = out + b * F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(f)[i] - mean) / spread))
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))


def strength(sites: DataFrame, n: Column, total: Column, squares: Column, parent: Column, mean: float) -> float:
    """How many documents the prior of these sites weighs. total and squares: sums of the probabilities and of their squares.

    A beta prior of strength k around mean has variance mean * (1 - mean) / (k + 1); the variance is that of the sites'
    means around their parents', weighted by documents, less the sampling variance of the means.
    """
    m = total / n
    within = F.greatest(squares / n - m * m, F.lit(0.0))  # a site's documents; its mean's variance is this by n
    row = sites.agg(F.sum(n * (m - parent) * (m - parent) - within).alias("v"), F.sum(n).alias("n")).first()
    spread = max((row["v"] or 0.0) / (row["n"] or 1), 1e-9)
    return round(min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0), 6)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def with_posterior(own: DataFrame, base: float, keep_at: float) -> DataFrame:
    """doc_id, evidence, host_mean, path_mean, score and kept. own, materialised: doc_id, host, path, evidence (log odds)
    and p, its probability in UNIT parts; base: log odds that the evidence starts from."""
    p = F.col("p") / UNIT
    coarse = F.round(F.col("p") / (UNIT / COARSE)).cast("long")
    paths = materialize(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(coarse * coarse).alias("sq")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("p").alias("host_p"), F.sum("sq").alias("host_sq")), "hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_p").alias("p")).first()
    mean = (whole["p"] or 0) / UNIT / (whole["n"] or 1)
    sites = materialize(join_sized(paths, hosts, "host").drop("host"), "sites")
    k_host = strength(hosts, F.col("host_n"), F.col("host_p") / UNIT, F.col("host_sq") / COARSE**2, F.lit(mean), mean)
    k_path = strength(sites, F.col("n"), p, F.col("sq") / COARSE**2, F.col("host_p") / UNIT / F.col("host_n"), mean)
    df = join_sized(own.withColumnRenamed("p", "own_p").drop("host"), sites.drop("sq", "host_sq"), "path")
    shrunk = lambda total, n, prior, k: ((total - F.col("own_p")) / UNIT + prior * k) / (n - 1 + k)
    df = df.withColumn("host_mean", shrunk(F.col("host_p"), F.col("host_n"), F.lit(mean), k_host))
    df = df.withColumn("path_mean", shrunk(F.col("p"), F.col("n"), F.col("host_mean"), k_path))
    df = df.withColumn("score", F.round(1 / (1 + F.exp(-(F.col("evidence") - base + _logit(F.col("path_mean"))))), 6))
    return df.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_mean", 6).alias("host_mean"), F.round("path_mean", 6).alias("path_mean"), "score", (F.col("score") >= keep_at).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: str = "lang", doc_id: str = "doc_id", keep_at: float = 0.3, max_labels: int = 20_000) -> DataFrame:
    """doc_id, evidence (own log odds), host_mean, path_mean, score (posterior) and kept of every document."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    model = fit(docs, labels, text, doc_id, max_labels=max_labels)
    named = docs.select(F.col(doc_id).alias("doc_id"), key(host).alias("host"), F.concat_ws("\t", key(host), key(path)).alias("path"), F.col(text).alias("text"))
    if model:
        df, f = with_features(named, "text", lambda w: seen(w, model.weights))
        own = df.select("doc_id", "host", "path", log_odds(f, model.scales).alias("evidence"))
    else:
        own = named.select("doc_id", "host", "path", F.lit(0.0).alias("evidence"))
    own = materialize(own.withColumn("p", F.round(UNIT / (1 + F.exp(-F.col("evidence")))).cast("long")), "evidence")
    return with_posterior(own, model.base if model else 0.0, keep_at)
