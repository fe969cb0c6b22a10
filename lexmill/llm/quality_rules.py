"""Host-level quality rules.

Each document gets counts and the rules that it fails. Failures are summed by host and rule; for each rule a beta prior,
fitted to all hosts by moments, shrinks the hosts' failure rates. The prior's strength comes from the variance of the rates
beyond what binomial sampling alone gives, so hosts that are all alike are shrunk nearly to the common rate, however few
documents they have. The host's verdict then decides how strictly its documents are judged:

* rejected: for some rule, the rate less `sds` standard deviations is above both `reject_rate` and the common rate: all its
  documents go;
* watched: for some rule, the rate is more than `sds` standard deviations above the common rate: a document that fails one
  rule goes;
* trusted: a document goes when it fails two rules, or one of the base rules.

Only DataFrame functions; the text is read once. A row holds a text's words and the hashes of its windows, some tens of bytes
a word, while it is judged: that is the largest need of memory, several times the longest text. Sums by host are combined before the shuffle, so a host with a third of
all rows is cheap; verdicts (a row a host) are broadcast only after their size is measured.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; repeated rows
are judged one by one; other columns are passed through, whatever their names; an empty table gives an empty result.
"""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import BLANK_CLASS, whole_text, words
from lexmill.storage import fresh, join_sized, materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Add out: words that lie in a window of WINDOW words found twice or more. hashes: column with a hash of each word.

    Window hashes are compared within one text only; they are sorted with their places just in texts that repeat one.
    """
    windows, ranked, places = (fresh(df.columns, x) for x in ("_windows", "_ranked", "_places"))
    word = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)])
    n = F.size(hashes)
    df = df.withColumn(windows, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), word)).otherwise(F.array().cast("array<bigint>")))
    has = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(ranked, F.when(has, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = lambda i, h: F.coalesce(F.get(F.col(ranked), i)["h"] == h, F.lit(False))
    df = df.withColumn(places, F.when(F.col(ranked).isNotNull(), F.array_sort(F.transform(F.filter(ranked, lambda x, i: beside(i - 1, x["h"]) | beside(i + 1, x["h"])), lambda x: x["i"]))))
    covers = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places), i + 1) - p, F.lit(WINDOW))))
    count = F.when(F.col(places).isNull(), F.lit(0)).otherwise(F.aggregate(covers, F.lit(0), lambda a, x: a + x))
    return df.withColumn(out, count.cast("long")).drop(windows, ranked, places)


def with_features(docs: DataFrame, text: str, host: str, out: str) -> DataFrame:
    """Add the struct out: host key and counts of each document's text."""
    t, w, h, r, lines = (fresh(docs.columns, x) for x in ("_text", "_words", "_hashes", "_repeats", "_lines"))
    df = docs.withColumn(t, whole_text(text)).withColumn(w, words(F.col(t)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = repeated_words(df, h, r)
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chars = F.length(F.regexp_replace(t, BLANK_CLASS + "+", ""))
    without = lambda drop: (F.length(t) - F.length(F.translate(F.col(t), drop, ""))).cast("long")
    long = lambda x: x.cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("null"))
    features = F.struct(
        key.alias("host"), long(F.size(w)).alias("n_words"), long(chars).alias("word_chars"), without(SYMBOLS).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.col(r).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"), without(UPPER).alias("n_upper"),
    )
    return df.withColumn(out, features).drop(t, w, h, r, lines)


def base_rules(f: str) -> list[Column]:
    """Too few words; too many in repeated windows."""
    c = lambda x: F.col(f"{f}.{x}")
    return [c("n_words") < 20, 100 * c("n_repeat_words") > 30 * c("n_words")]


def base_failed(f: str) -> Column:
    short, repeats = base_rules(f)
    return short | repeats


def other_rules(f: str) -> list[Column]:
    """Symbols, shouting, repeated lines, word length."""
    c = lambda x: F.col(f"{f}.{x}")
    return [4 * c("n_symbols") > c("n_words"), 2 * c("n_upper") > c("word_chars"), (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))]


def rules_failed(f: str) -> Column:
    """How many of the other rules fail."""
    return sum((r.cast("int") for r in other_rules(f)), F.lit(0))


def prior_strength(mean: float, squares: float, docs: float, hosts: float, weight: float) -> float:
    """How many documents the prior of a rule weighs. squares: sum of x * x / n over hosts; weight: sum of n * n by docs.

    Under a beta prior the variance of the hosts' rates, weighted by documents, is that of binomial sampling (hosts - 1) and
    a share 1 / (strength + 1) of what free documents add; that share is solved for.
    """
    sampling, seen = hosts - 1, (squares - docs * mean * mean) / (mean * (1 - mean))
    free = docs - weight - sampling
    share = (seen - sampling) / free if free > 1e-9 else 0.0
    return round(1 / min(max(share, 1 / 10_001), 1 / 3) - 1, 6)


def host_verdicts(features: DataFrame, f: str, reject_rate: float = 0.5, sds: float = 2.0) -> DataFrame:
    """A row a host: host, n_docs, excess (of the rule that stands out most, in standard deviations above the common rate),
    verdict. features has the struct f."""
    rules = [*base_rules(f), *other_rules(f)]
    hosts = features.groupBy(F.col(f"{f}.host").alias("host")).agg(F.count("*").alias("n_docs"), *[F.count_if(r).alias(f"x{i}") for i, r in enumerate(rules)])
    hosts = materialize(hosts, "hosts")
    n = F.col("n_docs").cast("double")
    sums = hosts.agg(F.sum(n).alias("docs"), F.count("*").alias("hosts"), F.sum(n * n).alias("nn"), *[F.struct(F.sum(f"x{i}").alias("x"), F.sum(F.col(f"x{i}") * F.col(f"x{i}") / n).alias("squares")).alias(f"r{i}") for i in range(len(rules))]).first()
    docs, excess, surely = sums["docs"] or 1.0, [], []
    for i in range(len(rules)):
        mean = min(max((sums[f"r{i}"]["x"] or 0) / docs, 1e-6), 1 - 1e-6)
        strength = prior_strength(mean, sums[f"r{i}"]["squares"] or 0.0, docs, sums["hosts"], (sums["nn"] or 0.0) / docs)
        rate = (F.col(f"x{i}") + mean * strength) / (n + strength)
        sd = F.sqrt(rate * (1 - rate) / (n + strength + 1))
        excess.append((rate - mean) / sd)
        surely.append(rate - sds * sd > max(reject_rate, mean))
    most = F.greatest(*excess)
    verdict = F.when(functools.reduce(Column.__or__, surely), "rejected").when(most > sds, "watched").otherwise("trusted")
    return hosts.select("host", "n_docs", F.round(most, 6).alias("excess"), verdict.alias("verdict"))


def _judged(df: DataFrame, f: str, **limits) -> tuple[DataFrame, dict[str, str]]:
    """df with the host's verdict and whether the document is kept; the names of the added columns."""
    names = {x: fresh(df.columns, f"_{x}") for x in ("host", "verdict", "excess", "kept")}
    hosts = host_verdicts(df, f, **limits).select(F.col("host").alias(names["host"]), F.col("verdict").alias(names["verdict"]), F.col("excess").alias(names["excess"]))
    df = join_sized(df.withColumn(names["host"], F.col(f"{f}.host")), hosts, names["host"])
    allowed = F.when(F.col(names["verdict"]) == "rejected", -1).when(F.col(names["verdict"]) == "watched", 0).otherwise(1)
    # one comparison of both sides of the join: a part on the features alone would be pushed below it and expanded there
    return df.withColumn(names["kept"], rules_failed(f) + 10 * base_failed(f).cast("int") <= allowed), names


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", **limits) -> DataFrame:
    """doc_id, counts, base_failed, kept, host verdict and excess of every document."""
    f = "_f"
    narrow = materialize(with_features(docs, text, host, f).select(F.col(doc_id).alias("doc_id"), f), "rules")
    df, names = _judged(narrow, f, **limits)
    counts = [F.col(f"{f}.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select("doc_id", *counts, base_failed(f).alias("base_failed"), F.col(names["kept"]).alias("kept"), rules_failed(f).alias("n_rules_failed"), F.col(names["excess"]).alias("host_excess"), F.col(names["verdict"]).alias("host_verdict"))


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of docs that are kept. Rows are written once with their counts, so that the text is judged once; hosts read
    the counts only."""
    f = fresh(docs.columns, "_f")
    df, names = _judged(materialize(with_features(docs, text, host, f), "judged"), f, **limits)
    return df.filter(F.col(names["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
