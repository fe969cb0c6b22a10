"""Collocations by best-first branch and bound over phrase prefixes.

A phrase of two to four words scores 2,000,000 a / (l + r) at its worst cut, a being its count, l and r those of the parts.
No phrase that starts with p scores more than bound(p) = 2,000,000 f(p) / (f(p's first word) + f(p)), as its own count is at
most f(p) and at most that of the part behind the first word. So growth is best first: words and pairs are counted for all
texts; a threshold, by language, is guessed from the pairs' scores; then only prefixes whose bound reaches the threshold
are grown by one word, to three and four. If fewer than `top` phrases survive with a score of the threshold or more, it is
lowered for that language and what newly reaches it is grown. Else the rest is settled: nothing that wasn't grown can reach
the threshold, ties with it included.

Whether a phrase survives depends on longer ones with 80 % of its count; it suffices to look at those one word longer, as a
longer one is no more frequent than one in between. Those with the word in front have other prefixes, of low bounds maybe,
so these are grown too: of the prefixes (w, c) where c starts a grown prefix, those frequent enough to matter, which a
phrase at the threshold bounds from below: 100 f(w, c) >= 80 f(c) t / (2,000,000 - t). The rest of a four-word phrase
whose count isn't known is counted once its other cuts reach the threshold.

A pass cuts the texts in Arrow tasks into numbers of words, counts phrases of stretches of STRETCH bytes at a time, and joins
their prefixes with those that are to be grown: by broadcast only if they are measured to be few, else by a shuffle. A
bitmap of the prefixes' hashes, of `2 ** BITS` bits whatever their number, keeps tasks from handing on what the join would
drop; false hits only cost time. Counts are combined before each shuffle, so a frequent word is a row a task. Sums are 64-bit
and products decimals of 38 digits, so nothing is rounded.

Edge cases: a null or empty text has no words; a null language is `und`; rows are counted one by one, whatever their ids;
extra columns aren't read; a language without phrases of `least` occurrences has no rows; so has an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.text import one_by_one
from lexmill.storage import join_sized, materialize

#: Fixed values of the result contract.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST, TOP, SCALE, UNKNOWN = 30, 2000, 2_000_000, "und"

PLAIN = bytes(10 if i in BREAKS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
STRETCH, SLICE, BITS = 12 << 20, 4 << 20, 25
PRIME, ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def slots(hashes: np.ndarray) -> np.ndarray:
    """Places in the bitmap."""
    return ((hashes ^ (hashes >> np.uint64(32))) * ODD) >> np.uint64(64 - BITS)


def head_slots(langs: pa.Array, heads: pa.Array) -> pa.Array:
    """The bitmap's place of each prefix."""
    out = np.empty(len(heads), np.uint64)
    with np.errstate(over="ignore"):
        for i, (lang, head) in enumerate(zip(langs.to_pylist(), heads.to_pylist(), strict=True)):
            h = np.uint64(xxhash.xxh64_intdigest(lang))
            for word in head.split(" "):
                h = h * PRIME + np.uint64(xxhash.xxh64_intdigest(word))
            out[i] = h
        return pa.array(slots(out).astype(np.int64))


def numbered(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers, 0 between pieces, and what the numbers stand for."""
    words = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.binary()), b" ").flatten().dictionary_encode()
    ids, kinds = words.indices.to_numpy().astype(np.int64) + 1, words.dictionary
    place = {k: v for v, k in enumerate(kinds.to_pylist(), 1) if k in (b"", b"\n")}
    ids = ids[ids != place.get(b"", -1)]
    ids[ids == place.get(b"\n", -1)] = 0
    return ids, pa.concat_arrays([pa.array([b""], pa.binary()), kinds]).cast(pa.string())


class Counter:
    """Texts of one language, to be counted together."""

    def __init__(self, lang: str):
        self.lang, self.texts, self.n = lang, [], 0

    def add(self, data: bytes) -> None:
        self.texts.append(data)
        self.n += len(data)

    def phrases(self, orders: tuple[int, ...], bitmap: np.ndarray | None) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
        """For each order: the distinct phrases, a column a word, and their counts; with a bitmap those whose prefix is in it,
        without one first the number of all words."""
        ids, names = numbered(b"\n".join(self.texts))
        size = len(names)
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], np.uint64) if bitmap is not None else None
        if bitmap is None:
            yield [pa.array([""])], np.array([np.count_nonzero(ids)])
        for order in orders:
            whole = ids[: max(0, len(ids) - order + 1)] > 0
            for k in range(1, order):
                whole &= ids[k : k + len(whole)] > 0
            at = np.flatnonzero(whole)
            if bitmap is not None:
                with np.errstate(over="ignore"):
                    h = np.full(len(at), xxhash.xxh64_intdigest(self.lang), np.uint64)
                    for k in range(order - 1):
                        h = h * PRIME + hashed[ids[at + k]]
                    place = slots(h)
                at = at[((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1) > 0]
            keys, columns = ids[at], []
            for k in range(1, order):
                if k > 1:
                    kinds, keys = np.unique(keys, return_inverse=True)
                    columns = [c[kinds // size] for c in columns] + [kinds % size] if columns else [kinds // size, kinds % size]
                keys = keys * size + ids[at + k]
            kinds, f = np.unique(keys, return_counts=True)
            if order == 1:
                columns = [kinds]
            else:
                columns = [c[kinds // size] for c in columns] + [kinds % size] if columns else [kinds // size, kinds % size]
            yield [names.take(pa.array(c)) for c in columns], f


def counted(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...], bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """lang, head, last, f: counts of phrases in stretches of STRETCH bytes. With a bitmap, head is the prefix and last the
    last word; without one, last is the phrase, or empty for the number of all words."""
    held: dict[str, Counter] = {}

    def made(lang: str, head: pa.Array | None, last: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([lang] * len(last)), pa.nulls(len(last), pa.string()) if head is None else head, last, pa.array(f.astype(np.int64))]
        whole = pa.RecordBatch.from_arrays(columns, ["lang", "head", "last", "f"])
        yield from (whole.slice(i, 1 << 16) for i in range(0, len(last), 1 << 16))

    def flush() -> Iterator[pa.RecordBatch]:
        for c in held.values():
            for columns, f in c.phrases(orders, bitmap):
                if bitmap is None:
                    yield from made(c.lang, None, pc.binary_join_element_wise(*columns, " "), f)
                else:
                    yield from made(c.lang, pc.binary_join_element_wise(*columns[:-1], " "), columns[-1], f)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), one_by_one(batch["text"]), strict=True):
            data, start = text.encode().translate(PLAIN), 0
            while start < len(data):
                end = data.find(b"\n", start + SLICE) + 1 or len(data)
                held.setdefault(lang, Counter(lang)).add(data[start:end])
                start = end
                if sum(c.n for c in held.values()) >= STRETCH:
                    yield from flush()
    yield from flush()


def bitmap_of(heads: DataFrame) -> np.ndarray:
    """The bitmap of prefixes: 2 ** BITS bits, set by tasks in words of 64."""
    slot = F.arrow_udf(head_slots, "long")("lang", "head")
    rows = heads.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def key(*columns: Column | str) -> Column:
    """A language and a phrase as one string; phrases hold no tab."""
    return F.concat_ws("\t", *columns)


def words_of(phrase: str, n: int) -> Column:
    """The first n words, or the last -n."""
    return F.substring_index(F.col(phrase), " ", n)


def counts(docs: DataFrame, orders: tuple[int, ...], heads: DataFrame | None, least: int, name: str) -> DataFrame:
    """lang, phrase, f of the phrases found `least` times or more; those of heads (lang, head) only, if there are heads."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(heads)) if heads is not None else None
    found = docs.mapInArrow(lambda batches: counted(batches, orders, shared and shared.value), "lang string, head string, last string, f long")
    if heads is not None:
        found = join_sized(found.withColumn("k", key("lang", "head")), materialize(heads.select(key("lang", "head").alias("k")), "heads"), "k", "left_semi")
    found = found.select("lang", (F.col("last") if heads is None else F.concat_ws(" ", "head", "last")).alias("phrase"), "f")
    # dealt out before they are summed: tasks have combined their counts already, and doing it again would combine little
    sums = found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(sums.filter((F.col("f") >= least) | (F.col("phrase") == "")), name)


def wide(column: Column | str) -> Column:
    """A count as a decimal, of which products are exact."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def scored(phrases: DataFrame, known: DataFrame, order: int) -> DataFrame:
    """lang, phrase, a, best (score, k, l, r of the lowest-scoring cut), missing: whether a rest's count isn't known."""
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), words_of("phrase", k).alias("left"), words_of("phrase", k - order).alias("right")) for k in range(1, order)])).alias("cut")).select("lang", "phrase", "a", "cut.*")
    parts = known.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"], "left")
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(19,0))")
    best = F.min(F.when(F.col("r").isNotNull(), F.struct(score.alias("score"), "k", "l", "r")))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("best"), F.max(F.col("r").isNull()).alias("missing"))


def thresholds(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """lang, t: the score of the pair at that rank, or 0 if there are fewer. pairs: lang, score; langs: those to do."""
    by = Window.partitionBy("lang").orderBy(F.col("score").desc())
    at = pairs.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= rank).groupBy("lang").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    return materialize(langs.select("lang").join(at.filter(F.col("n") == rank), "lang", "left").select("lang", F.coalesce("t", F.lit(0)).alias("t")), "thresholds")


def heads_at(phrases: DataFrame, words: DataFrame, limits: DataFrame, order: int) -> DataFrame:
    """lang, head: of the phrases of an order, those to be grown at the thresholds: their bound reaches it, or they put a
    word before the start of one whose bound does and are frequent enough to replace it."""
    firsts = words.select("lang", F.col("phrase").alias("w"), F.col("f").alias("fw"))
    near = phrases.join(limits, "lang").withColumn("w", words_of("phrase", 1)).join(firsts, ["lang", "w"])
    reach = near.filter(SCALE * wide("f") >= wide("t") * (wide("fw") + wide("f"))).select("lang", F.col("phrase").alias("head"))
    reach = materialize(reach, "reach")
    starts = reach.select("lang", words_of("head", order - 1).alias("start")).distinct()
    before = phrases.withColumn("start", words_of("phrase", 1 - order)).join(starts, ["lang", "start"]).join(limits, "lang").withColumn("w", words_of("start", 1)).join(firsts, ["lang", "w"])
    before = before.filter(100 * wide("f") * (SCALE - wide("t")) >= 80 * wide("t") * wide("fw"))
    return reach.unionByName(before.select("lang", F.col("phrase").alias("head"))).distinct()


def grown(docs: DataFrame, order: int, heads: DataFrame, done: DataFrame | None, least: int) -> tuple[DataFrame | None, DataFrame]:
    """Counts of the phrases of an order with those heads that aren't done, or None if all are; the heads."""
    new = materialize(heads.join(done, ["lang", "head"], "left_anti") if done is not None else heads, "new-heads")
    return (counts(docs, (order,), new, least, f"phrases-{order}") if not new.isEmpty() else None), new


def both(one: DataFrame | None, two: DataFrame | None) -> DataFrame | None:
    return one.unionByName(two) if one is not None and two is not None else one if two is None else two


def surviving(found: DataFrame, longer: DataFrame | None, order: int) -> DataFrame:
    """found but for those that a phrase one word longer holds with 80 % of their count."""
    if longer is None:
        return found
    ends = F.array(words_of("phrase", order), words_of("phrase", -order))
    most = longer.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = found.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * wide("most") < 80 * wide("a")))
    return kept.select(*found.columns)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, guess: int = 2, widen: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases. guess, widen: the first threshold is the
    score of the guess * top th pair; each further one has widen times the pairs."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = counts(docs, (1, 2), None, least, "phrases-1")
    n = materialize(one.filter("phrase = ''").select("lang", F.col("f").alias("n")), "totals")
    words = materialize(one.filter("phrase != '' and instr(phrase, ' ') = 0"), "words")
    pairs = materialize(one.filter("instr(phrase, ' ') > 0"), "pairs")
    two = materialize(scored(pairs, words, 2), "scores-2")
    scores = two.select("lang", F.col("best.score").alias("score"))
    left, rank, settled = n.select("lang"), guess * top, None
    tri = quad = done3 = done4 = None
    while not left.isEmpty():
        limits = thresholds(scores, left, rank)
        more, new = grown(docs, 3, heads_at(pairs, words, limits, 2), done3, least)
        tri, done3 = both(tri, more), both(done3, new)
        known, three, four = words.unionByName(pairs), None, None
        if tri is not None:
            more, new = grown(docs, 4, heads_at(tri, words, limits, 3), done4, least)
            quad, done4 = both(quad, more), both(done4, new)
            three = materialize(scored(tri, known, 3), "scores-3")
            known = known.unionByName(tri)
        if quad is not None:
            four = materialize(scored(quad, known, 4), "scores-4")
            short = four.filter("missing").join(limits, "lang").filter(F.col("best.score").isNull() | (F.col("best.score") >= F.col("t")))
            rests = short.select("lang", words_of("phrase", -3).alias("rest")).select("lang", words_of("rest", 2).alias("head")).distinct()
            more, new = grown(docs, 3, rests, done3, least)
            if more is not None:
                tri, done3 = both(tri, more), both(done3, new)
                three = materialize(scored(tri, words.unionByName(pairs), 3), "scores-3")
                four = materialize(scored(quad, words.unionByName(pairs).unionByName(tri), 4), "scores-4")
        at = lambda found: found.join(limits, "lang").filter(F.col("best.score") >= F.col("t"))
        kept = surviving(at(two), tri, 2)
        kept = kept.unionByName(surviving(at(three), quad, 3)) if three is not None else kept
        kept = kept.unionByName(at(four)) if four is not None else kept
        kept = materialize(kept.select("lang", "t", "phrase", "a", "best.l", "best.r", "best.score"), "kept")
        state = limits.join(kept.groupBy("lang").count(), "lang", "left")
        now = materialize(state.filter((F.col("t") == 0) | (F.col("count") >= top)).select("lang"), "settled")
        settled = both(settled, kept.join(now, "lang").drop("t"))
        left = materialize(left.join(now, "lang", "left_anti"), "open")
        rank *= widen
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    if settled is None:
        settled = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long")
    ranked = settled.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).join(n, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
