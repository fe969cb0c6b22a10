"""Connected components of links by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.toDF("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each linked node but the roots. links: columns a, b of one sortable type, a != b.

    Minima are combined before each shuffle and written, so that both sides of the join with the links are plain shuffles
    and AQE can split a hot node's links. Each round is written to the shared folder, so the lineage stays short; rounds
    grow with the logarithm of a component's size.
    """
    edges = materialize(links.select("a", "b").distinct(), "links")
    before, now = None, _mark(edges)
    while before != now and now[0]:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        before, now = now, _mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
