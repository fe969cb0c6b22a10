"""Queries on models of language that are learned from the documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import language as L
from lexmill.session import table
from lexmill.storage import spread


def detected_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, by a model of a third of them."""
    docs = table(spark, sf, "documents")
    model = L.fit_language(docs.filter("doc_id % 3 = 0"))
    found = L.with_language(spread(docs.select("doc_id", "text")), model)
    return found.select("doc_id", "found_lang", F.round("confidence", 6).alias("confidence"))


def segmented_words(spark: SparkSession, sf: str) -> DataFrame:
    """Passages without their blanks, cut into words by a model of the documents without theirs."""
    bare = lambda name: F.regexp_replace(F.lower(name), r"\s+", "")
    docs = table(spark, sf, "documents").filter("lang = 'en'").select(bare("text").alias("text"))
    model = L.fit_words(docs, longest=6, max_texts=1000)
    passages = table(spark, sf, "benchmark").select("item_id", bare("text").alias("text"))
    return L.with_words(spread(passages), model).select("item_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


QUERIES = {f.__name__: f for f in (detected_languages, segmented_words)}
SQL: dict[str, str] = {}
