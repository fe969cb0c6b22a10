"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. Near duplicates are documents of a Jaccard similarity of five-word shingles of about 0.8 or more. SQL cannot tokenise or fit the packing, so ORACLE_SQL is None; the stages are tested against brute force.
"""

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import line_dedup, mixing, packing, quality_rules, simhash
from lexmill.llm.queries import TOKENIZER
from lexmill.session import table
from lexmill.storage import materialize, remove, scratch, spread


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own intermediate tables, and its input, go once its result is written."""
    docs, before = spread(table(spark, sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            written = [made.pop()]
        remove(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
