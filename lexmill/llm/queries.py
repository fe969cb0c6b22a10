"""The registered queries of the training-data operators."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chat, embedding_dups, exact_dedup, filter_audit, html_text, licences, line_dedup, mixing, oracles, packing, phrases, quality_classifier, quality_rules, simhash
from lexmill.session import table
from lexmill.storage import spread

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A conversation whose texts hold control strings of common templates.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of all documents."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir, "doc_id", "text", "source"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir, "doc_id", "text", "source"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.prefix_trees(said.unionByName(tricky)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = licences.with_licences(docs, "found").withColumn("n_words", licences.n_words())
    return found.select("doc_id", "n_words", *[F.col(f"found.{c}") for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(documents(spark, sf_dir, "doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = line_dedup.dedup_lines(docs, lines="n_lines", dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_stream(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir, "text", "lang"))


def op13_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_embeddings(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


def queries() -> dict:
    found = (op1_quality_rules, op2_packing, op3_mixing, op4_chat_format, op5_exact_dedup, op6_simhash, op7_html_text, op8_licences, op9_quality_classifier, op10_line_dedup, op11_filter_audit, op12_phrases, op13_embedding_dups)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
