"""Sinks: keyed upserts into versioned folders, JSON lines with a manifest, reports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.store import upsert
from lexmill.storage import exists

PROTECTED = ("prod_", "legal_active_")


def guard(name: str, exists: bool, resume: bool = False, protected: tuple[str, ...] = PROTECTED) -> None:
    """Refuse protected names, and existing targets unless a run is resumed."""
    if name.startswith(protected):
        raise ValueError(f"{name} is protected")
    if exists and not resume:
        raise ValueError(f"{name} exists; resume to go on with it")


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """One immutable version of a table; readers take the last one."""
    path = f"{folder}/version={version:08d}"
    df.write.mode("error").parquet(path)
    return path


def upsert_version(spark: SparkSession, folder: str, new: DataFrame, version: int, *key: str) -> str:
    """Version n from version n - 1 and the new rows: rows with a new row's key are replaced."""
    before = f"{folder}/version={version - 1:08d}"
    rows = upsert(spark.read.parquet(before), new, *key) if exists(spark, before) else new
    return write_version(rows, folder, version)


def json_line(columns: list[str]) -> Column:
    """The row as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))


def export(df: DataFrame, folder: str) -> DataFrame:
    """Write sorted-key JSON lines; a one-row manifest of what was written: rows and a digest that ignores their order."""
    lines = df.select(json_line(df.columns).alias("value"))
    lines.write.mode("error").text(f"{folder}/rows")
    written = df.sparkSession.read.text(f"{folder}/rows")
    manifest = written.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", F.bit_xor(F.xxhash64("value")).cast("string"), F.sum(F.length("value")).cast("string")), 256).alias("digest"))
    manifest.coalesce(1).write.mode("error").json(f"{folder}/manifest")
    return df.sparkSession.read.json(f"{folder}/manifest")


def csv(df: DataFrame, folder: str) -> None:
    df.write.mode("error").option("header", "true").csv(folder)


def replace_pages(pages: DataFrame, folder: str, by: str) -> None:
    """Replace all pages of the parents in pages, and of no others."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def points(chunks: DataFrame, namespace, doc_id: str = "doc_id", index: str = "chunk_index", text: str = "chunk") -> DataFrame:
    """point_id, chunk_id, doc_id, sha256, chunk_text of each chunk; ids depend on document and place only."""
    from lexmill.functions.ids import text_sha256, uuid5

    chunk_id = F.concat_ws("#", F.col(doc_id).cast("string"), F.col(index).cast("string"))
    return chunks.select(uuid5(namespace, chunk_id).alias("point_id"), chunk_id.alias("chunk_id"), doc_id, text_sha256(F.col(text)).alias("sha256"), F.col(text).alias("chunk_text"))


def markdown_report(df: DataFrame, title: str, order: str) -> DataFrame:
    """One row, report: a Markdown table of a summary's rows; for frames of known, small size."""
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in df.columns]), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), cell.alias("c")))), lambda x: x["c"]), "\n")).alias("report"))
