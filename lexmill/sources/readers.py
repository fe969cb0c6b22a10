"""Readers for files that a document corpus comes in."""

import gzip
import io
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.storage import partitions

SUFFIXES = ("md", "txt", "markdown")
MAX_DOCX = 10 << 20


def text_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """source, content of every text file under the folder; one row a file."""
    glob = "*.{" + ",".join(suffixes) + "}"
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = (), unique: str | None = None) -> DataFrame:
    """Strict JSON lines: blank lines are skipped; a bad line, a blank required field, a repeated id or no row at all is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path"))
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = lines.withColumn("row", F.from_json("value", kind))
    bad = F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{")
    for c in required:
        bad = bad | F.col(f"row.{c}").isNull() | (F.trim(F.col(f"row.{c}").cast("string")) == "")
    found = parsed.agg(F.count("*").alias("n"), F.min(F.when(bad, F.concat_ws(": ", "file", F.left("value", F.lit(80))))).alias("bad")).first()
    if not found["n"]:
        raise ValueError(f"{path} has no rows")
    if found["bad"]:
        raise ValueError(f"bad line in {found['bad']}")
    rows = parsed.select("row.*")
    if unique and (twice := rows.groupBy(unique).count().filter("count > 1").first()):
        raise ValueError(f"{unique} {twice[unique]} occurs {twice['count']} times in {path}")
    return rows


def json_object(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def parquet_roles(spark: SparkSession, folder: str, roles: tuple[str, ...]) -> dict[str, DataFrame]:
    """One Parquet file a role, told by the role in its name; none or two are an error."""
    out = {}
    for role in roles:
        named = spark.read.format("binaryFile").option("pathGlobFilter", f"*{role}*.parquet").option("recursiveFileLookup", "true").load(folder).select("path").take(2)
        if len(named) != 1:
            raise ValueError(f"{folder} needs exactly one Parquet file of {role}")
        out[role] = spark.read.parquet(named[0]["path"])
    return out


def front_matter(content: Column, marker: str) -> tuple[Column, Column]:
    """The JSON header of a Markdown file and the body after the marker's line."""
    header = F.regexp_extract(content, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    body = F.regexp_extract(content, rf"(?s)(?:\A|\n){marker}[^\n]*\n\s*(.*?)\s*\z", 1)
    return header, body


def qa_markdown(df: DataFrame, content: str) -> DataFrame:
    """question, answer of each `## user` section followed by an `## assistant` one."""
    turns = F.regexp_extract_all(F.col(content), F.lit(r"(?s)## user\s*\n(.*?)(?=\n## |\z)\n?## assistant"), F.lit(1))
    answers = F.regexp_extract_all(F.col(content), F.lit(r"(?s)## assistant\s*\n(.*?)(?=\n## |\z)"), F.lit(1))
    pairs = df.select(F.explode(F.arrays_zip(turns.alias("q"), answers.alias("a"))).alias("p"))
    return pairs.select(F.trim("p.q").alias("question"), F.trim("p.a").alias("answer")).filter("question != '' AND answer != ''")


def stripped(text: Column) -> Column:
    """text without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def qa_pairs(spark: SparkSession, path: str, kind: str, limit: int = 20) -> DataFrame:
    """question, answer of a set of question files, in order of their place: kind `md` is a folder of Markdown files of one pair each,
    `jsonl` lines with user and assistant, `json` one array of such objects.

    The first `limit` items count, whether they are valid or not; of these the ones without a question or an answer are left
    out, so fewer than the limit may come though more valid ones follow. A Markdown file without a pair is no item; a line
    that isn't JSON, or a file that isn't an array, is an error.
    """
    if kind == "md":
        parts = F.split(stripped(F.col("content")), "## assistant", -1)
        user = stripped(parts[0])
        question = stripped(F.when(F.lower(user).startswith("## user"), F.substr(user, F.lit(8))).otherwise(user))
        files = text_files(spark, path, ("md",)).withColumn("parts", parts).filter(F.size("parts") > 1)
        items = files.select(F.struct("source").alias("at"), question.alias("question"), stripped(F.col("parts")[1]).alias("answer")).filter("question != '' and answer != ''")
    elif kind == "jsonl":
        lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
        items = _pairs(lines.filter(stripped(F.col("value")) != "").select("at", F.parse_json("value").alias("v")))
    elif kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        if whole.filter(F.coalesce(~F.schema_of_variant("v").startswith("ARRAY"), F.lit(True))).count():
            raise ValueError(f"{path} isn't an array")
        items = _pairs(whole.select(F.posexplode(F.expr("cast(v as array<variant>)")).alias("at", "v")).withColumn("at", F.struct("at")))
    else:
        raise ValueError(f"{kind} is none of md, jsonl, json")
    return items.orderBy("at").limit(limit).filter("question != '' and answer != ''").select("question", "answer")


def _pairs(items: DataFrame) -> DataFrame:
    """Place, question and answer of objects; what they lack or hold as null is empty."""
    said = lambda name: stripped(F.coalesce(F.variant_get("v", f"$.{name}", "string"), F.lit("")))
    return items.select("at", said("user").alias("question"), said("assistant").alias("answer"))


def json_from_model(text: Column) -> Column:
    """The JSON object in a model's answer as a variant: fences stripped, else from the first { to the last }; null if there is none.

    Texts that can't be JSON by their first character aren't parsed, as each failure costs an exception."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (last > first) & F.endswith(F.substring(text, F.lit(1), last), F.lit("}")), F.substring(text, first, last - first + 1))
    return F.coalesce(F.try_parse_json(F.when(bare.rlike(r'^[\[{"\-0-9tfn]'), bare)), F.try_parse_json(inner))


def _docx_text(content: bytes) -> str:
    """Paragraphs, and tables a row a line with cells between bars, of a Word file; only the body's own order counts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    name = lambda e: e.tag.rpartition("}")[2]
    said = lambda e: "".join(x.text or "" for x in e.iter() if name(x) == "t").strip()
    lines = []
    for part in next(e for e in root if name(e) == "body"):
        if name(part) == "p":
            lines.append(said(part))
        elif name(part) == "tbl":
            lines += [" | ".join(said(c) for c in row if name(c) == "tc") for row in part if name(row) == "tr"]
    return "\n".join(x for x in lines if x)


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, content, error of the Word files under the folder; files over MAX_DOCX or broken ones have an error."""

    @F.pandas_udf("content string, error string")
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            try:
                rows.append((_docx_text(c), None) if len(c) <= MAX_DOCX else (None, "too large"))
            except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration) as bad:
                rows.append((None, type(bad).__name__))
        return pd.DataFrame(rows, columns=["content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select(F.col("path").alias("source"), read("content").alias("r")).select("source", "r.*")


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """source, member, content (as packed), error of the members of ZIP files whose names end so, dealt over all tasks; a file
    that can't be opened is a row without a member."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")):
                            try:
                                row = (source, name, z.read(name), None)
                            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as bad:
                                row = (source, name, None, f"{type(bad).__name__}: {bad}")
                            yield pd.DataFrame([row], columns=["source", "member", "content", "error"])
                except zipfile.BadZipFile as bad:
                    yield pd.DataFrame([(source, None, None, f"{type(bad).__name__}: {bad}")], columns=["source", "member", "content", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(members, "source string, member string, content binary, error string").repartition(max(partitions(spark), spark.sparkContext.defaultParallelism))


def zipped_json_lines(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """source (file!member), record (from 1, blank lines not counted), value, error of the lines in the gzip members of ZIP
    files. Members are unpacked by many tasks, some `rows` lines at a time; what stops a member or a file is a row with the
    error, behind the records before it."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "record", "value", "error"]
        for batch in batches:
            for source, member, content, error in batch.itertuples(index=False):
                name, held, n = f"{source}!{member}" if member else source, [], 0
                try:
                    if error is None:
                        with gzip.open(io.BytesIO(content), "rt", encoding="utf-8") as said:
                            for line in said:
                                if line.strip():
                                    n += 1
                                    held.append((name, n, line.rstrip("\n"), None))
                                    if len(held) == rows:
                                        yield pd.DataFrame(held, columns=columns)
                                        held = []
                except (OSError, EOFError, zlib.error, UnicodeDecodeError) as bad:
                    error = f"{type(bad).__name__}: {bad}"
                if error is not None:
                    held.append((name, n + 1, None, error))
                yield pd.DataFrame(held, columns=columns).astype({"record": "int64"})

    return archive_members(spark, path, ".gz").mapInPandas(lines, "source string, record long, value string, error string")


def form_feed_pages(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, page_no, text of pages between form feeds; blank pages at the end are dropped."""
    whole = F.regexp_replace(F.col(text), r"(?:\f\s*)+\z", "")
    return df.select(doc, F.posexplode(F.split(whole, "\f")).alias("_p", "text")).select(doc, (F.col("_p") + 1).alias("page_no"), "text")


def catalogue(spark: SparkSession, database: str = "default") -> DataFrame:
    """table, column of every table in the database."""
    rows = [(t.name, c.name) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(f"{database}.{t.name}")]
    return spark.createDataFrame(rows, "table string, column string")
