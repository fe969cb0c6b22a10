"""Eligibility filters and constraint reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(**checks: Column) -> Column:
    """Array of the names of the checks that hold; a check on a null counts as holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))


def eligible(level: Column, citation_eligible: Column, status: Column, allow_pending: bool = False) -> Column:
    """Level A or B, may be cited, and active (or pending where that is allowed)."""
    active = F.lit(True) if allow_pending else F.coalesce(status == "ACTIVE", F.lit(False))
    return level.isin("A", "B") & F.coalesce(citation_eligible, F.lit(False)) & active


def rerank_dense(df: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """df with rank counted anew from 1 within each group after a filter."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def protected(name: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def pending_fields(df: DataFrame, fields: list[str], prefix: str = "PENDING_") -> DataFrame:
    """field, n: how many rows hold a value that starts with the prefix, for each field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field").agg(F.count_if(F.col("p.value").startswith(prefix)).alias("n"))


def page_mode(text: Column, image_ratio: Column | float = 0.0) -> Column:
    """native, hybrid or scanned, by visible characters and the share of images."""
    n = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    ratio = F.lit(image_ratio) if isinstance(image_ratio, float) else image_ratio
    return F.when((n >= 50) & (ratio < 0.10), "native").when(n >= 20, "hybrid").otherwise("scanned")


def private_keys(json: Column, names: tuple[str, ...]) -> Column:
    """Whether any object in the JSON text has one of the keys, at any depth."""
    return json.rlike(r'"(?:' + "|".join(names) + r')"\s*:')
