"""Stable identifiers and fingerprints from built-in hashes."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID (version 5) of name in the namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def numbered(prefix: str, number: Column, width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def signature(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON with sorted keys; name them."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
