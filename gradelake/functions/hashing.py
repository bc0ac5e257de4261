"""Fingerprints and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """sha256 of the columns as JSON, keys sorted, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def hash_user(user: Column) -> Column:
    return F.substring(F.sha2(user, 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in order."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619) % 4294967296)
