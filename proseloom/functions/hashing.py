"""Deterministic hashes of names and rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def name_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash with base 31 over the characters."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    raw = F.aggregate(
        F.filter(codes, lambda c: c > 0),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + c) % F.lit(4294967296),
    )
    return F.when(raw >= F.lit(2147483648), raw - F.lit(4294967296)).otherwise(raw)


def name_seed(text: Column) -> Column:
    """Five-digit seed of a name."""
    return F.abs(name_hash(text)) % 90000 + 10000


def short_digest(*parts: Column, sep: str) -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 16)
