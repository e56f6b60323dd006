"""Deterministic order, splits and priorities from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(seed: str, key: str | Column) -> Column:
    """Hex digest of ``seed:key``; sort by it, then by the key."""
    return F.sha2(F.concat(F.lit(seed + ":"), _col(key).cast("string")).cast("binary"), 256)


def leading_bits(digest: Column, first_hex: int = 1) -> Column:
    """64 bits of a hex digest as an unsigned number, from the given hex digit (1-based)."""
    return F.conv(F.substring(digest, first_hex, 16), 16, 10).cast("decimal(20,0)")


def bucket(seed: str, key: str | Column, buckets: int = 10) -> Column:
    return (leading_bits(hash_order(seed, key)) % buckets).cast("int")


def group_split(seed: str, group: str | Column) -> Column:
    """development 60 %, calibration 20 %, test 20 % of groups."""
    b = bucket(seed, group)
    return F.when(b < 6, "development").when(b < 8, "calibration").otherwise("test")


def work_bucket(seed: str, ordinal: str | Column) -> Column:
    """0-5 support, 6-7 development context, 8 calibration, 9 test."""
    return bucket(seed, ordinal)


def work_priority(seed: str, ordinal: str | Column) -> Column:
    """The digest's second 64 bits as fixed-width hex: ordering it is ordering the number."""
    return F.substring(hash_order(seed, ordinal), 17, 16)
