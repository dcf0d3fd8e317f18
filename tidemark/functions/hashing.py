"""Stable hashes of keys: seeded digests, uniform numbers, buckets and group ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(value: Column, seed: int | None = None) -> Column:
    """SHA-256 hex of ``value``, or of ``seed:value``."""
    text = value.cast("string")
    return F.sha2(text if seed is None else F.concat(F.lit(f"{seed}:"), text), 256)


def prefix_number(digest: Column, digits: int = 16) -> Column:
    """The first hex digits of a digest as an exact number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def uniform(digest: Column) -> Column:
    """First 64 bits of a digest as a number in [0, 1)."""
    return prefix_number(digest).cast("double") / F.lit(float(2**64))


def uniform32(digest: Column) -> Column:
    """First 32 bits of a digest as a number in [0, 1]."""
    return prefix_number(digest, 8).cast("double") / F.lit(float(0xFFFFFFFF))


def bucket(value: Column, buckets: int) -> Column:
    """First 64 bits of the digest of ``value`` modulo ``buckets``."""
    return F.pmod(prefix_number(stable_hash(value)), F.lit(buckets)).cast("int")


def group_id(value: Column, prefix: str = "GROUP_") -> Column:
    """Short stable id of a group: a prefix and 16 hex digits."""
    return F.concat(F.lit(prefix), F.substring(stable_hash(value), 1, 16))
