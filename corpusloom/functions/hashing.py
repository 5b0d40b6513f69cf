"""Seeded row hashes: the repeatable stand-in for a random generator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def row_hash(seed, *keys) -> Column:
    """md5 of `seed:key1:key2…`. The keys must identify the row, so that no two rows tie."""
    parts = [F.coalesce(as_col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_unit(digest: Column) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of a hex digest; ordered like the digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def uniform(seed, *keys) -> Column:
    return hash_unit(row_hash(seed, *keys))


def hash_token(token) -> Column:
    """Token id: '' is 0, otherwise the first 32 bits of sha1 folded into 1…8191."""
    token = as_col(token)
    folded = F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % F.lit(8191) + F.lit(1)
    return F.when(token == "", F.lit(0).cast("bigint")).otherwise(folded)
