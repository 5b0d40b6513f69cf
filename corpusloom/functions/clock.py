"""Microseconds since 1970, independent of the session time zone where the data has none."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .hashing import as_col


def epoch_micros(c, dtype: T.DataType) -> Column:
    """Instant of a zoned timestamp; wall-clock microseconds of anything else."""
    c = as_col(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c.cast("timestamp"))
    span = c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")

    def part(unit: str, micros: int) -> Column:
        return (F.extract(F.lit(unit), span).cast("decimal(20,6)") * F.lit(micros).cast("decimal(12,0)")).cast("bigint")

    return part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)
