"""Defensive parsing of log values: '-', empty and malformed values count as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("-")).try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("-")).try_cast("double"), F.lit(0.0))


def epoch_us(seconds: Column) -> Column:
    """Epoch seconds (float) to whole microseconds, so window bounds are exact."""
    return F.round(seconds * 1_000_000).cast("bigint")
