"""Occurrence numbers of equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 65_536


def with_occurrence(rows: DataFrame, name: str = "occurrence") -> DataFrame:
    """Number equal rows 1, 2, ...: the same on every run, whatever their order.

    Equal rows are counted with map-side combine and written out again in chunks that spread over all tasks, so a row that is a
    third of the input is neither sorted nor held in one place. For batches; a stream sees a repeat as the same row.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    chunks = counted.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_CHUNK}"))))
    first, last = F.col("_c") * _CHUNK + 1, F.least("_n", (F.col("_c") + 1) * _CHUNK)
    return chunks.repartition("_c", *columns).withColumn(name, F.explode(F.sequence(first, last))).drop("_n", "_c")
