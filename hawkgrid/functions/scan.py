"""Running sums, maxima and previous values per key, safe for keys of any size.

A plain ``Window.partitionBy(key)`` puts each key into one task. Keys with more
than ``hot_rows`` rows take another way: their rows are range-partitioned by
(key, order), so one key spans many tasks; each chunk is scanned on its own, and
per-chunk totals (at most chunks + keys rows) carry the state from chunk to chunk.
Both ways give the same result; the order columns must be unique within a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.session import durable

HOT_ROWS = 5_000_000
_BROADCAST_KEYS = 100_000
_CHUNK = "_chunk"


@dataclass
class HotKeys:
    """Keys above the limit, and how many rows they hold together."""

    keys: DataFrame
    n_keys: int
    n_rows: int
    hot_rows: int

    @property
    def chunks(self) -> int:
        return -(-self.n_rows // self.hot_rows) + 1


def find_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows, or None.

    One aggregation with map-side combine over the key columns only.
    """
    return hot_from_counts(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, hot_rows)


def hot_from_counts(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """As ``find_hot``, from a table that already has the rows per key in ``_n``."""
    heavy = counts.where(F.col("_n") > hot_rows)
    seen = heavy.agg(F.count("*").alias("k"), F.sum("_n").alias("n")).first()
    if not seen["k"]:
        return None
    return HotKeys(durable(heavy.select(*keys)), seen["k"], seen["n"], hot_rows)


def _split(df: DataFrame, keys: list[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    # The key list is counted, so broadcasting it is bounded; longer lists shuffle.
    side = F.broadcast(hot.keys) if hot.n_keys <= _BROADCAST_KEYS else hot.keys
    columns = df.columns
    return df.join(side, keys, "left_anti").select(*columns), df.join(side, keys, "left_semi").select(*columns)


def _ranged(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    # Range bounds are sampled, so the chunk numbers are written out once and reused.
    return durable(
        df.repartitionByRange(max(2, chunks), *keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    )


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], hot: HotKeys | None
) -> DataFrame:
    """Add inclusive running sums of the given expressions, per key in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = {name: F.sum(expr).over(w) for name, expr in sums.items()}
    if hot is None:
        return df.withColumns(plain)
    cold, heavy = _split(df, keys, hot)
    ranged = _ranged(heavy, keys, order, hot.chunks)
    inside = Window.partitionBy(_CHUNK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(_CHUNK, *keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    carry = totals.select(
        _CHUNK, *keys, *[F.sum(n).over(before).alias(f"_carry_{n}") for n in sums]
    )
    scanned = (
        ranged.withColumns({n: F.sum(e).over(inside) for n, e in sums.items()})
        .join(carry, [_CHUNK, *keys], "left")
        .withColumns({
            n: F.when(F.col(f"_carry_{n}").isNull(), F.col(n))
            .when(F.col(n).isNull(), F.col(f"_carry_{n}"))
            .otherwise(F.col(n) + F.col(f"_carry_{n}"))
            for n in sums
        })
    )
    return cold.withColumns(plain).unionByName(scanned.select(*df.columns, *sums))


def running_max(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], hot: HotKeys | None
) -> DataFrame:
    """Add the highest value before each row, per key in order; null at a key's first row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = {name: F.max(expr).over(w) for name, expr in values.items()}
    if hot is None:
        return df.withColumns(plain)
    cold, heavy = _split(df, keys, hot)
    ranged = _ranged(heavy, keys, order, hot.chunks)
    inside = Window.partitionBy(_CHUNK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy(_CHUNK, *keys).agg(*[F.max(e).alias(n) for n, e in values.items()])
    carry = tops.select(_CHUNK, *keys, *[F.max(n).over(before).alias(f"_carry_{n}") for n in values])
    scanned = (
        ranged.withColumns({n: F.max(e).over(inside) for n, e in values.items()})
        .join(carry, [_CHUNK, *keys], "left")
        # greatest() skips nulls.
        .withColumns({n: F.greatest(n, f"_carry_{n}") for n in values}))
    return cold.withColumns(plain).unionByName(scanned.select(*df.columns, *values))


def previous_values(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], hot: HotKeys | None
) -> DataFrame:
    """Add the last non-null value before each row, per key in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = {name: F.last(expr, ignorenulls=True).over(w) for name, expr in values.items()}
    if hot is None:
        return df.withColumns(plain)
    cold, heavy = _split(df, keys, hot)
    ranged = _ranged(heavy, keys, order, hot.chunks)
    inside = Window.partitionBy(_CHUNK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)
    finals = ranged.groupBy(_CHUNK, *keys).agg(
        *[F.max_by(e, F.when(e.isNotNull(), rank)).alias(n) for n, e in values.items()]
    )
    carry = finals.select(
        _CHUNK, *keys, *[F.last(n, ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values]
    )
    scanned = (
        ranged.withColumns({n: F.last(e, ignorenulls=True).over(inside) for n, e in values.items()})
        .join(carry, [_CHUNK, *keys], "left")
        .withColumns({n: F.coalesce(F.col(n), F.col(f"_carry_{n}")) for n in values})
    )
    return cold.withColumns(plain).unionByName(scanned.select(*df.columns, *values))
