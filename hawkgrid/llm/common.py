"""Shared pieces: Arrow batches of texts, typed batches back, row identity, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.session import durable

LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def key_of(doc_id: str = "doc_id") -> Column:
    """A document's number for ordering and joining; rows without one count as the largest number."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema, strict=True)], schema=schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (node, component), the smallest reachable node.

    Alternating large-star and small-star steps: every node points its larger, then its smaller
    neighbours at the smallest node it knows, until nothing changes. Each step is a minimum
    with map-side combine and an equi-join, so a component of any size is never gathered in
    one place, and what is carried over is written to the shared folder. Self-links are allowed
    and give single nodes; null ends are ignored.
    """
    # Links may be costly to find: written once, read for the nodes and for the steps.
    stored = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    nodes = stored.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = stored.where("u <> v")
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct())
        links = durable(small)
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes.node == root.u, "left").select(
        "node", F.coalesce("component", "node").alias("component"))
