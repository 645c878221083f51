"""Labelled evaluation sets in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.functions.flow import zeek_state
from hawkgrid.functions.parse import epoch_us
from hawkgrid.functions.repeats import with_occurrence

_FLOW = ["orig_bytes", "resp_bytes", "tot_pkts"]


def _csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Columns by header name, whatever their order; the header alone is read up front."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return rows


def domains(spark: SparkSession, path: str) -> DataFrame:
    """``label,family,domain`` without header; label ``dga`` or anything else."""
    rows = spark.read.schema("label string, family string, domain string").csv(path)
    return rows.select(
        (F.trim("label") == "dga").alias("is_dga"), F.trim("family").alias("family"), F.trim("domain").alias("domain"))


def rule_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows for the rule check, as connection rows with label and scenario."""
    rows = _csv(spark, path, ["label", "scenario", "dport", "state", *_FLOW])
    return rows.select(
        (F.col("label") == "botnet").alias("is_botnet"), "scenario", F.col("dport").cast("int").alias("resp_p"),
        zeek_state(F.col("state")).alias("conn_state"), F.col("orig_bytes").cast("double").alias("orig_bytes"),
        F.col("resp_bytes").cast("double").alias("resp_bytes"),
        F.col("tot_pkts").cast("double").cast("bigint").alias("orig_pkts"),
        F.lit("").alias("ja4"), F.lit("conn").alias("event_type"))


def flow_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Flows for the anomaly model; label, scenario when present."""
    rows = _csv(spark, path, ["label", *_FLOW, "duration"])
    keep = ["label"] + ["scenario"] * ("scenario" in rows.columns)
    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in (*_FLOW, "duration")])


def composite_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows with endpoints and time, for replaying all connection detectors."""
    rows = _csv(spark, path, ["label", "scenario", "dport", "state", *_FLOW, "duration", "src_addr", "dst_addr",
                              "timestamp"])
    # The scenario becomes part of the sequence key, so equal times keep a fixed order; equal rows are told apart by number.
    rows = with_occurrence(rows)
    order = F.xxhash64(*[F.col(c) for c in rows.columns])
    return rows.select(
        (F.col("label") == "botnet").alias("is_botnet"), "scenario", F.col("src_addr").alias("orig_h"),
        F.col("dst_addr").alias("resp_h"), epoch_us(F.col("timestamp").cast("double")).alias("t_us"),
        order.alias("seq"), F.col("dport").cast("int").alias("resp_p"),
        zeek_state(F.col("state")).alias("conn_state"),
        F.col("orig_bytes").cast("double").cast("bigint").alias("orig_bytes"),
        F.col("resp_bytes").cast("double").cast("bigint").alias("resp_bytes"),
        F.col("tot_pkts").cast("double").cast("bigint").alias("orig_pkts"),
        F.col("duration").cast("double").alias("duration"), F.lit("").alias("ja4"), F.lit("conn").alias("event_type"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()
