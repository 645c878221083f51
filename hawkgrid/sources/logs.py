"""JSON-lines event logs: batch and streaming readers, parsing, typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.functions.parse import epoch_us, safe_float, safe_int
from hawkgrid.functions.repeats import with_occurrence
from hawkgrid.schema import RAW_EVENT

MAX_PAYLOAD = 5 * 1024 * 1024


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all log files under ``path`` with their file name, equal lines of a file numbered."""
    return with_occurrence(spark.read.text(path).withColumn("file", F.input_file_name()))


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream; the file limit per micro-batch is the backpressure."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
        .withColumn("file", F.input_file_name())
    )


def stream_topic(spark: SparkSession, servers: str, topic: str, offsets: str = "latest") -> DataFrame:
    """A message topic as a stream of lines; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", offsets).load()
        .select(F.col("value").cast("string").alias("value"), "offset", "partition", F.col("topic").alias("file"))
    )


def log_type(file: Column) -> Column:
    """``conn``, ``dns`` or ``ssl`` from the file name, e.g. ``/logs/conn.2024-01-01.log``."""
    return F.regexp_extract(file, r"([a-z_]+)[^/]*$", 1)


def parse_events(
    lines: DataFrame, sensor_id: str = "sensor", event_type: Column | None = None, tenant_id: int | None = None,
) -> DataFrame:
    """Parse lines, tag them, and record why a line is unusable in ``error``.

    A line needs to be a JSON object with ``ts`` and at most 5 MB; blank lines are skipped.
    An ``event_type`` inside the line wins only for topics (lines with ``offset``); for files the name decides,
    and the line is asked only where the name tells nothing. The tenant belongs to the sensor: what a
    line says about it is ignored. ``seq`` is a line's own number or, where it has none, a hash of file,
    ``uid``, ``ts``, the line and, from the second of equal lines on, its ``occurrence`` (``read_logs`` counts them; in a stream
    equal lines of a file share their number): the same on every run, so ids made from it stay the same, too.
    """
    raw = F.trim(F.col("value"))
    parsed = lines.where(F.length(raw) > 0).select(
        raw.alias("raw_payload"), F.from_json(raw, RAW_EVENT, {"mode": "PERMISSIVE"}).alias("_e"),
        F.json_object_keys(raw).alias("_keys"), *[c for c in lines.columns if c != "value"])
    inside, outside = F.col("_e.event_type"), F.nullif(log_type(F.col("file")), F.lit(""))
    by_place = F.coalesce(inside, outside) if "offset" in lines.columns else F.coalesce(outside, inside)
    kind = event_type if event_type is not None else by_place
    own = F.xxhash64("file", F.col("_e.uid"), F.col("_e.ts"), "raw_payload") if "file" in lines.columns else F.xxhash64("raw_payload")
    if "occurrence" in lines.columns:
        own = F.when(F.col("occurrence") > 1, F.xxhash64(own, "occurrence")).otherwise(own)
    error = (
        F.when(F.octet_length("raw_payload") > MAX_PAYLOAD, "Payload exceeds 5MB")
        .when(F.col("_keys").isNull(), "Malformed JSON")
        .when(~F.array_contains("_keys", "ts"), "Missing required fields (ts)")
        .when(F.col("_e.ts").isNull(), "Unreadable ts")
    )
    plain = [f.name for f in RAW_EVENT.fields if f.name not in ("event_type", "tenant_id", "seq") and "." not in f.name]
    return parsed.select(
        *[F.col(f"_e.{c}").alias(c) for c in plain],
        F.coalesce(F.col("_e.seq"), own).alias("seq"), F.lit(tenant_id).cast("bigint").alias("tenant_id"),
        F.col("_e.`id.orig_h`").alias("orig_h"), F.col("_e.`id.orig_p`").alias("orig_p"),
        F.col("_e.`id.resp_h`").alias("resp_h"), F.col("_e.`id.resp_p`").alias("resp_p"),
        kind.alias("event_type"), F.lit(sensor_id).alias("sensor_id"),
        F.current_timestamp().alias("ingestion_timestamp"), "raw_payload", error.alias("error"))


def rejected(events: DataFrame) -> DataFrame:
    """Dead letters of the parser."""
    return events.where("error is not null").select(
        "raw_payload", "error", "sensor_id", F.col("ingestion_timestamp").alias("timestamp"))


def _common(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    usable = events.where(F.col("error").isNull() & F.col("event_type").isin(*kinds))
    trace = F.coalesce(F.nullif("trace_id", F.lit("")), F.nullif("uid", F.lit("")))
    return usable.withColumns({"t_us": epoch_us(F.col("ts")), "trace_id": trace})


def conn_events(events: DataFrame) -> DataFrame:
    """Typed connections; text numbers become numbers, unset ones zero."""
    return _common(events, ("conn",)).select(
        "seq", "t_us", "uid", "trace_id", "tenant_id", "orig_h", safe_int(F.col("orig_p")).cast("int").alias("orig_p"),
        "resp_h", safe_int(F.col("resp_p")).cast("int").alias("resp_p"), "proto", "service",
        safe_float(F.col("duration")).alias("duration"), "conn_state",
        *[safe_int(F.col(c)).alias(c) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        "ja4", "event_type", "sensor_id")


def dns_events(events: DataFrame) -> DataFrame:
    """Typed DNS queries and responses."""
    return _common(events, ("dns", "dns_response")).select(
        "seq", "t_us", "uid", "trace_id", "tenant_id", "orig_h", "resp_h", "query", "qtype_name",
        F.col("rcode").try_cast("int").alias("rcode"), "rcode_name", "answers", "TTLs", "event_type", "sensor_id")
