"""Streaming jobs: log lines to alerts, alerts to incidents, and both in one query.

``every`` is the processing-time trigger (such as ``"30 seconds"``); without it a job takes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hawkgrid.operators import rules
from hawkgrid.operators.alerts import to_alerts
from hawkgrid.operators.conn_windows import conn_window_detections
from hawkgrid.operators.dns_windows import dns_window_detections
from hawkgrid.operators.enrich import enrich
from hawkgrid.sources import logs
from hawkgrid.streaming import sinks
from hawkgrid.streaming.state import stream_conn_windows, stream_dns_windows, stream_incidents

_COLUMNS = ["t_us", "seq", "source_ip", "destination_ip", "event_type", *rules.DETECTION_FIELDS]


def _detections(rows: DataFrame) -> DataFrame:
    trace = F.col("trace_id") if "trace_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(*_COLUMNS, trace.alias("trace_id"))


def stateless_alerts(events: DataFrame, ja4: DataFrame | list[str] | None = None) -> DataFrame:
    """Rule alerts of parsed events; works on a stream and on a batch alike."""
    ends = [F.col("orig_h").alias("source_ip"), F.col("resp_h").alias("destination_ip")]
    parts = []
    for found in (rules.conn_rules(logs.conn_events(events), ja4), rules.dns_rules(logs.dns_events(events))):
        parts.append(found.select("*", *ends))
    return to_alerts(reduce(DataFrame.unionByName, [_detections(p) for p in parts]))


def windowed_alerts(events: DataFrame, delay: str = "10 minutes", conn_args: dict | None = None, dns_args: dict | None = None) -> DataFrame:
    """Alerts of the stateful detectors, on a stream, with the trace id and event time of the event that fired."""
    conn = conn_window_detections(stream_conn_windows(logs.conn_events(events), delay=delay, **(conn_args or {})))
    dns = dns_window_detections(stream_dns_windows(logs.dns_events(events), delay=delay, **(dns_args or {})))
    parts = [
        conn.withColumn("event_type", F.lit("conn")),
        dns.withColumns({"event_type": F.lit("dns"), "destination_ip": F.lit(None).cast("string")})]
    return to_alerts(reduce(DataFrame.unionByName, [p.select(*_COLUMNS, "trace_id", "event_time") for p in parts]), keep=("event_time",))


def all_alerts(
    events: DataFrame, ja4: DataFrame | list[str] | None = None, delay: str = "10 minutes",
    conn_args: dict | None = None, dns_args: dict | None = None,
) -> DataFrame:
    """Rule and window alerts of one stream of events, ready for ``stream_incidents`` in the same query.

    All branches read the same events, so the furthest of them sets the watermark: a branch without new rows
    (no alert, no DNS event) must not hold back the others' state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    plain = stateless_alerts(events, ja4).withColumn("event_time", F.timestamp_micros("t_us")).withWatermark("event_time", delay)
    return plain.unionByName(windowed_alerts(events, delay, conn_args, dns_args))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark so far and were left out by the stateful steps of a query.

    They are counted by Spark per micro-batch; ``repaired`` gives their windows again.
    """
    return sum(
        int(step["numRowsDroppedByWatermark"]) for progress in query.recentProgress for step in progress["stateOperators"])


def repaired(events: DataFrame, streamed: DataFrame, windows: Callable[[DataFrame], DataFrame], keys: list[str],
             reach_us: int) -> DataFrame:
    """Batch rows of the windows that late events belong to: of all events of a key from the late one on, as far as it reaches.

    ``events`` are all stored events (key columns, t_us, seq), ``streamed`` the rows that the stream gave out (keys, t_us, seq), and
    ``windows`` the batch form. Late events are those that the stream has no row for.
    """
    late = events.join(streamed.select(*keys, "t_us", "seq"), [*keys, "t_us", "seq"], "left_anti").groupBy(*keys).agg(
        F.min("t_us").alias("_from"), F.max("t_us").alias("_to"))
    touched = events.join(late, keys).where(
        (F.col("t_us") >= F.col("_from") - reach_us) & (F.col("t_us") <= F.col("_to") + reach_us)).select(*events.columns)
    again = windows(touched)
    return again.join(late, keys).where(F.col("t_us").between(F.col("_from"), F.col("_to") + reach_us)).drop("_from", "_to")


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def start_ingest(lines: DataFrame, events_path: str, dead_path: str, checkpoint: str, sensor_id: str,
                 every: str | None = None) -> StreamingQuery:
    """Parse lines; good events and rejects go to their own logs in the same micro-batch."""
    sink = sinks.split_sink(
        lambda b: b.where("error is null").drop("error", "raw_payload"), logs.rejected, events_path, dead_path)
    return (
        logs.parse_events(lines, sensor_id).writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def start_alerts(alerts: DataFrame, path: str, checkpoint: str, ip_intel: DataFrame | None = None,
                 every: str | None = None) -> StreamingQuery:
    """Enrich alerts and append them; the intelligence table is read anew per micro-batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(enrich(batch, ip_intel), path, batch_id)

    return (
        alerts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start())


def start_rule_alerts(events: DataFrame, path: str, checkpoint: str, ja4_path: str, every: str | None = None) -> StreamingQuery:
    """Rule alerts of a stream of events; the fingerprint table (Parquet) is read anew per micro-batch, so a list that
    was replaced or extended holds from the next batch on. Rows with ``valid_from_us`` hold for events from then on.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(stateless_alerts(batch, batch.sparkSession.read.parquet(ja4_path)), path, batch_id)

    return (
        events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start())


def start_incidents(
    alerts: DataFrame, path: str, checkpoint: str, every: str | None = None, window_s: float = 300.0, min_risk: float = 50.0,
) -> StreamingQuery:
    """Correlate alerts into incidents; state and output advance together.

    ``alerts`` may be stored ones or ``all_alerts`` of a stream of events: then detectors and correlation are steps of one query.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(batch, path, batch_id)

    return (
        stream_incidents(alerts, window_s, min_risk).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start())
