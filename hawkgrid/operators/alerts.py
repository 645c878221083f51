"""Alerts: construction from detections, validation, latest-per-key upsert, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.functions.net import normalise_ip
from hawkgrid.schema import ALERT

# Fixed values of the alert contract.
SCHEMA_VERSION = "1.0"
MODEL_VERSION = "1.0"
DEFAULT_ADDRESS = "127.0.0.1"
DEFAULT_CONFIDENCE = 0.9
SEVERITIES = ["low", "medium", "high", "critical"]
REQUIRED = [
    "timestamp", "alert_id", "event_type", "threat_class", "confidence_score", "severity", "source_ip",
    "schema_version",
]


def _or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def to_alerts(detections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alert rows from detections with ``source_ip, destination_ip, t_us, seq, event_type``.

    The id is derived from rule and event, so a recomputed row keeps its id.
    """
    trace = [F.nullif(F.col(c), F.lit("")) for c in ("trace_id", "uid") if c in detections.columns]
    alert_id = F.concat(F.col("rule_id"), F.lit("-"), F.col("seq").cast("string"))
    confidence = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, DEFAULT_CONFIDENCE).otherwise(
        F.col("confidence"))
    return detections.select(
        alert_id.alias("alert_id"), "t_us", "seq",
        _or_default(F.col("source_ip"), DEFAULT_ADDRESS).alias("source_ip"),
        _or_default(F.col("destination_ip"), DEFAULT_ADDRESS).alias("destination_ip"),
        "threat_class", "severity", confidence.alias("confidence_score"), "evidence",
        _or_default(F.col("event_type"), "unknown").alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), _or_default(F.col("rule_id"), "Unknown").alias("model_name"),
        F.lit(MODEL_VERSION).alias("model_version"), "mitre_tactic", "mitre_technique",
        F.coalesce(*trace, F.concat(F.lit("trc-"), F.substring(F.md5(alert_id), 1, 16))).alias("trace_id"), *keep,
    )


def _is_iso(value: Column) -> Column:
    shaped = value.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return shaped & value.try_cast("timestamp").isNotNull()


def validation_errors(alerts: DataFrame, extra_fields: Column | None = None) -> Column:
    """All contract violations of a row as sorted-by-check messages; empty when valid.

    ``extra_fields`` is an array with field names outside the contract, if the reader
    kept them; the contract is closed, so any of them is an error.
    """
    have = set(alerts.columns)
    checks = [
        (F.col(c).isNull() if c in have else F.lit(True), F.lit(f"'{c}' is a required property")) for c in REQUIRED
    ]

    def check(column: str, bad, message: str) -> None:
        if column in have:
            checks.append((F.col(column).isNotNull() & bad(F.col(column)), F.lit(message)))

    check("timestamp", lambda c: ~_is_iso(c), "timestamp is not a 'date-time'")
    check("severity", lambda c: ~c.isin(SEVERITIES), "severity is not one of the allowed values")
    check("schema_version", lambda c: c != SCHEMA_VERSION, "schema_version is not one of the allowed values")
    for column in ("source_ip", "destination_ip"):
        check(column, lambda c, name=column: normalise_ip(name).isNull(), f"{column} is not a 'ip-address'")
    check("evidence", lambda c: F.get_json_object(c, "$").isNull() | ~F.ltrim(c).startswith("{"),
          "evidence is not of type 'object'")
    if extra_fields is not None:
        checks.append((F.size(extra_fields) > 0, F.concat(
            F.lit("additional properties are not allowed: "), F.array_join(extra_fields, ", "))))
    return F.array_compact(F.array(*[F.when(cond, message) for cond, message in checks]))


def validate(alerts: DataFrame, extra_fields: Column | None = None) -> DataFrame:
    """Add ``errors``; split with ``size(errors) = 0`` into valid rows and dead letters."""
    return alerts.withColumn("errors", validation_errors(alerts, extra_fields))


def dead_letters(validated: DataFrame, now: Column | None = None) -> DataFrame:
    """Rejected rows as ``error, alert (JSON), timestamp``."""
    body = [c for c in validated.columns if c not in ("errors", "_extra", "_raw")]
    original = F.col("_raw") if "_raw" in validated.columns else F.to_json(F.struct(*body))
    return validated.where(F.size("errors") > 0).select(
        F.concat(F.lit("SchemaValidationError: "), F.array_join("errors", "; ")).alias("error"),
        original.alias("alert"), (now if now is not None else F.current_timestamp()).alias("timestamp"))


def parse_alerts(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to contract columns, plus names of unknown fields and the raw text."""
    raw = F.col(column)
    names = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    known = F.array(*[F.lit(f.name) for f in ALERT.fields])
    return lines.select(
        F.from_json(raw, ALERT, {"mode": "PERMISSIVE"}).alias("_a"), F.array_except(names, known).alias("_extra"),
        raw.alias("_raw"), *[c for c in lines.columns if c != column],
    ).select("_a.*", "_extra", "_raw", *[c for c in lines.columns if c != column])


def last_per_key(alerts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; ties are settled by ``order`` alone, so it must be unique."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return alerts.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def upsert(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with the batch applied: update where (tenant, alert id) exists, else insert.

    Within the batch the last row per key wins. Both key columns take part, so one
    tenant's batch cannot change another tenant's row.
    """
    keys = ["tenant_id", "alert_id"]
    incoming = last_per_key(batch, keys, order)
    untouched = target.join(incoming.select(*keys), keys, "left_anti")
    return untouched.unionByName(incoming.select(*target.columns))


def replay_dead_letters(lines: DataFrame, limit: int | None = None, column: str = "value") -> DataFrame:
    """Alerts inside dead-letter lines as JSON text, with ``is_replay`` set; unusable lines are skipped.

    The flag lets a replayed alert pass the repeat check of the correlation; ``as_replay`` puts it into the message.
    """
    raw = F.col(column)
    is_object = F.json_object_keys(raw).isNotNull()
    alert = F.get_json_object(raw, "$.alert")
    found = lines.where(is_object & F.array_contains(F.json_object_keys(raw), "alert")).select(
        alert.alias("value"), F.get_json_object(raw, "$.error").alias("original_error"), F.lit(True).alias("is_replay"))
    return found if limit is None else found.limit(limit)


def as_replay(message: Column) -> Column:
    """An alert message (JSON object text) with ``is_replay`` true."""
    body = F.ltrim(message)
    marked = F.array_contains(F.json_object_keys(message), "is_replay")
    rest = F.ltrim(F.substr(body, F.lit(2)))
    return F.when(marked, F.regexp_replace(message, r'"is_replay"\s*:\s*(?:true|false|null)', '"is_replay":true')).otherwise(
        F.concat(F.lit('{"is_replay":true'), F.when(rest.startswith("}"), "").otherwise(","), rest))


def backfill_tenant(rows: DataFrame, default_tenant: int) -> DataFrame:
    """Give rows without a tenant the default one."""
    return rows.withColumn("tenant_id", F.coalesce(F.col("tenant_id"), F.lit(default_tenant)))
