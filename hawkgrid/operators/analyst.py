"""Analyst queries over stored alerts and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.operators.incidents import incident_id, source_of

OPEN, ACKNOWLEDGED, FALSE_POSITIVE, CONFIRMED = "open", "acknowledged", "false_positive", "confirmed"
STATUSES = [OPEN, ACKNOWLEDGED, FALSE_POSITIVE, CONFIRMED]
# Page size limit, minutes a talker pair counts as new, seconds until stale, buffer sizes.
PAGE_LIMIT = 100
NEW_PAIR_MINUTES = 10
STALE_SECONDS = 60
INCIDENT_BUFFER, ALERT_BUFFER = 200, 1000
STATUS_LABELS = {OPEN: "OPEN", ACKNOWLEDGED: "ACK", FALSE_POSITIVE: "FALSE POS", CONFIRMED: "CONFIRMED"}


def scope(rows: DataFrame, tenant_id: int | None) -> DataFrame:
    """Restrict to a tenant; on a table partitioned by tenant this prunes files."""
    return rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)


def page(rows: DataFrame, tenant_id: int | None = None, cursor: int = 0, limit: int = PAGE_LIMIT) -> DataFrame:
    """Newest rows below the cursor: a top-k, not a full sort. Serves alerts and the audit log."""
    rows = scope(rows, tenant_id)
    if cursor > 0:
        rows = rows.where(F.col("id") < cursor)
    return rows.orderBy(F.col("id").desc()).limit(max(1, min(limit, PAGE_LIMIT)))


def alert_by_id(alerts: DataFrame, alert_id: str, tenant_id: int | None = None) -> DataFrame:
    return scope(alerts, tenant_id).where(F.col("alert_id") == alert_id)


def severity_stats(alerts: DataFrame) -> DataFrame:
    severity = F.lower("severity")
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(severity == s).alias(s) for s in ("critical", "high", "medium", "low")])


def talkers(alerts: DataFrame, now_us: int | Column, min_confidence: float = 0.5, limit: int = 25) -> DataFrame:
    """Busiest (source, destination) pairs, and whether a pair is new."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    new = (now - F.col("first_seen_us")) <= NEW_PAIR_MINUTES * 60 * 1_000_000
    return (
        alerts.where(F.col("confidence_score") >= min_confidence)
        .groupBy("source_ip", "destination_ip")
        .agg(F.count("*").alias("events"), F.min("t_us").alias("first_seen_us"))
        .orderBy(F.col("events").desc(), "source_ip", "destination_ip").limit(limit)
        .withColumn("pair_status", F.when(new, "NEW").otherwise(""))
    )


def threat_distribution(alerts: DataFrame, limit: int = 8) -> DataFrame:
    return (
        alerts.groupBy(F.coalesce("threat_class", F.lit("Unknown")).alias("threat_class"))
        .agg(F.count("*").alias("alert_count"))
        .orderBy(F.col("alert_count").desc(), "threat_class").limit(limit)
    )


def timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per second."""
    return alerts.groupBy(F.floor(F.col("t_us") / 1_000_000).cast("bigint").alias("second")).agg(
        F.count("*").alias("alert_count"))


def entity_search(alerts: DataFrame, term: str) -> DataFrame:
    """Alerts whose source, destination, id or flow id equals the term."""
    columns = [c for c in ("source_ip", "destination_ip", "alert_id", "flow_id") if c in alerts.columns]
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.col(column) == term, F.lit(False))
    return alerts.where(hit)


def related_incidents(found: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents of the sources seen in a search result."""
    keys = _shared(["incident_id"], found, incidents)
    ids = found.select(*keys[:-1], incident_id(source_of(found)).alias("incident_id"))
    return incidents.join(ids, keys, "left_semi")


def _shared(keys: list[str], *tables: DataFrame) -> list[str]:
    """Join keys, with the tenant where all tables have one: two tenants may use the same addresses."""
    return (["tenant_id"] if all("tenant_id" in t.columns for t in tables) else []) + keys


def alerts_of_incident(
    members: DataFrame, alerts: DataFrame, incident: str, tenant_id: int | None = None,
) -> DataFrame:
    """The alerts behind one incident (of one tenant, if given), through the membership table."""
    own = members.where(F.col("incident_id") == incident)
    own = own if tenant_id is None else own.where(F.col("tenant_id") == tenant_id)
    return alerts.join(own, _shared(["alert_id"], own, alerts), "left_semi")


def with_triage(incidents: DataFrame, triage: DataFrame) -> DataFrame:
    """Add the current triage status, ``open`` when nobody has touched the incident."""
    keys = _shared(["incident_id"], incidents, triage)
    status = triage.select(*keys, F.col("status").alias("triage_status"))
    return incidents.join(status, keys, "left").withColumn(
        "triage_status", F.coalesce("triage_status", F.lit(OPEN)))


def queue_kpis(queue: DataFrame) -> DataFrame:
    status, active = F.col("triage_status"), F.col("triage_status") != FALSE_POSITIVE
    return queue.agg(
        F.count_if(status == OPEN).alias("needs_triage"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(active).alias("active"), F.count_if(~active).alias("dismissed"),
        F.coalesce(F.avg(F.when(active, F.col("risk_score"))), F.lit(0.0)).alias("avg_risk"),
    )


def _contains(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.strip().lower())


def incident_queue(
    queue: DataFrame,
    severities: list[str] | None = None,
    statuses: list[str] | None = None,
    search: str = "",
    entities: DataFrame | None = None,
) -> DataFrame:
    """Filtered queue, highest risk first, then newest.

    ``search`` looks in the id, the classes and the addresses of an incident. Addresses
    come from the row (``affected_entities``) or from the membership table ``entities``.
    """
    out = queue.where(F.col("severity").isin(severities or ["critical", "high", "medium", "low"]))
    out = out.where(F.col("triage_status").isin(statuses or [OPEN, ACKNOWLEDGED, CONFIRMED]))
    if search.strip():
        parts = ["incident_id", "threat_classes"] + ["affected_entities"] * ("affected_entities" in out.columns)
        text = F.concat_ws(" ", *[F.replace(F.col(c), F.lit(","), F.lit(" ")) for c in parts])
        if entities is None:
            out = out.where(_contains(text, search))
        else:
            keys = _shared(["incident_id"], out, entities)
            hits = entities.where(_contains(F.col("entity"), search)).select(*keys).distinct()
            hits = hits.withColumn("_entity_hit", F.lit(True))
            out = out.join(hits, keys, "left").where(
                _contains(text, search) | F.col("_entity_hit").isNotNull()).drop("_entity_hit")
    return out.orderBy(F.col("risk_score").desc(), F.col("first_seen_us").desc(), "incident_id")


def console_queue(queue: DataFrame, needle: str = "", entities: DataFrame | None = None) -> DataFrame:
    """Console view: severity, first class, target, source and status label are searchable.

    Targets come from the row (``affected_entities``, its first one) or, all of them, from the membership table ``entities``.
    """
    label = F.upper("triage_status")
    for status, text in STATUS_LABELS.items():
        label = F.when(F.col("triage_status") == status, text).otherwise(label)
    source = F.replace(F.regexp_replace("incident_id", "^INC-", ""), F.lit("-"), F.lit("."))
    first_class = F.split("threat_classes", ",").getItem(0)
    target = F.split("affected_entities", ",").getItem(0) if "affected_entities" in queue.columns else source
    out = queue.withColumn("status_label", label)
    if needle.strip():
        found = _contains(F.concat_ws(" ", "severity", first_class, target, source, "status_label"), needle)
        if entities is not None:
            keys = _shared(["incident_id"], out, entities)
            hits = entities.where(_contains(F.col("entity"), needle)).select(*keys).distinct().withColumn("_entity_hit", F.lit(True))
            out, found = out.join(hits, keys, "left"), found | F.col("_entity_hit").isNotNull()
        out = out.where(found).drop("_entity_hit")
    return out.orderBy(F.col("risk_score").desc(), "incident_id")


def set_triage(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Append status changes; rows with an unknown status are not taken."""
    return log.unionByName(changes.where(F.col("status").isin(STATUSES)))


def current_triage(log: DataFrame) -> DataFrame:
    """Newest status per (tenant, incident)."""
    w = Window.partitionBy("tenant_id", "incident_id").orderBy(F.col("updated_us").desc(), F.col("status"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def triage_audit(changes: DataFrame) -> DataFrame:
    """Audit rows for accepted status changes."""
    return changes.where(F.col("status").isin(STATUSES)).select(
        "tenant_id", "actor_user_id", F.lit("triage.set_status").alias("action"),
        F.col("incident_id").alias("target"), F.col("status").alias("detail"), F.col("updated_us").alias("created_us"))


def health(alerts: DataFrame, incidents: DataFrame, now_us: int) -> DataFrame:
    """Freshness of the newest alert and fill of the display buffers."""
    a = alerts.agg(F.max("t_us").alias("last_event_us"), F.count("*").alias("alerts"))
    i = incidents.agg(F.count("*").alias("incidents"))
    age = (F.lit(now_us) - F.col("last_event_us")) / 1_000_000
    state = F.when(F.col("last_event_us").isNull(), "Waiting for telemetry").when(age > STALE_SECONDS, "Stale")
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(i.select("*", one), "_one").select(
        "last_event_us", state.otherwise("Live").alias("state"),
        F.least(F.lit(100.0), F.col("alerts") / ALERT_BUFFER * 100).alias("alert_buffer_pct"),
        F.least(F.lit(100.0), F.col("incidents") / INCIDENT_BUFFER * 100).alias("incident_buffer_pct"))
