"""Query-time incidents: alerts grouped by source, with set members as their own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.functions.severity import effective_confidence, severity_weight
from hawkgrid.operators.risk import detector_name, log_odds, pooled_risk
from hawkgrid.session import durable

DEFAULT_SOURCE = "127.0.0.1"


def source_of(alerts: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("source_ip"), F.lit("")), F.lit(DEFAULT_SOURCE))


def incident_id(source: Column) -> Column:
    return F.concat(F.lit("INC-"), F.replace(source, F.lit("."), F.lit("-")))


def sorted_text(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def incidents_by_source(alerts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per source (and ``keys``, such as the tenant) over any number of alerts.

    The first aggregation is per detector, so the second one sees few rows per source.
    Threat classes and techniques are short, fixed vocabularies and come as sorted text;
    alert ids and entities can be without bound and come from ``incident_alerts`` and
    ``incident_entities``.
    """
    groups = [*keys, "source_ip"]
    named = alerts.withColumn("source_ip", source_of(alerts))
    per_detector = named.groupBy(*groups, detector_name(alerts).alias("_detector")).agg(
        F.max(effective_confidence(F.col("confidence_score"), F.col("severity"))).alias("_best"),
        F.count("*").alias("_n"),
        F.max(severity_weight(F.col("severity"))).alias("_weight"),
        F.min("t_us").alias("_first"), F.max("t_us").alias("_last"),
        F.collect_set(F.nullif(F.col("threat_class"), F.lit(""))).alias("_classes"),
        F.collect_set("mitre_tactic").alias("_tactics"),
        F.collect_set("mitre_technique").alias("_techniques"),
    )
    weight_to_name = (
        F.when(F.col("_w") == 100, "critical").when(F.col("_w") == 75, "high")
        .when(F.col("_w") == 50, "medium").otherwise("low")
    )

    def union(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))

    merged = per_detector.groupBy(*groups).agg(
        F.sum("_n").alias("alert_count"), F.max("_weight").alias("_w"),
        F.min("_first").alias("first_seen_us"), F.max("_last").alias("last_seen_us"),
        pooled_risk(F.sum(log_odds(F.col("_best")))).alias("risk_score"),
        union("_classes").alias("_classes"), union("_tactics").alias("_tactics"), union("_techniques").alias("_tech"),
    )
    classes = F.when(F.size("_classes") == 0, F.array(F.lit("Unclassified Threat"))).otherwise(F.col("_classes"))
    return merged.withColumn("_classes", classes).select(
        *groups, incident_id(F.col("source_ip")).alias("incident_id"), weight_to_name.alias("severity"),
        "risk_score", "alert_count", "first_seen_us", "last_seen_us",
        F.array_join("_classes", ",").alias("threat_classes"),
        F.array_join("_tactics", ",").alias("mitre_tactics"),
        F.array_join("_tech", ",").alias("mitre_techniques"),
        F.concat(
            F.lit("Aggregated "), F.col("alert_count").cast("string"), F.lit(" alert(s) across "),
            F.size("_classes").cast("string"), F.lit(" threat class(es) involving "), F.col("source_ip"),
        ).alias("evidence_summary"),
        F.lit("active").alias("status"),
    )


def incident_alerts(alerts: DataFrame) -> DataFrame:
    """Membership table: which alert belongs to which incident, per tenant where alerts have one."""
    tenant = [c for c in ("tenant_id",) if c in alerts.columns]
    return alerts.where("coalesce(alert_id, '') <> ''").select(
        *tenant, incident_id(source_of(alerts)).alias("incident_id"), "alert_id")


def incident_entities(alerts: DataFrame) -> DataFrame:
    """Membership table: the distinct addresses an incident touches, per tenant where alerts have one."""
    source = source_of(alerts)
    tenant = [c for c in ("tenant_id",) if c in alerts.columns]
    return (
        alerts.select(
            *tenant, incident_id(source).alias("incident_id"),
            F.explode(F.array(source, F.col("destination_ip"))).alias("entity"))
        .where("coalesce(entity, '') <> ''").distinct()
    )


def incidents_page(alerts: DataFrame, limit: int = 100, tenant_id: int | None = None) -> DataFrame:
    """The analyst's page: incidents of the latest ``limit`` alerts, with member lists.

    Here the lists are bounded by the page size, so they are part of the row.
    """
    scoped = alerts if tenant_id is None else alerts.where(F.col("tenant_id") == tenant_id)
    page = scoped.orderBy(F.col("id").desc()).limit(limit)
    page = durable(page.withColumn("source_ip", source_of(page)))
    members = page.groupBy("source_ip").agg(
        F.array_distinct(F.concat(
            F.array(F.first("source_ip")), F.collect_set(F.nullif(F.col("destination_ip"), F.lit(""))))).alias("e"),
        F.collect_list("alert_id").alias("a"),
    ).select(
        "source_ip", sorted_text(F.col("e")).alias("affected_entities"),
        sorted_text(F.col("a")).alias("related_alert_ids"))
    return incidents_by_source(page).join(members, "source_ip")


def kill_chain(alerts: DataFrame, keys: tuple[str, ...] = ("source_ip",)) -> DataFrame:
    """Attack phases: one row per (model, class) with its span, size and worst severity."""
    phases = alerts.groupBy(
        *keys,
        F.coalesce(F.nullif(F.col("model_name"), F.lit("")), F.lit("rule-based")).alias("model_name"),
        F.coalesce(F.nullif(F.col("threat_class"), F.lit("")), F.lit("Unclassified")).alias("threat_class"),
    ).agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("alert_count"),
        F.max(severity_weight(F.col("severity"))).alias("_w"),
        F.min(F.struct(*[c for c in ("t_us", "id", "mitre_tactic", "mitre_technique")])).alias("_first"),
    )
    order = Window.partitionBy(*keys).orderBy("start_us", F.col("_first.id"))
    return phases.withColumn("phase", F.row_number().over(order)).select(
        *keys, "phase", "model_name", "threat_class", "start_us", "end_us", "alert_count",
        F.when(F.col("_w") == 100, "critical").when(F.col("_w") == 75, "high")
        .when(F.col("_w") == 50, "medium").otherwise("low").alias("severity"),
        F.col("_first.mitre_tactic").alias("mitre_tactic"), F.col("_first.mitre_technique").alias("mitre_technique"),
    )
