"""Response playbooks: template lookup and rendering per alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.functions.playbook_text import ALIASES, DEFAULT_KEY, FIELD_DEFAULTS, TEMPLATES
from hawkgrid.operators.enrich import fallback_intel

_TEMPLATE_SCHEMA = (
    "key string, title string, containment_steps array<string>, firewall_rule string, "
    "forensic_checklist array<string>, mitre_mitigations array<string>"
)


def templates(spark: SparkSession) -> DataFrame:
    """Alias table joined with the template it names: a fixed number of rows."""
    by_key = spark.createDataFrame(TEMPLATES, _TEMPLATE_SCHEMA)
    return spark.createDataFrame(ALIASES, "alias string, key string").join(by_key, "key")


def shell_quote(value: Column) -> Column:
    """Quote for a shell unless every character is safe."""
    safe = value.rlike(r"^[A-Za-z0-9_@%+=:,./\-]+$")
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(safe, value).otherwise(quoted)


def _clean(value: Column, default: str) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default)), r"[\r\n\x00]", "")


def _fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def playbooks(alerts: DataFrame) -> DataFrame:
    """One rendered playbook per alert; unknown classes use the exfiltration template.

    Optional input columns: ``destination_port``; evidence keys ``domain``, ``query``,
    ``ja3_hash``, ``ja4``. The template table has fixed size, so it is broadcast.
    """
    spark = alerts.sparkSession
    evidence = F.col("evidence")
    ev = lambda key: F.nullif(F.get_json_object(evidence, f"$.{key}"), F.lit(""))
    port = F.col("destination_port") if "destination_port" in alerts.columns else F.lit(None).cast("string")
    fields = {
        "src_ip": _clean(F.col("source_ip"), FIELD_DEFAULTS["src_ip"]),
        "dst_ip": _clean(F.col("destination_ip"), FIELD_DEFAULTS["dst_ip"]),
        "dst_port": _clean(port, FIELD_DEFAULTS["dst_port"]),
        "domain": _clean(F.coalesce(ev("domain"), ev("query")), FIELD_DEFAULTS["domain"]),
        "ja3_hash": _clean(F.coalesce(ev("ja3_hash"), ev("ja4")), FIELD_DEFAULTS["ja3_hash"]),
    }
    raw_class = F.coalesce(F.nullif(F.col("threat_class"), F.lit("")), F.lit(DEFAULT_KEY))
    known = [a for a, _ in ALIASES]
    upper = F.upper(F.trim(raw_class))
    rows = alerts.select(
        "alert_id", raw_class.alias("threat_class"), "severity",
        *[v.alias(f"_{n}") for n, v in fields.items()],
        F.when(upper.isin(known), upper).otherwise(DEFAULT_KEY).alias("alias"),
    ).join(F.broadcast(templates(spark)), "alias", "left")
    quoted = {n: shell_quote(F.col(f"_{n}")) for n in fields}
    plain = {n: F.col(f"_{n}") for n in ("src_ip", "dst_ip", "domain", "ja3_hash")}
    return rows.select(
        "alert_id", "title", "threat_class", F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        "containment_steps", _fill(F.col("firewall_rule"), quoted).alias("recommended_firewall_rule"),
        F.transform("forensic_checklist", lambda item: _fill(item, plain)).alias("forensic_checklist"),
        "mitre_mitigations",
        fallback_intel("_src_ip").alias("source_intel"), fallback_intel("_dst_ip").alias("destination_intel"),
    )
