"""Presentation columns: timestamps, labels, relative times, escaping, evidence groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters escaped in markdown, and key terms that mark a calculated value.
_MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|>~])"
INFERRED_TERMS = ["score", "ml_", "entropy", "confidence", "latency"]
UNKNOWN_VALUES = ["", "unknown"]


def escape_markdown(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), _MARKDOWN, r"\\$1")


def display_timestamp(iso: Column) -> Column:
    parsed = iso.try_cast("timestamp")
    return (
        F.when(F.coalesce(iso, F.lit("")) == "", F.lit("Unknown Time"))
        .when(parsed.isNull(), F.lit("Invalid Time"))
        .otherwise(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss 'UTC'"))
    )


def mitre_label(tactic: Column, technique: Column) -> Column:
    tactic, technique = F.nullif(tactic, F.lit("")), F.nullif(technique, F.lit(""))
    return (
        F.when(tactic.isNull() & technique.isNull(), F.lit("Unmapped"))
        .when(technique.isNull(), tactic)
        .otherwise(F.concat(F.coalesce(tactic, F.lit("None")), F.lit(" ("), technique, F.lit(")")))
    )


def relative_time(t_us: Column, now_us: Column) -> Column:
    age = (now_us - t_us) / 1_000_000
    return (
        F.when(t_us.isNull(), F.lit("Unknown"))
        .when(age < 60, F.lit("just now"))
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("m ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd"))
    )


def evidence_groups(evidence: Column) -> dict[str, Column]:
    """Split an evidence map into observed facts, calculated values and unknowns."""

    def unknown(key: Column, value: Column) -> Column:
        return value.isNull() | value.isin(UNKNOWN_VALUES)

    def inferred(key: Column, value: Column) -> Column:
        hit = F.lit(False)
        for term in INFERRED_TERMS:
            hit = hit | F.lower(key).contains(term)
        return hit

    return {
        "observed": F.map_filter(evidence, lambda k, v: ~unknown(k, v) & ~inferred(k, v)),
        "inferred": F.map_filter(evidence, lambda k, v: ~unknown(k, v) & inferred(k, v)),
        "unknown": F.map_filter(evidence, unknown),
    }
