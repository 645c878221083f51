"""Stateless detection rules over connection and DNS rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.functions import text


@dataclass(frozen=True)
class Rule:
    rule_id: str
    threat_class: str
    severity: str
    confidence: float
    mitre_tactic: str | None = None
    mitre_technique: str | None = None


# Identity, grade and technique of every detection.
VOLUMETRIC = Rule("RULE_DDOS_VOLUMETRIC", "DDoS", "critical", 0.95, "Impact", "T1498")
REJECT_FLOOD = Rule("RULE_DDOS_VOLUMETRIC", "DDoS", "high", 0.85, "Impact", "T1498")
HEARTBEAT = Rule("RULE_C2_HEARTBEAT", "C2 Beaconing", "high", 0.85, "Command and Control", "T1132")
TUNNEL = Rule("RULE_DNS_TUNNELLING", "DGA / DNS Tunnelling", "high", 0.90, "Command and Control", "T1071.004")
DGA_ENTROPY = Rule("RULE_DNS_DGA_FALLBACK", "DGA / DNS Tunnelling", "medium", 0.80, "Command and Control", "T1568.002")
JA4 = Rule("RULE_TLS_JA4_MALWARE", "Encrypted-Traffic Malware", "critical", 0.95, "Defense Evasion", "T1573")
PORT_SCAN = Rule("RULE_RECON_PORT_SCAN", "Reconnaissance", "low", 0.75, "Discovery", "T1046")
EXFIL = Rule("RULE_CONN_EXFIL", "Data Exfiltration", "high", 0.85, "Exfiltration", "T1048")
CONN_RATE = Rule("RULE_DDOS_CONN_RATE", "DDoS", "critical", 0.95)
BEACON = Rule("RULE_C2_BEACON_PERIODIC", "C2 Beaconing", "medium", 0.40)
BYTE_VOLUME = Rule("RULE_EXFIL_BYTE_VOLUME", "Data Exfiltration", "critical", 0.95)
DNS_BURST = Rule("RULE_DNS_QUERY_BURST", "DGA / DNS Tunnelling", "high", 0.9)
DNS_NXDOMAIN = Rule("RULE_DNS_QUERY_BURST", "DGA / DNS Tunnelling", "medium", 0.9)
DGA_MODEL = Rule("DL_CNN_DGA", "DGA / DNS Tunnelling", "high", 0.0)
FLOW_MODEL = Rule("DL_AUTOENCODER_FLOW_ANOMALY", "Anomalous Flow", "medium", 0.0)
YOUNG_DOMAIN = Rule("RULE_DOMAIN_AGE_YOUNG", "DGA / DNS Tunnelling", "medium", 0.0)

DEFAULT_JA4 = ["t13d000000_rare_fingerprint"]

DETECTION_FIELDS = [
    "rule_id", "threat_class", "severity", "confidence", "evidence", "mitre_tactic", "mitre_technique",
]


def detection(rule: Rule, evidence: Column, confidence: Column | None = None) -> dict[str, Column]:
    """The detection columns of a rule; evidence is JSON text."""
    return {
        "rule_id": F.lit(rule.rule_id), "threat_class": F.lit(rule.threat_class), "severity": F.lit(rule.severity),
        "confidence": F.lit(rule.confidence) if confidence is None else confidence, "evidence": evidence,
        "mitre_tactic": F.lit(rule.mitre_tactic).cast("string"),
        "mitre_technique": F.lit(rule.mitre_technique).cast("string"),
    }


def fire(df: DataFrame, hits: list[tuple[Column, dict[str, Column]]], prefilter: bool = True) -> DataFrame:
    """One row per (input row, rule that holds).

    Only rule numbers are exploded. The detection columns are built afterwards, so a query
    that does not read the evidence never builds it. With ``prefilter`` rows on which
    nothing holds are filtered first, so that the disjunction can reach the scan; leave
    it out where the conditions are expensive, to evaluate them once.
    """
    columns = df.columns
    if prefilter:
        df = df.where(reduce(or_, [cond for cond, _ in hits]))
    numbers = F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, (cond, _) in enumerate(hits)]))
    fired = df.withColumn("_hit", F.explode_outer(numbers)).where("_hit is not null")

    def field(name: str) -> Column:
        out = F.when(F.col("_hit") == 0, hits[0][1][name])
        for i, (_, det) in enumerate(hits[1:], start=1):
            out = out.when(F.col("_hit") == i, det[name])
        return out.alias(name)

    return fired.select(*columns, *[field(f) for f in DETECTION_FIELDS])


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def conn_conditions() -> dict[Rule, Column]:
    """When each rule over a connection's own columns holds (the fingerprint rule needs its list)."""
    c = {n: F.col(n) for n in ("orig_pkts", "orig_bytes", "resp_bytes", "resp_p", "conn_state")}
    flood = c["orig_pkts"] > 10000
    small = (c["orig_bytes"] > 50) & (c["orig_bytes"] < 150) & (c["resp_bytes"] > 50) & (c["resp_bytes"] < 150)
    return {
        VOLUMETRIC: flood,
        REJECT_FLOOD: ~flood & (c["conn_state"] == "REJ") & (c["orig_pkts"] >= 100),
        HEARTBEAT: small & (c["resp_p"].isNull() | ~c["resp_p"].isin(80, 443, 53)),
        PORT_SCAN: (c["conn_state"] == "S0") & (c["orig_pkts"] < 5),
        EXFIL: (c["orig_bytes"] > 5_000_000) & (c["resp_bytes"] < 10_000),
    }


def conn_rules(conn: DataFrame, ja4: list[str] | DataFrame | None = None) -> DataFrame:
    """Volumetric, heartbeat, fingerprint, scan and exfiltration rules over connections.

    ``ja4`` is a short list, or a table with a ``ja4`` column; a table is joined
    without a hint, so Spark broadcasts it only under its size threshold. If the table has ``valid_from_us`` and
    ``valid_to_us`` (null: still valid), a fingerprint counts for events from the one until before the other.
    """
    keep = conn.columns
    c = {n: F.col(n) for n in keep}
    if isinstance(ja4, DataFrame):
        if "valid_from_us" in ja4.columns:
            listed = ja4.groupBy("ja4").agg(F.collect_set(F.struct("valid_from_us", "valid_to_us")).alias("_listed"))
            holds = F.exists("_listed", lambda v: (c["t_us"] >= v["valid_from_us"]) & (
                v["valid_to_us"].isNull() | (c["t_us"] < v["valid_to_us"])))
        else:
            listed, holds = ja4.select("ja4", F.lit(True).alias("_listed")).distinct(), F.col("_listed")
        conn = conn.join(listed, "ja4", "left")
        bad_ja4 = F.coalesce(holds, F.lit(False))
    else:
        bad_ja4 = c["ja4"].isin(DEFAULT_JA4 if ja4 is None else ja4)
    bad_ja4 = bad_ja4 & (c["ja4"] != "")
    packets, holds = _json(c["conn_state"], c["orig_pkts"]), conn_conditions()
    hits = [
        (holds[VOLUMETRIC], detection(VOLUMETRIC, packets)),
        (holds[REJECT_FLOOD], detection(REJECT_FLOOD, packets)),
        (holds[HEARTBEAT], detection(HEARTBEAT, _json(
            c["orig_bytes"], c["resp_bytes"], F.coalesce(c["resp_p"], F.lit(0)).alias("port")))),
        (bad_ja4, detection(JA4, _json(c["ja4"].alias("ja4_fingerprint"),
                                       F.lit("Anomalous Cipher Suite").alias("tls_metadata")))),
        (holds[PORT_SCAN], detection(PORT_SCAN, _json(F.lit("S0").alias("conn_state"), c["resp_p"].alias("target_port")))),
        (holds[EXFIL], detection(EXFIL, _json(c["orig_bytes"], c["resp_bytes"]))),
    ]
    return fire(conn, hits).select(*keep, *DETECTION_FIELDS)


def dns_rules(dns: DataFrame) -> DataFrame:
    """Tunnelling and high-entropy-name rules over DNS queries."""
    query = F.col("query")
    label = text.first_label(query)
    length = F.length(query)
    # Cheap length and suffix tests come first; entropy runs only on what is left.
    candidate = (F.length(label) >= 16) & ~text.is_known_infra(query)
    entropy = F.col("_entropy")
    hits = [
        ((length > 60) & (F.col("qtype_name") == "TXT"),
         detection(TUNNEL, _json(length.alias("query_length"), F.lit("TXT").alias("qtype")))),
        (F.coalesce(entropy > 3.8, F.lit(False)), detection(DGA_ENTROPY, _json(entropy.alias("shannon_entropy"), query))),
    ]
    rows = dns.where(F.col("event_type") == "dns").withColumn(
        "_entropy", F.when(candidate, text.shannon_entropy(label)))
    return fire(rows, hits, prefilter=False).drop("_entropy")
