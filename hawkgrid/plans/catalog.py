"""Registered queries over the driver's tables; each returns hash-friendly columns.

Set-valued columns come as sorted, comma-joined text, and computed doubles are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.functions import display, flow, text
from hawkgrid.functions.net import normalise_ip
from hawkgrid.operators import alerts as al
from hawkgrid.operators import analyst, correlate, enrich, evaluate, gram_model, incidents, models, playbooks, risk, rules
from hawkgrid.operators.conn_windows import conn_window_detections, conn_windows
from hawkgrid.operators.dns_windows import dns_window_detections, dns_windows
from hawkgrid.operators.ranges import longest_prefix
from hawkgrid.session import durable, shared_folder
from hawkgrid.sources import adapters, logs, packets, topic
from hawkgrid.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the fixture views: time compression and lowered thresholds (events are sparse).
COMPRESS, RATE_COMPRESS, DNS_COMPRESS = 60, 3600, 600
RATE_MIN = 4
FLOW_BYTES = 300_000
# Position of a rule among the alerts of one event.
RULE_ORDER = [
    "RULE_DDOS_VOLUMETRIC", "RULE_C2_HEARTBEAT", "RULE_TLS_JA4_MALWARE", "RULE_RECON_PORT_SCAN", "RULE_CONN_EXFIL",
    "RULE_DNS_TUNNELLING", "RULE_DNS_DGA_FALLBACK",
]
RESEND_US = 30_000_000
DAY_US = 86_400_000_000


def _round(**columns) -> list:
    return [F.round(F.col(c), n).alias(c) for c, n in columns.items()]


def _conn(spark, sf, compress=COMPRESS):
    return adapters.conn_view(spark, sf, compress)


def _dns(spark, sf, compress=COMPRESS):
    return adapters.dns_view(spark, sf, compress)


def _queries(spark, sf, compress=COMPRESS):
    return _dns(spark, sf, compress).where("event_type = 'dns'")


def _detections(spark, sf) -> DataFrame:
    columns = ["seq", "t_us", "tenant_id", F.col("orig_h").alias("source_ip"),
               F.col("resp_h").alias("destination_ip"), "event_type", *rules.DETECTION_FIELDS]
    conn = rules.conn_rules(_conn(spark, sf)).select(*columns)
    return conn.unionByName(rules.dns_rules(_dns(spark, sf)).select(*columns))


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of all stateless rules, with a unique, time-ordered ``id``."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("rule_id"))
    rows = al.to_alerts(_detections(spark, sf).withColumn("_id", F.col("seq") * 16 + order), ("tenant_id", "_id"))
    return rows.withColumnRenamed("_id", "id").withColumn("seq", F.col("id"))


def _table(spark, sf) -> DataFrame:
    """The alerts as a written table, for queries that read them more than once."""
    return durable(stored_alerts(spark, sf))


def _alert_feed(spark, sf) -> DataFrame:
    """Stored alerts plus a second delivery of a tenth of them, half of those as replays; the columns that correlation reads."""
    base = durable(stored_alerts(spark, sf).select("id", *correlate.INPUTS)).withColumn("is_replay", F.lit(False))
    again = base.where("id % 10 = 0").withColumns({
        "t_us": F.col("t_us") + RESEND_US, "is_replay": F.col("id") % 20 == 0, "seq": F.col("seq") + 10**15})
    return base.unionByName(again)


def _triage(incident_rows: DataFrame) -> DataFrame:
    number = F.conv(F.substring(F.md5("incident_id"), 1, 4), 16, 10).cast("bigint")
    status = F.element_at(F.array(*[F.lit(s) for s in analyst.STATUSES]), (number % 4 + 1).cast("int"))
    return incident_rows.select("incident_id", status.alias("status"))


def _queue(spark, sf) -> DataFrame:
    rows = durable(incidents.incidents_by_source(stored_alerts(spark, sf)))
    return analyst.with_triage(rows, _triage(rows))


def _labelled_hits(spark, sf) -> tuple[DataFrame, dict]:
    """Connections with label, window flags and the hit column of every detector."""
    conn = _conn(spark, sf)
    flags = conn_windows(conn, rate_min_count=RATE_MIN).select("seq", "is_flood", "is_beacon", "is_exfil")
    rows = conn.join(flags, "seq").withColumns({
        "is_botnet": F.col("user_id") % 4 == 0, "scenario": F.col("user_id") % 13})
    hits = {name: condition for name, (condition, _) in evaluate.detector_hits().items()}
    return rows, hits


def _metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "fpr", "f1")})


# --- rules and features -------------------------------------------------------------

def rules_conn(spark, sf):
    return rules.conn_rules(_conn(spark, sf)).select(
        "seq", "rule_id", "threat_class", "severity", "confidence", "evidence", "mitre_tactic", "mitre_technique")


def rules_dns(spark, sf):
    return rules.dns_rules(_dns(spark, sf)).select(
        "seq", "rule_id", "threat_class", "severity", "confidence", "mitre_tactic", "mitre_technique")


def ja4_table(spark, sf):
    conn = _conn(spark, sf)
    listed = conn.select("ja4").where(F.col("ja4").contains("rare")).distinct()
    return rules.conn_rules(conn, listed).where("rule_id = 'RULE_TLS_JA4_MALWARE'").select("seq", "rule_id", "severity")


def dns_features(spark, sf):
    q = _queries(spark, sf)
    return q.select("seq", *[c.alias(n) for n, c in text.dns_features(F.col("query")).items()]).withColumns(
        {c: F.round(c, 6) for c in ("shannon_entropy", "label_entropy", "digit_ratio")})


def flow_features(spark, sf):
    rate = flow.bytes_per_second(F.col("orig_bytes"), F.col("resp_bytes"), F.col("duration"))
    return _conn(spark, sf).select("seq", "duration", "orig_bytes", "resp_bytes", F.round(rate, 3).alias("bytes_per_sec"))


def lexical_features(spark, sf):
    vector = text.lexical_vector(text.first_label(F.col("query")))
    return _queries(spark, sf).select("seq", vector.alias("v")).select(
        "seq", *[F.round(F.col("v").getItem(i), 6).alias(n) for i, n in enumerate(text.LEXICAL_NAMES)])


def name_variants(spark, sf):
    q = F.lower(text.strip_dots(F.col("query")))
    return _queries(spark, sf).select("seq", text.name_variants(q, q).alias("v")).select(
        "seq", F.array_join("v", "|").alias("variants"))


def character_windows(spark, sf):
    q = F.lower(text.strip_dots(F.col("query")))
    return _queries(spark, sf).select("seq", text.character_windows(text.name_variants(q, q)).alias("w")).select(
        "seq", F.size("w").cast("bigint").alias("window_count"), F.md5(F.array_join("w", "|")).alias("windows_md5"))


def flow_vectors(spark, sf):
    v = flow.flow_vector(F.col("orig_bytes"), F.col("resp_bytes"), F.col("duration"), F.col("orig_pkts"))
    return _conn(spark, sf).select("seq", v.alias("v")).select(
        "seq", *[F.round(F.col("v").getItem(i), 6).alias(f"v{i}") for i in range(5)])


def registrable_domains(spark, sf):
    return adapters.page_hosts(spark, sf).select(
        "page_id", text.registrable_domain(F.col("domain")).alias("registrable"))


def zeek_states(spark, sf):
    state = F.concat(F.when(F.col("conn_state") == "S0", "S_").when(F.col("conn_state") == "REJ", "S_RA")
                     .otherwise("SRPA_SPA"))
    return _conn(spark, sf).select("seq", flow.zeek_state(state).alias("zeek_state"))


def display_columns(spark, sf):
    a = stored_alerts(spark, sf)
    now = F.lit(43_200_000_000)
    return a.select(
        "id", display.mitre_label(F.col("mitre_tactic"), F.col("mitre_technique")).alias("mitre"),
        display.relative_time(F.col("t_us"), now).alias("age"),
        display.escape_markdown(F.col("alert_id")).alias("escaped"),
        display.display_timestamp(F.timestamp_micros("t_us").cast("string")).alias("shown_at"))


def evidence_split(spark, sf):
    a = stored_alerts(spark, sf)
    groups = display.evidence_groups(F.from_json("evidence", "map<string,string>"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return a.select("id", *[keys(m).alias(n) for n, m in groups.items()])


# --- trailing windows and sessions --------------------------------------------------

def conn_rate(spark, sf):
    w = conn_windows(_conn(spark, sf, RATE_COMPRESS), rate_min_count=RATE_MIN)
    return w.where("is_flood").select("seq", "source_ip", "destination_ip", "connection_count")


def bulk_exfil(spark, sf):
    return conn_windows(_conn(spark, sf)).where("is_exfil").select("seq", "source_ip", "destination_ip", "total_bytes")


def beacon_periodic(spark, sf):
    return conn_windows(_conn(spark, sf)).where("is_beacon").select(
        "seq", "source_ip", "destination_ip", "observations",
        *_round(mean_interval_seconds=3, coefficient_of_variation=5))


def conn_window_alerts(spark, sf):
    w = conn_windows(_conn(spark, sf), rate_min_count=RATE_MIN)
    return conn_window_detections(w).select("seq", "rule_id", "severity", "confidence")


def dns_burst_distinct(spark, sf):
    w = dns_windows(_dns(spark, sf, DNS_COMPRESS))
    return w.where("reason = 'distinct_domain_burst'").select("seq", "source_ip", "distinct_domains")


def dns_burst_large(spark, sf):
    """A limit far above what one window usually holds: the decision needs the true count."""
    w = dns_windows(_dns(spark, sf, DNS_COMPRESS), window_s=3600.0, distinct_min=300)
    return w.where("reason = 'distinct_domain_burst'").select("seq", "source_ip", "distinct_domains")


def dns_burst_nxdomain(spark, sf):
    w = dns_windows(_dns(spark, sf, DNS_COMPRESS))
    return w.where("reason = 'high_nxdomain_rate'").select(
        "seq", "source_ip", "distinct_domains", "total_responses", *_round(nxdomain_rate=6))


def dns_window_alerts(spark, sf):
    return dns_window_detections(dns_windows(_dns(spark, sf, DNS_COMPRESS))).select("seq", "rule_id", "severity")


# --- risk, incidents, analyst queries -----------------------------------------------

def risk_score(spark, sf):
    return risk.risk_scores(stored_alerts(spark, sf), ["source_ip", "destination_ip"]).withColumn(
        "risk_score", F.round("risk_score", 1))


def incidents_by_source(spark, sf):
    return incidents.incidents_by_source(stored_alerts(spark, sf), ("tenant_id",)).withColumn(
        "risk_score", F.round("risk_score", 1))


def incidents_page(spark, sf):
    return incidents.incidents_page(stored_alerts(spark, sf), 100, 1).select(
        "incident_id", "severity", F.round("risk_score", 1).alias("risk_score"), "alert_count", "threat_classes",
        "affected_entities", "related_alert_ids")


def incident_members(spark, sf):
    return incidents.incident_alerts(stored_alerts(spark, sf).drop("tenant_id"))


def incident_entities(spark, sf):
    return incidents.incident_entities(stored_alerts(spark, sf).drop("tenant_id"))


def tenant_queue(spark, sf):
    """Tenants with equal addresses: each incident gets its own tenant's status."""
    rows = durable(incidents.incidents_by_source(stored_alerts(spark, sf), ("tenant_id",)))
    number = F.conv(F.substring(F.md5("incident_id"), 1, 4), 16, 10).cast("bigint") + F.col("tenant_id")
    status = F.element_at(F.array(*[F.lit(s) for s in analyst.STATUSES]), (number % 4 + 1).cast("int"))
    triage = rows.select("tenant_id", "incident_id", status.alias("status"))
    return analyst.with_triage(rows, triage).select("tenant_id", "incident_id", "triage_status")


def incident_detail(spark, sf):
    a = _table(spark, sf)
    return analyst.alerts_of_incident(incidents.incident_alerts(a), a, "INC-10-0-0-7").select(
        "alert_id", "t_us", "severity")


def incident_queue(spark, sf):
    a = _table(spark, sf)
    rows = durable(incidents.incidents_by_source(a))
    queue = analyst.with_triage(rows, _triage(rows))
    found = analyst.incident_queue(queue, search="10.0.0.1", entities=incidents.incident_entities(a))
    return found.select("incident_id", "severity", F.round("risk_score", 1).alias("risk_score"), "triage_status")


def console_queue(spark, sf):
    return analyst.console_queue(_queue(spark, sf), "ack").select("incident_id", "severity", "status_label")


def console_target(spark, sf):
    found = analyst.console_queue(_queue(spark, sf), "45.3.0.2", incidents.incident_entities(stored_alerts(spark, sf)))
    return found.select("incident_id", "severity", "status_label")


def queue_kpis(spark, sf):
    return analyst.queue_kpis(_queue(spark, sf)).withColumn("avg_risk", F.round("avg_risk", 1))


def severity_stats(spark, sf):
    return analyst.severity_stats(analyst.scope(stored_alerts(spark, sf), 1))


def alert_page(spark, sf):
    return analyst.page(stored_alerts(spark, sf), 1, cursor=5000, limit=50).select(
        "id", "alert_id", "source_ip", "severity")


def alert_by_id(spark, sf):
    return analyst.alert_by_id(stored_alerts(spark, sf), "RULE_TLS_JA4_MALWARE-45").select("id", "alert_id", "t_us")


def entity_search(spark, sf):
    return analyst.entity_search(stored_alerts(spark, sf), "45.3.0.2").select("id", "source_ip", "destination_ip")


def related_incidents(spark, sf):
    a = _table(spark, sf)
    found = analyst.entity_search(a, "45.3.0.2").where("severity = 'critical'")
    return analyst.related_incidents(found, incidents.incidents_by_source(a)).select("incident_id", "severity")


def timeline(spark, sf):
    return analyst.timeline(stored_alerts(spark, sf))


def talkers(spark, sf):
    return analyst.talkers(stored_alerts(spark, sf), now_us=600_000_000, min_confidence=0.85)


def threat_distribution(spark, sf):
    return analyst.threat_distribution(stored_alerts(spark, sf))


def kill_chain(spark, sf):
    return incidents.kill_chain(stored_alerts(spark, sf))


def health(spark, sf):
    a = _table(spark, sf)
    return analyst.health(a, incidents.incidents_by_source(a), 43_260_000_000)


# --- correlation --------------------------------------------------------------------

def correlation_triggers(spark, sf):
    return correlate.correlation_state(_alert_feed(spark, sf)).where("trigger").select(
        "source_ip", "anchor", "n", "alert_id", "safe_class")


def correlated_incidents(spark, sf):
    return correlate.correlated_incidents(_alert_feed(spark, sf)).select(
        "incident_id", "source_ip", "anchor", "trigger_n", "created_us", "severity",
        F.round("risk_score", 1).alias("risk_score"), "alert_count", "entity_count",
        *[F.array_join(c, ",").alias(c) for c in (
            "threat_classes", "affected_entities", "tactics", "related_alert_ids")])


def correlation_rollback(spark, sf):
    feed = _alert_feed(spark, sf)
    kept = correlate.without(feed, feed.where("model_name = 'RULE_RECON_PORT_SCAN'"))
    state = correlate.correlation_state(kept)
    return state.groupBy("source_ip", "anchor").agg(
        F.count("*").alias("counted"), F.count_if("trigger").alias("triggers"))


# --- enrichment and playbooks -------------------------------------------------------

def ip_intel_fallback(spark, sf):
    hosts = adapters.table(spark, sf, "lineitem").select(F.concat(
        F.lit("45."), (F.col("l_suppkey") % 200).cast("string"), F.lit("."),
        (F.col("l_partkey") % 250).cast("string"), F.lit(".9")).alias("ip")).distinct()
    return hosts.withColumn("i", enrich.fallback_intel("ip")).select("ip", "i.country", "i.asn", "i.reputation")


def _ip_intel(alerts: DataFrame) -> DataFrame:
    known = alerts.select(F.col("destination_ip").alias("ip")).where(F.col("destination_ip") != "45.3.0.3").distinct()
    return known.select(
        "ip", F.lit("Lyon").alias("city"), F.lit("FR").alias("country"),
        F.concat(F.lit("isp-"), F.substring(F.md5("ip"), 1, 4)).alias("isp"), (F.col("ip") == "45.3.0.2").alias("hosting"))


def range_intel(spark, sf):
    """Narrowest of nested ranges around each address; ranges come from parts, suppliers and nations."""
    t = lambda name: adapters.table(spark, sf, name)
    block = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])
    part, supplier, nation = F.col("p_partkey"), F.col("s_suppkey"), F.col("n_nationkey")
    ranges = t("part").select(block("45.", part % 200, ".", part % 250, ".0/24").alias("cidr"), F.concat(F.lit("part "), F.col("p_brand")).alias("owner"))
    ranges = ranges.unionByName(t("supplier").where("s_suppkey % 3 <> 0").select(
        block("45.", supplier % 200, ".0.0/16").alias("cidr"), F.col("s_name").alias("owner")))
    ranges = ranges.unionByName(t("nation").select(block("45.", nation * 8, ".0.0/13").alias("cidr"), F.col("n_name").alias("owner")))
    addresses = t("lineitem").select(block(
        "45.", F.col("l_suppkey") % 250, ".", F.col("l_partkey") % 250, ".", F.col("l_linenumber")).alias("ip"))
    return longest_prefix(addresses, ranges).select("ip", "owner", (F.col("bits") - 96).alias("prefix_length"))


def enriched_alerts(spark, sf):
    a = _table(spark, sf)
    out = enrich.enrich(a, _ip_intel(a))
    get = lambda k: F.get_json_object("evidence", f"$['{k}']")
    return out.select("id", get("Live GeoIP").alias("place"), get("Live ISP").alias("provider"),
                      get("Threat Intel").alias("warning"))


def domain_age_alerts(spark, sf):
    dns = _queries(spark, sf)
    flagged = dns.where((F.length("query") < 40) & F.col("query").endswith(".com"))
    domains = dns.select(text.registrable_domain(F.col("query")).alias("domain")).where("domain is not null").distinct()
    days = F.conv(F.substring(F.md5("domain"), 1, 3), 16, 10).cast("bigint") % 400
    registered = domains.select("domain", (-days * DAY_US).alias("registered_us"))
    return enrich.young_domains(flagged, registered).select(
        "seq", "rule_id", F.round("confidence", 6).alias("confidence"), F.round("registration_age_days", 3).alias("age_days"))


def playbook_render(spark, sf):
    p = playbooks.playbooks(stored_alerts(spark, sf))
    return p.select(
        "alert_id", "title", "recommended_firewall_rule", F.array_join("containment_steps", "|").alias("steps"),
        F.array_join("forensic_checklist", "|").alias("checklist"),
        F.array_join("mitre_mitigations", "|").alias("mitigations"), F.col("destination_intel.country").alias("country"))


# --- sources and sinks --------------------------------------------------------------

def flow_assembly(spark, sf):
    return packets.flows(adapters.packets_view(spark, sf)).select(
        "orig_h", "orig_p", "resp_h", "resp_p", "proto", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes",
        F.round("duration", 3).alias("duration"))


def packet_dns(spark, sf):
    return packets.dns_from_packets(adapters.packets_view(spark, sf)).select(
        "seq", "orig_h", "resp_h", "query", "qtype_name", "rcode_name", "event_type")


def packet_dead_letters(spark, sf):
    return packets.dead_letters(adapters.packets_view(spark, sf)).select("seq", "src_ip", "dst_ip", "proto", "length", "error")


def flow_windows(spark, sf):
    """Byte windows over the assembled flows: the larger input of the trailing windows."""
    flows = packets.flows(adapters.packets_view(spark, sf))
    return conn_windows(flows, bytes_min_total=FLOW_BYTES).where("is_exfil").select(
        "seq", "source_ip", "destination_ip", "total_bytes", "connection_count")


def _log_lines(spark, sf) -> DataFrame:
    e = _conn(spark, sf)
    good = F.to_json(F.struct(
        (F.col("t_us") / 1_000_000).alias("ts"), F.col("seq"), F.col("orig_h").alias("id.orig_h"),
        F.col("resp_h").alias("id.resp_h"), F.col("resp_p").cast("string").alias("id.resp_p"), "conn_state",
        F.when(F.col("seq") % 9 == 0, "-").otherwise(F.col("orig_bytes").cast("string")).alias("orig_bytes"),
        F.col("orig_pkts").cast("string").alias("orig_pkts")))
    no_ts = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit("}"))
    line = F.when(F.col("seq") % 50 == 7, F.lit("{broken")).when(F.col("seq") % 50 == 8, no_ts).otherwise(good)
    return e.select(line.alias("value"), F.lit("/logs/conn.log").alias("file"))


def log_parsing(spark, sf):
    parsed = logs.conn_events(logs.parse_events(_log_lines(spark, sf)))
    return parsed.select("seq", "t_us", "orig_h", "resp_p", "conn_state", "orig_bytes", "orig_pkts")


def log_rejects(spark, sf):
    return logs.rejected(logs.parse_events(_log_lines(spark, sf))).select("raw_payload", "error")


def _alert_lines(spark, sf) -> DataFrame:
    """Alert messages as JSON text, some of them broken in different ways."""
    a = stored_alerts(spark, sf)
    body = F.to_json(F.struct(
        F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "alert_id",
        "event_type", "threat_class", "confidence_score",
        F.when(F.col("id") % 23 == 0, "urgent").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("id") % 29 == 0, "10.0.0.300").otherwise(F.col("source_ip")).alias("source_ip"),
        F.when(F.col("id") % 31 != 0, F.col("schema_version")).alias("schema_version"),
        F.when(F.col("id") % 37 == 0, F.lit(1)).alias("metadata")))
    return a.select(body.alias("value"), "id")


def alert_validation(spark, sf):
    checked = al.parse_alerts(_alert_lines(spark, sf))
    checked = checked.withColumn("errors", al.validation_errors(checked, F.col("_extra")))
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))


def alert_dead_letters(spark, sf):
    checked = al.parse_alerts(_alert_lines(spark, sf))
    checked = checked.withColumn("errors", al.validation_errors(checked, F.col("_extra")))
    return al.dead_letters(checked).groupBy("error").agg(F.count("*").alias("rejected"))


def dead_letter_replay(spark, sf):
    a = stored_alerts(spark, sf)
    good = F.concat(F.lit('{"error":"x","alert":{"alert_id":"'), F.col("alert_id"), F.lit('"}}'))
    lines = a.select(F.when(F.col("id") % 7 == 0, "{bad").when(F.col("id") % 7 == 1, '{"error":"x"}')
                     .otherwise(good).alias("value"))
    return al.replay_dead_letters(lines).select(F.get_json_object("value", "$.alert_id").alias("alert_id"))


def alert_upsert(spark, sf):
    a = _table(spark, sf).select("tenant_id", "alert_id", "severity", "confidence_score", "id")
    target = a.where("id % 3 <> 0")
    update = a.where("id % 2 = 0").withColumn("severity", F.lit("high"))
    twice = update.unionByName(update.where("id % 4 = 0").withColumns({
        "severity": F.lit("low"), "id": F.col("id") + 10**12}))
    return al.upsert(target, twice, ["id"]).select("tenant_id", "alert_id", "severity", "id")


def alert_table_merge(spark, sf):
    """Three batches of a stored alert log, the first two compacted: base and newer rows read as one table."""
    a = _table(spark, sf).select(
        "tenant_id", "alert_id", "severity", F.col("id").alias("offset"),
        F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    path = f"{shared_folder(spark)}/alert-table-{uuid.uuid4().hex}"
    versions = [(a.where("offset % 3 <> 0"), None), (a.where("offset % 2 = 0"), "high"), (a.where("offset % 5 = 0"), "low")]
    for number, (rows, severity) in enumerate(versions):
        out = rows if severity is None else rows.withColumn("severity", F.lit(severity))
        sinks.write_batch(out, path, number)
        if number < 2:
            sinks.AlertTable(spark, path).compact()
    return sinks.AlertTable(spark, path).read().select("tenant_id", "alert_id", "severity", "timestamp")


def topic_roundtrip(spark, sf):
    """Alerts written to a topic in two appends, and read again."""
    a = stored_alerts(spark, sf)
    rows = a.select(F.col("alert_id").alias("key"), F.concat_ws("|", "threat_class", "severity", "source_ip").alias("value"), "t_us", "id")
    path = f"{shared_folder(spark)}/topic-{uuid.uuid4().hex}"
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        topic.write_topic(part, path)
    return topic.read_topic(spark, path)


def tenant_backfill(spark, sf):
    a = stored_alerts(spark, sf).withColumn("tenant_id", F.when(F.col("tenant_id") != 2, F.col("tenant_id")))
    return al.backfill_tenant(a, 1).groupBy("tenant_id").agg(F.count("*").alias("alert_count"))


def _triage_log(spark, sf) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in (*analyst.STATUSES, "bogus")]), (F.col("seq") % 5 + 1).cast("int"))
    return _conn(spark, sf).select(
        "tenant_id", incidents.incident_id(F.col("orig_h")).alias("incident_id"), status.alias("status"),
        F.lit("").alias("note"), F.col("user_id").alias("actor_user_id"), (F.col("t_us") * 100_000 + F.col("seq")).alias("updated_us"))


def triage_current(spark, sf):
    changes = _triage_log(spark, sf)
    log = analyst.set_triage(changes.limit(0), changes)
    return analyst.current_triage(log).select("tenant_id", "incident_id", "status", "updated_us")


def audit_page(spark, sf):
    audit = analyst.triage_audit(_triage_log(spark, sf)).withColumn("id", F.col("created_us"))
    return analyst.page(audit, 2, limit=20).select("id", "action", "target", "detail")


# --- evaluation ---------------------------------------------------------------------

def confusion_by_detector(spark, sf):
    rows, hits = _labelled_hits(spark, sf)
    return _metrics(evaluate.confusion(rows, "is_botnet", hits))


def composite_evaluation(spark, sf):
    rows, _ = _labelled_hits(spark, sf)
    scored = rows.withColumn("risk", evaluate.composite_risk(evaluate.detector_hits()))
    return _metrics(evaluate.confusion(
        scored, "is_botnet", {"composite": F.col("risk") >= evaluate.INCIDENT_RISK}, ("scenario",)))


def composite_detectors(spark, sf):
    """All detectors, the flow model among them: their pooled risk, any of them, and each alone."""
    rows, _ = _labelled_hits(spark, sf)
    model = _plain_flow_model(spark, sf)
    hits = evaluate.detector_hits(model.threshold)
    scored = models.score_flows(rows, model).withColumn("risk", evaluate.composite_risk(hits))
    alone = {name: condition for name, (condition, _) in hits.items()}
    union = reduce(lambda x, y: x | y, (F.coalesce(h, F.lit(False)) for h in alone.values()))
    return _metrics(evaluate.confusion(
        scored, "is_botnet", {"composite": F.col("risk") >= evaluate.INCIDENT_RISK, "any": union, **alone}))


def family_gate(spark, sf):
    conn = _conn(spark, sf).withColumns({
        "is_botnet": F.col("user_id") % 4 == 0, "family": F.concat_ws("-", "kind", (F.col("user_id") % 13).cast("string"))})
    early = F.col("t_us") < 21_600_000_000
    recall = lambda rows: evaluate.family_recall(
        rows, "family", "is_botnet", F.col("orig_bytes") > 2000, F.col("orig_pkts") % 3 == 0)
    return evaluate.family_regressions(recall(conn.where(~early)), recall(conn.where(early))).select(
        "family", "metric", *_round(baseline=6, value=6, delta_points=4))


def threshold_sweep(spark, sf):
    q = _queries(spark, sf).withColumns({
        "is_dga": F.col("query").rlike(r"^[0-9a-v]{24}\.com$"),
        "score": text.shannon_entropy(text.first_label(F.col("query"))) / 4.5})
    return _metrics(evaluate.threshold_sweep(q, "is_dga", "score", [0.5, 0.7, 0.81, 0.85, 0.9, 0.97]))


def family_recall(spark, sf):
    e = _conn(spark, sf).withColumn("is_botnet", F.col("user_id") % 4 == 0)
    out = evaluate.family_recall(e, "kind", "is_botnet", F.col("orig_bytes") > 2000, F.col("conn_state") == "REJ")
    return out.withColumns({c: F.round(c, 6) for c in ("classifier_recall", "rule_recall", "combined_recall")})


def scenario_pivot(spark, sf):
    rows, hits = _labelled_hits(spark, sf)
    return evaluate.scenario_recall(rows, "scenario", "is_botnet", hits)


def regression_gate(spark, sf):
    rows, hits = _labelled_hits(spark, sf)
    early = F.col("t_us") < 21_600_000_000
    now = evaluate.confusion(rows.where(~early), "is_botnet", hits)
    base = evaluate.confusion(rows.where(early), "is_botnet", hits)
    return evaluate.regressions(now, base, "detector", max_points=0.5).select(
        "detector", "metric", *_round(baseline=6, value=6, delta_points=4))


def domain_overlap(spark, sf):
    hosts = adapters.page_hosts(spark, sf).select(text.registrable_domain(F.col("domain")).alias("domain"))
    asked = _queries(spark, sf).select(text.registrable_domain(F.col("query")).alias("domain"))
    return evaluate.overlap(hosts, asked)


def leakage_free(spark, sf):
    conn = _conn(spark, sf).select(
        F.when(F.col("user_id") % 4 == 0, "botnet").otherwise("normal").alias("label"),
        (F.col("user_id") % 13).cast("string").alias("scenario"), "orig_bytes", "resp_bytes", "duration",
        F.col("orig_pkts").alias("tot_pkts"), "seq")
    holdout = conn.where("label = 'normal' and scenario <> '11' and seq % 5 = 0")
    return evaluate.without_leakage(conn, holdout, "11").groupBy("label").agg(
        F.count("*").alias("row_count"), F.sum("orig_bytes").alias("orig_bytes"))


# --- models (rows only) -------------------------------------------------------------

def _domain_training(spark, sf) -> DataFrame:
    q = _queries(spark, sf)
    generated = q.where(F.col("query").rlike(r"^[0-9a-v]{24}\.com$")).select(F.col("query").alias("domain"))
    words = adapters.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return models.training_domains(adapters.page_hosts(spark, sf), generated, words, word_buckets=64)


def dga_scores(spark, sf):
    model, _ = models.fit_domain_model(_domain_training(spark, sf))
    return models.score_domains(_queries(spark, sf), model)


def dga_detections(spark, sf):
    model, _ = models.fit_domain_model(_domain_training(spark, sf))
    return models.domain_detections(_dns(spark, sf), model).select("seq", "query", "rule_id", "severity", "confidence")


def _gram_weights(spark, sf) -> DataFrame:
    names = _queries(spark, sf).where(F.col("query").rlike(r"^[0-9a-v]{24}\.com$")).select(
        F.col("query").alias("domain"), F.lit(1.0).alias("label"))
    hosts = adapters.page_hosts(spark, sf).where("domain is not null").select("domain", F.lit(0.0).alias("label"))
    return durable(gram_model.fit_weights(names.unionByName(hosts)))


def dga_gram_weights(spark, sf):
    return _gram_weights(spark, sf).select("gram", F.round(F.col("weight") / 10**9, 6).alias("weight"))


def dga_window_max(spark, sf):
    return gram_model.score_windows(_queries(spark, sf), _gram_weights(spark, sf)).select(
        "query", F.round("score", 6).alias("score"))


def dga_gate(spark, sf):
    return gram_model.gram_detections(_dns(spark, sf), _gram_weights(spark, sf)).select(
        "seq", "query", "rule_id", "severity", F.round("confidence", 6).alias("confidence"))


#: A residual without eigenvectors for the SQL counterpart: what the first three coordinates leave.
_PLAIN_RESIDUAL = [[0.0] * 5] * 3 + [[0.0, 0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0]]


def _plain_flow_model(spark, sf) -> models.FlowModel:
    """Means of four fifths of the benign flows; the threshold comes from the others."""
    benign = _conn(spark, sf).where("user_id % 4 <> 0")
    moments = models.flow_moments(benign.where("seq % 5 <> 0")).first()
    draft = models.FlowModel([moments[f"m{i}"] for i in range(5)], _PLAIN_RESIDUAL, models.FLOW_THRESHOLD)
    return models.FlowModel(draft.mean, draft.residual, models.flow_threshold(benign.where("seq % 5 = 0"), draft))


def flow_moments(spark, sf):
    out = models.flow_moments(_conn(spark, sf).where("user_id % 4 <> 0"))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


def flow_scores(spark, sf):
    model = _plain_flow_model(spark, sf)
    return models.score_flows(_conn(spark, sf), model).select("seq", F.round("reconstruction_mse", 9).alias("reconstruction_mse"))


def flow_threshold(spark, sf):
    conn = _conn(spark, sf)
    return models.flow_detections(conn, _plain_flow_model(spark, sf)).select(
        "seq", "rule_id", "severity", F.round("confidence", 6).alias("confidence"))


def flow_anomaly(spark, sf):
    conn = _conn(spark, sf)
    benign = conn.where("user_id % 4 <> 0 and kind <> 'purchase'")
    model = models.fit_flow_model(benign)
    return models.flow_detections(conn, model).select("seq", "rule_id", "reconstruction_mse", "confidence")


def flow_threshold_sweep(spark, sf):
    conn = _conn(spark, sf).withColumn("is_botnet", F.col("user_id") % 4 == 0)
    model = models.fit_flow_model(conn.where("not is_botnet"))
    return evaluate.threshold_sweep(
        models.score_flows(conn, model), "is_botnet", "reconstruction_mse", [0.0008, 0.001, 0.002, 0.005, 0.01, 0.02])


def ip_normal_forms(spark, sf):
    n = F.col("l_orderkey")
    group = lambda factor: F.hex(n * factor % 65535 + 1)
    six = F.concat(F.lit("2001:DB8:0:0:"), group(31), F.lit("::0"), group(17))
    ip = F.when(n % 3 == 0, F.concat(F.lit("10.0."), (n % 300).cast("string"), F.lit(".1"))).when(
        n % 3 == 1, six).otherwise(F.concat(F.lit("::FFFF:10.1.2."), (n % 256).cast("string")))
    rows = adapters.table(spark, sf, "lineitem").select(n, ip.alias("ip")).distinct()
    return rows.select("l_orderkey", normalise_ip("ip").alias("normal"))


def queries() -> dict[str, Query]:
    named = [
        rules_conn, rules_dns, ja4_table, dns_features, flow_features, lexical_features, name_variants,
        character_windows, flow_vectors, registrable_domains, zeek_states, display_columns, evidence_split,
        conn_rate, bulk_exfil, beacon_periodic, conn_window_alerts, flow_windows,
        dns_burst_distinct, dns_burst_large, dns_burst_nxdomain, dns_window_alerts,
        risk_score, incidents_by_source, incidents_page, incident_members, incident_entities, tenant_queue, incident_detail,
        incident_queue, console_queue, console_target, queue_kpis, severity_stats, alert_page, alert_by_id, entity_search,
        related_incidents, timeline, talkers, threat_distribution, kill_chain, health,
        correlation_triggers, correlated_incidents, correlation_rollback,
        ip_intel_fallback, range_intel, enriched_alerts, domain_age_alerts, playbook_render,
        flow_assembly, packet_dns, packet_dead_letters, log_parsing, log_rejects, alert_validation, alert_dead_letters,
        dead_letter_replay, alert_upsert, alert_table_merge, topic_roundtrip, tenant_backfill, triage_current, audit_page,
        confusion_by_detector, composite_evaluation, composite_detectors, family_gate, threshold_sweep, family_recall, scenario_pivot,
        regression_gate, domain_overlap, leakage_free,
        dga_gram_weights, dga_window_max, dga_gate, flow_moments, flow_scores, flow_threshold,
        dga_scores, dga_detections, flow_anomaly, flow_threshold_sweep, ip_normal_forms,
    ]
    return {q.__name__: q for q in named}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Events to incidents: stateless and windowed detections, alerts, risk, riskiest first."""
    conn = _conn(spark, sf)
    columns = ["seq", "t_us", "source_ip", "destination_ip", "event_type", *rules.DETECTION_FIELDS]
    windows = conn_window_detections(conn_windows(conn, rate_min_count=RATE_MIN)).withColumn("event_type", F.lit("conn"))
    parts = [_detections(spark, sf).select(*columns), windows.select(*columns)]
    found = reduce(DataFrame.unionByName, parts)
    return incidents.incidents_by_source(al.to_alerts(found)).orderBy(F.col("risk_score").desc(), "source_ip")
