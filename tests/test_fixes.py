"""Identity of log events, tenants, repeated enrichment, true counts, replay flags and the values that SQL shares."""

import json

from pyspark.sql import functions as F

from hawkgrid.functions.severity import severity_weight
from hawkgrid.operators import alerts as al
from hawkgrid.operators import analyst, enrich, incidents
from hawkgrid.operators.dns_windows import dns_windows
from hawkgrid.sources import logs

LINES = [
    ('{"ts": 1.5, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "event_type": "dns", "tenant_id": 99}', "/logs/conn.log"),
    ('{"ts": 1.5, "uid": "C2", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8"}', "/logs/conn.log"),
    ('{"ts": 2.5, "uid": "C2", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "seq": 7}', "/logs/conn.log")]


def test_events_without_a_number_have_stable_ids(spark):
    lines = spark.createDataFrame(LINES, "value string, file string")

    def run(order):
        events = logs.conn_events(logs.parse_events(lines.orderBy(order), tenant_id=3)).withColumns({
            "source_ip": F.col("orig_h"), "destination_ip": F.col("resp_h"), "rule_id": F.lit("R"), "threat_class": F.lit("x"),
            "severity": F.lit("low"), "confidence": F.lit(0.5), "evidence": F.lit("{}"), "mitre_tactic": F.lit("t"), "mitre_technique": F.lit("u")})
        return al.to_alerts(events, ("tenant_id",)).collect()

    first, second = run(F.asc("value")), run(F.desc("value"))
    ids = [r.alert_id for r in first]
    assert None not in ids and len(set(ids)) == 3 and "R-7" in ids
    assert sorted(ids) == sorted(r.alert_id for r in second)
    assert {r.tenant_id for r in first} == {3} and {r.event_type for r in first} == {"conn"}


def test_topics_keep_the_type_of_the_message(spark):
    lines = spark.createDataFrame([(LINES[0][0], "zeek", 5)], "value string, file string, offset long")
    assert logs.parse_events(lines).first().event_type == "dns"


def test_tenants_with_equal_addresses(spark):
    rows = spark.createDataFrame([(1, "INC-1", 5.0), (2, "INC-1", 6.0)], "tenant_id long, incident_id string, risk_score double")
    triage = spark.createDataFrame([(1, "INC-1", "confirmed"), (2, "INC-1", "false_positive")], "tenant_id long, incident_id string, status string")
    assert sorted((r.tenant_id, r.triage_status) for r in analyst.with_triage(rows, triage).collect()) == [(1, "confirmed"), (2, "false_positive")]
    alerts = spark.createDataFrame([(1, "a", "10.0.0.7", "1.1.1.1"), (2, "a", "10.0.0.7", "2.2.2.2")],
                                   "tenant_id long, alert_id string, source_ip string, destination_ip string")
    members = incidents.incident_alerts(alerts)
    assert [r.tenant_id for r in analyst.alerts_of_incident(members, alerts, "INC-10-0-0-7", tenant_id=2).collect()] == [2]
    assert {(r.tenant_id, r.entity) for r in incidents.incident_entities(alerts).collect()} == {
        (1, "10.0.0.7"), (1, "1.1.1.1"), (2, "10.0.0.7"), (2, "2.2.2.2")}


def test_enriching_again_replaces_keys_and_keeps_long_evidence(spark):
    old = {"Live ISP": 'Old "quoted" one', "note": "x" * 70_000, "Live GeoIP": "Nowhere, XX", "n": {"deep": [1, 2]}}
    alerts = spark.createDataFrame([("a", "8.8.8.8", "1.1.1.1", json.dumps(old)), ("b", "8.8.8.8", "1.1.1.1", "{}")],
                                   "alert_id string, source_ip string, destination_ip string, evidence string")
    intel = spark.createDataFrame([("8.8.8.8", "Town", "Land", "New", False)], "ip string, city string, country string, isp string, hosting boolean")
    once = enrich.enrich(alerts, intel)
    for frame in (once, enrich.enrich(once, intel)):
        for row in frame.collect():
            pairs = json.loads(row.evidence, object_pairs_hook=lambda p: p)
            names = [k for k, _ in pairs]
            assert len(names) == len(set(names)) and dict(pairs)["Live ISP"] == "New"
            if row.alert_id == "a":
                assert dict(pairs)["note"] == old["note"] and ["deep", [1, 2]] in [list(x) for x in dict(pairs)["n"]]


def test_distinct_names_above_any_list_size(spark):
    dns = spark.createDataFrame([("10.0.0.1", k * 1000, k, f"n{k}.example.com", 0, "dns") for k in range(400)],
                                "orig_h string, t_us long, seq long, query string, rcode int, event_type string")
    found = dns_windows(dns, distinct_min=300).where("reason = 'distinct_domain_burst'")
    assert found.agg(F.count("*").alias("n"), F.max("distinct_domains").alias("top")).first().asDict() == {"n": 101, "top": 400}


def test_replays_carry_their_flag(spark):
    lines = spark.createDataFrame([('{"error": "e", "alert": {"alert_id": "a1"}}',), ("broken",)], "value string")
    assert [r.is_replay for r in al.replay_dead_letters(lines).collect()] == [True]


def test_values_that_the_sql_shares(spark):
    row = spark.range(1).select(*[severity_weight(F.lit(s)).alias(s) for s in ("critical", "high", "medium", "low")]).first()
    assert tuple(row) == (100, 75, 50, 25)
    assert analyst.STATUSES == ["open", "acknowledged", "false_positive", "confirmed"]
    assert al.SEVERITIES == ["low", "medium", "high", "critical"] and enrich.YOUNG_DAYS == 180
