import json

import pytest
from pyspark.sql import functions as F

from hawkgrid.operators import alerts as al
from hawkgrid.operators import analyst, enrich, evaluate, incidents, models, playbooks, rules
from hawkgrid.sources import labelled, packets

CONN = "seq long, conn_state string, orig_pkts long, resp_p int, orig_bytes long, resp_bytes long, ja4 string"


@pytest.mark.parametrize("row, fired", [
    (("SF", 10001, 80, 0, 0, ""), {("RULE_DDOS_VOLUMETRIC", "critical")}),
    (("SF", 10000, 80, 0, 0, ""), set()),
    (("REJ", 100, 80, 0, 0, ""), {("RULE_DDOS_VOLUMETRIC", "high")}),
    (("REJ", 99, 80, 0, 0, ""), set()),
    (("REJ", 20000, 80, 0, 0, ""), {("RULE_DDOS_VOLUMETRIC", "critical")}),
    (("SF", 5, 4444, 51, 149, ""), {("RULE_C2_HEARTBEAT", "high")}),
    (("SF", 5, 443, 51, 149, ""), set()),
    (("SF", 5, 4444, 50, 149, ""), set()),
    (("S0", 4, 22, 0, 0, ""), {("RULE_RECON_PORT_SCAN", "low")}),
    (("S0", 5, 22, 0, 0, ""), set()),
    (("SF", 5, 80, 5_000_001, 9_999, ""), {("RULE_CONN_EXFIL", "high")}),
    (("SF", 5, 80, 5_000_001, 10_000, ""), set()),
    (("SF", 5, 80, 0, 0, "t13d000000_rare_fingerprint"), {("RULE_TLS_JA4_MALWARE", "critical")}),
    (("S0", 1, 80, 0, 0, "t13d000000_rare_fingerprint"),
     {("RULE_TLS_JA4_MALWARE", "critical"), ("RULE_RECON_PORT_SCAN", "low")}),
])
def test_connection_rules(spark, row, fired):
    out = rules.conn_rules(spark.createDataFrame([(1, *row)], CONN)).collect()
    assert {(r.rule_id, r.severity) for r in out} == fired


def test_fingerprint_list_may_be_a_table(spark):
    conn = spark.createDataFrame([(1, "SF", 5, 80, 0, 0, "bad"), (2, "SF", 5, 80, 0, 0, None)], CONN)
    table = spark.createDataFrame([("bad",), ("bad",)], "ja4 string")
    assert [r.seq for r in rules.conn_rules(conn, table).collect()] == [1]


def test_dns_rules(spark):
    random_label = "q7x9z2k4m1v8b3n6"
    rows = [(1, "a" * 61, "TXT"), (2, "a" * 60, "TXT"), (3, random_label + ".com", "A"),
            (4, random_label + ".cloudfront.net", "A"), (5, random_label[:15] + ".com", "A"), (6, "a" * 61, "A")]
    dns = spark.createDataFrame([(*r, "dns") for r in rows], "seq long, query string, qtype_name string, event_type string")
    assert {(r.seq, r.rule_id) for r in rules.dns_rules(dns).collect()} == {
        (1, "RULE_DNS_TUNNELLING"), (3, "RULE_DNS_DGA_FALLBACK")}


def test_validation_messages(spark):
    good = {"timestamp": "2024-01-01T00:00:00+00:00", "alert_id": "a", "event_type": "conn", "threat_class": "DDoS",
            "confidence_score": 1, "severity": "low", "source_ip": "::1", "schema_version": "1.0", "destination_ip": None}
    cases = [good, {**good, "source_ip": "01.2.3.4"}, {**good, "timestamp": "yesterday"}, {**good, "schema_version": "2.0"},
             {**good, "is_replay": True}, {k: v for k, v in good.items() if k != "threat_class"}, {**good, "id": 5}]
    lines = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "n int, value string")
    parsed = al.parse_alerts(lines)
    got = {r.n: r.e for r in parsed.select("n", F.size(al.validation_errors(parsed, F.col("_extra"))).alias("e")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1}


def test_upsert_is_scoped_to_the_tenant(spark):
    schema = "tenant_id long, alert_id string, severity string, n long"
    target = spark.createDataFrame([(1, "a", "low", 0), (2, "a", "low", 0)], schema)
    batch = spark.createDataFrame([(1, "a", "high", 1), (1, "a", "critical", 2), (1, "b", "low", 3)], schema)
    rows = {(r.tenant_id, r.alert_id): r.severity for r in al.upsert(target, batch, ["n"]).collect()}
    assert rows == {(1, "a"): "critical", (2, "a"): "low", (1, "b"): "low"}


ALERT = ("id long, alert_id string, t_us long, tenant_id long, source_ip string, destination_ip string, threat_class string, "
         "severity string, confidence_score double, evidence string, model_name string, mitre_tactic string, mitre_technique string")


def _alert(i, **kw):
    base = {"id": i, "alert_id": f"a{i}", "t_us": i * 1_000_000, "tenant_id": 1, "source_ip": "10.0.0.1",
            "destination_ip": "8.8.8.8", "threat_class": "DDoS", "severity": "high", "confidence_score": 0.9,
            "evidence": "{}", "model_name": "m1", "mitre_tactic": None, "mitre_technique": None}
    base.update(kw)
    return tuple(base.values())


def test_enrichment(spark):
    rows = [_alert(1), _alert(2, source_ip="9.9.9.9"), _alert(3, destination_ip="10.0.0.2"), _alert(4, evidence='{"a":1}'),
            _alert(5, evidence="not json")]
    intel = spark.createDataFrame([("9.9.9.9", "Bern", "CH", "Net", True)], "ip string, city string, country string, isp string, hosting boolean")
    out = {r.id: json.loads(r.evidence) if r.id != 3 else r.evidence
           for r in enrich.enrich(spark.createDataFrame(rows, ALERT), intel).collect()}
    assert out[2] == {"Live GeoIP": "Bern, CH", "Live ISP": "Net",
                      "Threat Intel": "WARNING: Data Center / Bulletproof Hosting Detected"}
    assert out[3] == "{}"
    assert out[4]["a"] == 1 and out[4]["Live GeoIP"].startswith("Unknown, ") and set(out[5]) >= {"Live GeoIP", "Live ISP"}


def test_young_domains(spark):
    day = 86_400_000_000
    flagged = spark.createDataFrame([(1, 100 * day, "x.new.com"), (2, 100 * day, "old.com"), (3, 100 * day, "none.org")],
                                    "seq long, t_us long, query string")
    known = spark.createDataFrame([("new.com", 100 * day), ("old.com", -100 * day)], "domain string, registered_us long")
    rows = enrich.young_domains(flagged, known).collect()
    assert [(r.seq, round(r.confidence, 2)) for r in rows] == [(1, 0.95)]


def test_playbooks(spark):
    rows = [_alert(1, threat_class=" c2 beaconing "), _alert(2, threat_class="Anomalous Flow"), _alert(3, threat_class="???"),
            _alert(4, threat_class="DGA", evidence=json.dumps({"domain": "x; rm -rf /\n'"}))]
    out = {r.alert_id: r for r in playbooks.playbooks(spark.createDataFrame(rows, ALERT)).collect()}
    assert out["a1"].recommended_firewall_rule == "iptables -I FORWARD -s 10.0.0.1 -j DROP\niptables -I OUTPUT -d 8.8.8.8 -j DROP"
    assert out["a2"].recommended_firewall_rule is None
    assert out["a3"].title.startswith("High-Volume")
    assert out["a4"].recommended_firewall_rule == "unbound-control local_zone 'x; rm -rf /'\"'\"'' always_nxdomain"
    assert out["a1"].source_intel.reputation == "Trusted"


def test_incidents_and_queue(spark):
    alerts = spark.createDataFrame(
        [_alert(1), _alert(2, model_name="m2", severity="critical", threat_class="Recon"), _alert(3, source_ip="10.0.0.2", confidence_score=0.4)], ALERT)
    inc = incidents.incidents_by_source(alerts)
    rows = {r.incident_id: (r.severity, r.alert_count, r.threat_classes, r.risk_score) for r in inc.collect()}
    assert rows == {"INC-10-0-0-1": ("critical", 2, "DDoS,Recon", 98.78), "INC-10-0-0-2": ("high", 1, "DDoS", 40.0)}
    triage = spark.createDataFrame([("INC-10-0-0-2", "false_positive")], "incident_id string, status string")
    queue = analyst.with_triage(inc, triage)
    assert [r.incident_id for r in analyst.incident_queue(queue).collect()] == ["INC-10-0-0-1"]
    assert [r.incident_id for r in analyst.incident_queue(queue, search="recon").collect()] == ["INC-10-0-0-1"]
    entities = incidents.incident_entities(alerts)
    assert analyst.incident_queue(queue, search="8.8.8", entities=entities).count() == 1
    assert analyst.queue_kpis(queue).first().needs_triage == 1
    chain = incidents.kill_chain(alerts.where("source_ip = '10.0.0.1'")).orderBy("phase").collect()
    assert [(r.model_name, r.alert_count) for r in chain] == [("m1", 1), ("m2", 1)]


def test_pages_scope_and_cursor(spark):
    alerts = spark.createDataFrame([_alert(i, tenant_id=i % 2) for i in range(1, 300)], ALERT)
    first = [r.id for r in analyst.page(alerts, 1).collect()]
    second = [r.id for r in analyst.page(alerts, 1, cursor=min(first)).collect()]
    assert len(first) == 100 and first[0] == 299 and max(second) < min(first) and len(second) == 50


def test_flows(spark):
    rows = [(10, 1, "b", 2, "a", 1, "tcp", 100), (11, 2, "a", 1, "b", 2, "tcp", 40), (12, 3, "b", 2, "a", 1, "tcp", 1),
            (12, 4, "c", 5, "c", 5, "udp", 7), (13, 5, "c", 5, "c", 5, "udp", 8), (9, 6, "a", 1, "b", 2, "tcp", 70000)]
    schema = "t_us long, seq long, src_ip string, src_port int, dst_ip string, dst_port int, proto string, length int"
    out = {r.orig_h: r for r in packets.flows(spark.createDataFrame(rows, schema)).collect()}
    b, c = out["b"], out["c"]
    assert (b.resp_h, b.orig_pkts, b.resp_pkts, b.orig_bytes, b.resp_bytes) == ("a", 2, 1, 101, 40)
    assert (c.orig_pkts, c.resp_pkts, c.orig_bytes, c.resp_bytes) == (1, 1, 7, 8)


def test_packet_dead_letters(spark):
    rows = [(1, "a", 53, "b", 53, "udp", 100), (2, "a", 53, "b", 53, "udp", 65535), (3, "a", 53, "b", 53, "udp", 65536), (4, "a", 53, "b", 53, "tcp", None)]
    frame = spark.createDataFrame(rows, "seq long, src_ip string, src_port int, dst_ip string, dst_port int, proto string, length int")
    fits, rejected = packets.split_oversized(frame)
    assert sorted(r.seq for r in fits.collect()) == [1, 2] and sorted(r.seq for r in rejected.collect()) == [3, 4]
    assert {r.seq: r.error for r in packets.dead_letters(frame).collect()} == {3: "Length above 65535", 4: "Missing length"}


def test_labelled_sets_and_gate(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("scenario,label,dport,state,orig_bytes,resp_bytes,tot_pkts\n1,botnet,22,S_,0,0,2.0\n1,normal,22,SF_SF,0,0,2.0\n")
    rows = labelled.rule_flows(spark, str(path))
    scan = (F.col("conn_state") == "S0") & (F.col("orig_pkts") < 5)
    now = evaluate.confusion(rows, "is_botnet", {"scan": scan})
    assert now.first().f1 == 1.0
    base = spark.createDataFrame([("scan", 1.0, 1.0, 0.0), ("gone", 1.0, 1.0, 0.0)], "detector string, precision double, recall double, fpr double")
    assert evaluate.regressions(now, base, "detector").count() == 0
    worse = evaluate.confusion(rows, "is_botnet", {"scan": ~scan})
    assert {r.metric for r in evaluate.regressions(worse, base, "detector").collect()} == {"precision", "recall", "fpr"}
    assert labelled.domains(spark, str(_write(tmp_path, "dga, conficker ,abc.com\nlegit,alexa,d.com\n"))).where("is_dga").count() == 1


def _write(tmp_path, text):
    path = tmp_path / "d.csv"
    path.write_text(text)
    return path


def test_flow_model_roundtrip_and_domain_model(spark, tmp_path):
    base = spark.range(400).select(
        (F.rand(1) * 1500 + 500).alias("orig_bytes"), (F.rand(2) * 40000 + 5000).alias("resp_bytes"),
        (F.rand(3) * 10).alias("duration"), (F.rand(4) * 490 + 10).alias("orig_pkts"))
    model = models.fit_flow_model(base)
    model.save(spark, str(tmp_path / "m"))
    assert models.FlowModel.load(spark, str(tmp_path / "m")) == model
    odd = spark.createDataFrame([(1, 9e9, 0.0, 0.0, 90000.0)], "seq long, orig_bytes double, resp_bytes double, duration double, orig_pkts double")
    hit = models.flow_detections(odd, model).first()
    assert hit.rule_id == "DL_AUTOENCODER_FLOW_ANOMALY" and 0.5 < hit.confidence <= 0.99

    benign = spark.range(150).select(F.concat(F.element_at(F.array(*map(F.lit, ("mail", "news", "shop"))), (F.col("id") % 3 + 1).cast("int")),
                                              (F.col("id") % 50).cast("string"), F.lit(".example.com")).alias("domain"))
    bad = spark.range(150).select(F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 20), F.lit(".com")).alias("domain"))
    words = spark.createDataFrame([(w,) for w in ("blue", "stone", "river", "cloud")], "word string")
    model, accuracy = models.fit_domain_model(models.training_domains(benign, bad, words, 4))
    assert accuracy > 0.8
    asked = spark.createDataFrame([("mail3.example.com",), ("0cc175b9c0f1b6a831c3.com",), ("bücher.example",), ("",), ("a" * 300,)], "query string")
    scores = {r.query: r.score for r in models.score_domains(asked, model).collect()}
    assert set(scores) == {"mail3.example.com", "0cc175b9c0f1b6a831c3.com", "bücher.example", "a" * 300}
    assert scores["0cc175b9c0f1b6a831c3.com"] > 0.5 and all(0 <= s <= 1 for s in scores.values())
    forms = models.normal_names(spark.createDataFrame([("Bücher.example.",), ("Plain.COM.",)], "query string")).collect()
    assert {(r.plain, r.ascii) for r in forms} == {("bücher.example", "xn--bcher-kva.example"), ("plain.com", "plain.com")}
    assert models.score_domains(asked, model, max_length=253).where(F.length("query") == 300).count() == 0
