import json
import os
import random

from pyspark.sql import functions as F

from hawkgrid.operators.conn_windows import conn_windows
from hawkgrid.operators.correlate import correlated_incidents
from hawkgrid.operators.dns_windows import dns_windows
from hawkgrid.sources import logs
from hawkgrid.streaming import jobs, sinks
from hawkgrid.streaming.state import stream_conn_windows, stream_dns_windows, stream_incidents
from tests.test_correlation import SCHEMA, random_alerts

S = 1_000_000


def _run(spark, tmp_path, rows, transform, parts=3):
    """Feed rows as time-ordered files, one per micro-batch; return everything emitted."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ordered = rows.orderBy("t_us", "seq").collect()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * size:(i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        transform(stream).writeStream.foreachBatch(lambda b, i: sinks.write_batch(b, out, i))
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination(400)
    assert query.exception() is None
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def test_conn_windows_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = spark.createDataFrame(
        [("10.0.0.1", f"1.1.1.{rng.randrange(2)}", rng.randrange(9000) * S, i, rng.randrange(90_000)) for i in range(200)],
        "orig_h string, resp_h string, t_us long, seq long, orig_bytes long")
    pick = lambda df: sorted(
        (r.seq, r.connection_count, r.total_bytes, r.observations, r.is_flood, r.is_exfil, r.is_beacon) for r in df.collect())
    streamed = _run(spark, tmp_path, rows, lambda s: stream_conn_windows(s, rate_min_count=2))
    assert pick(streamed) == pick(conn_windows(rows, rate_min_count=2))


def test_dns_windows_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([0, 1, 30, 60, 61])
        rows.append(("10.0.0.1", t * S, i, f"d{rng.randrange(20)}.com", rng.choice([0, 3]), rng.choice(["dns", "dns_response"])))
    rows = spark.createDataFrame(
        rows, "orig_h string, t_us long, seq long, query string, rcode int, event_type string")
    pick = lambda df: sorted(
        (r.seq, r.distinct_domains, r.total_responses, r.nxdomain_responses, r.reason or "") for r in df.collect())
    args = {"distinct_min": 5, "responses_min": 3}
    streamed = _run(spark, tmp_path, rows, lambda s: stream_dns_windows(s, **args))
    assert pick(streamed) == pick(dns_windows(rows, **args))


def test_incident_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(random_alerts(150), SCHEMA)
    pick = lambda df: sorted(
        (r.incident_id, r.trigger_n, r.severity, r.risk_score, tuple(r.threat_classes), tuple(r.affected_entities),
         tuple(r.tactics), tuple(r.related_alert_ids), r.alert_count, r.entity_count) for r in df.collect())
    assert pick(_run(spark, tmp_path, rows, stream_incidents)) == pick(correlated_incidents(rows))


def test_a_flooding_pair_is_counted_whole(spark, tmp_path):
    rng = random.Random(11)
    times = sorted(rng.randrange(10 * S) for _ in range(20_000)) + [30 * S, 595 * S, 609 * S + 5, 900 * S, 21_605 * S]
    rows = spark.createDataFrame(
        [("10.0.0.1", "1.1.1.1", t, i, 1) for i, t in enumerate(times)], "orig_h string, resp_h string, t_us long, seq long, orig_bytes long")
    pick = lambda df: sorted((
        r.seq, r.connection_count, r.total_bytes, r.observations, r.is_flood, r.is_exfil, r.is_beacon,
        None if r.coefficient_of_variation != r.coefficient_of_variation or r.coefficient_of_variation is None
        else round(r.coefficient_of_variation, 4)) for r in df.collect())
    streamed = pick(_run(spark, tmp_path, rows, lambda s: stream_conn_windows(s, slot_us=S), parts=5))
    assert streamed == pick(conn_windows(rows)) and max(r[1] for r in streamed) == 20_000


def test_many_names_of_a_source_are_counted(spark, tmp_path):
    rows = spark.createDataFrame(
        [("10.0.0.1", S + i * S // 10, i, f"n{i % 400}.com", None, "dns") for i in range(600)]
        + [("10.0.0.1", 200 * S + i, 600 + i, f"n{i}.com", None, "dns") for i in range(5)],
        "orig_h string, t_us long, seq long, query string, rcode int, event_type string")
    pick = lambda df: sorted((r.seq, r.distinct_domains, r.reason or "") for r in df.collect())
    streamed = pick(_run(spark, tmp_path, rows, lambda s: stream_dns_windows(s, distinct_min=300)))
    assert streamed == pick(dns_windows(rows, distinct_min=300))
    assert max(r[1] for r in streamed) == 400 and streamed[-1][1] == 5 and sum(r[2] != "" for r in streamed) == 301


def test_a_storm_of_alerts_keeps_its_first_one(spark, tmp_path):
    rows = [("10.0.0.1", S + i * 50_000, i, f"a{i % 4000}", "C2" if i else "Worm", "low" if i else "critical", 0.55 if i else 0.95,
             "m2" if i else "m1", f"1.1.{i % 7}.{i % 250}", None, i % 1000 == 999) for i in range(5000)]
    rows = spark.createDataFrame(rows, SCHEMA)
    pick = lambda df: sorted((
        r.trigger_n, r.risk_score, r.severity, tuple(r.threat_classes), tuple(r.affected_entities), tuple(r.related_alert_ids),
        r.alert_count, r.entity_count) for r in df.collect())
    streamed = pick(_run(spark, tmp_path, rows, stream_incidents))
    assert streamed == pick(correlated_incidents(rows))
    assert {r[1] for r in streamed} == {95.87} and streamed[-1][0] == 4000


def test_files_to_incidents_in_one_query(spark, tmp_path):
    """Rules, windows of pairs and sources, and correlation as steps of one query; one late row is counted and repaired."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    conn = lambda i, t, **kw: {
        "event_type": "conn", "ts": t, "seq": i, "uid": f"C{i}", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "id.resp_p": 443,
        "conn_state": "SF", "orig_pkts": 5, "orig_bytes": 10, "resp_bytes": 10, "duration": 1.0} | kw
    dns = lambda i, t, q, **kw: {
        "event_type": "dns", "ts": t, "seq": i, "uid": f"D{i}", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "query": q} | kw
    first = [conn(1, 1000.0, conn_state="REJ", orig_pkts=500), conn(2, 1001.0, orig_bytes=2_000_000)]
    first += [conn(10 + i, 1002.0 + i / 10) for i in range(6)]
    first += [dns(100 + i, 1003.0 + i / 10, f"n{i}.com") for i in range(6)]
    second, between = [conn(200, 9000.0)], [conn(250, 9000.5)]
    third = [conn(300, 1004.0), conn(301, 9001.0, conn_state="REJ", orig_pkts=500)]
    for k, lines in enumerate((first, second, between, third)):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        os.utime(source / f"{k}.json", (k + 1, k + 1))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    events = logs.parse_events(lines.withColumn("file", F.lit(None).cast("string")), "s1")
    alerts = jobs.all_alerts(events, delay="1 minute", conn_args={"rate_min_count": 5}, dns_args={"distinct_min": 5})
    query = jobs.start_incidents(alerts, out, str(tmp_path / "ckpt"))
    query.awaitTermination(300)
    assert query.exception() is None and jobs.late_rows(query) == 1
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()
    classes = {c for r in found for c in r.threat_classes}
    assert classes == {"DDoS", "Data Exfiltration", "DGA / DNS Tunnelling"}
    assert all(r.trace_id and r.trace_id[0] in "CD" for r in found) and max(r.risk_score for r in found) > 99


def test_a_fingerprint_holds_from_the_batch_it_is_added_before(spark, tmp_path):
    source, out, table = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ja4")
    source.mkdir()
    events = [{"event_type": "conn", "ts": 10.0 + i, "seq": i, "uid": f"C{i}", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8",
               "conn_state": "SF", "orig_pkts": 5, "id.resp_p": 443, "orig_bytes": 1, "resp_bytes": 1, "ja4": ja4}
              for i, ja4 in enumerate(("old", "new", "old", "new", "timed", "timed"))]
    versions = "ja4 string, valid_from_us long, valid_to_us long"
    spark.createDataFrame([("old", 0, None)], versions).write.parquet(table)
    for k, (part, added) in enumerate(((events[:2], [("new", 0, None), ("timed", 14_500_000, None)]), (events[2:], []))):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        lines = spark.readStream.text(str(source)).withColumn("file", F.lit(None).cast("string"))
        jobs.start_rule_alerts(logs.parse_events(lines, "s1"), out, str(tmp_path / "check"), table).awaitTermination(120)
        if added:
            spark.createDataFrame(added, versions).write.mode("append").parquet(table)
    found = {(r.batch, r.seq) for r in spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()}
    assert found == {(0, 0), (1, 2), (1, 3), (1, 5)}


def test_late_events_are_repaired_in_batch(spark):
    rows = spark.createDataFrame(
        [("10.0.0.1", "1.1.1.1", i * S, i, 100) for i in range(40)] + [("10.0.0.2", "1.1.1.1", 5 * S, 90, 1)],
        "orig_h string, resp_h string, t_us long, seq long, orig_bytes long")
    whole = {r.seq: r.connection_count for r in conn_windows(rows).collect()}
    keys = ["source_ip", "destination_ip"]
    events = rows.withColumnsRenamed({"orig_h": "source_ip", "resp_h": "destination_ip"})
    streamed = events.where("seq <> 20")
    windows = lambda df: conn_windows(df.withColumnsRenamed({"source_ip": "orig_h", "destination_ip": "resp_h"}))
    again = {r.seq: r.connection_count for r in jobs.repaired(events, streamed, windows, keys, 10 * S).collect()}
    assert again == {k: v for k, v in whole.items() if 20 <= k <= 30}


def _message(i, **changes):
    body = {"timestamp": "2024-01-01T00:00:00Z", "alert_id": f"a{i}", "event_type": "conn", "threat_class": "DDoS",
            "confidence_score": 0.9, "severity": "high", "source_ip": "10.0.0.1", "schema_version": "1.0",
            "evidence": {"n": i}}
    body.update(changes)
    return json.dumps(body)


def test_alert_sink_dedupes_rejects_and_survives_a_retry(spark, tmp_path):
    table, dead = str(tmp_path / "alerts"), str(tmp_path / "dead")
    sink = sinks.alert_sink(table, dead, tenant_id=7)
    first = [_message(1), _message(2), _message(1, severity="low"), _message(3, severity="urgent"), "{broken",
             _message(4, id=99), _message(5, source_ip="01.2.3.4")]
    frame = lambda lines: spark.createDataFrame(list(enumerate(lines)), "offset long, value string")
    sink(frame(first), 0)
    sink(frame(first), 0)
    sink(frame([_message(2, severity="critical"), _message(6)]), 1)
    rows = {r.alert_id: (r.tenant_id, r.severity) for r in sinks.current_alerts(spark, table).collect()}
    assert rows == {"a1": (7, "low"), "a2": (7, "critical"), "a6": (7, "high")}
    errors = [r.error for r in spark.read.parquet(f"{dead}/batch=0").collect()]
    assert len(errors) == 4 and all(e.startswith("SchemaValidationError") for e in errors)


def test_alert_table_writes_only_touched_partitions(spark, tmp_path):
    table, dead = str(tmp_path / "alerts"), str(tmp_path / "dead")
    frame = lambda lines: spark.createDataFrame(list(enumerate(lines)), "offset long, value string")
    stamps = {d: f"2024-01-0{d}T00:00:00Z" for d in (1, 2, 3)}
    sinks.alert_sink(table, dead, 7)(frame([_message(i, timestamp=stamps[1 + i % 2]) for i in range(6)]), 0)
    sinks.alert_sink(table, dead, 8)(frame([_message(1, timestamp=stamps[1])]), 1)
    store = sinks.AlertTable(spark, table)
    current = lambda: {(r.tenant_id, r.alert_id): r.severity for r in store.read().collect()}
    first = current()
    assert len(first) == 7 and store.compact() == 1 and current() == first
    files = lambda: {p.relative_to(table): p.stat().st_mtime_ns for p in (tmp_path / "alerts" / "base").rglob("*.parquet")}
    before = files()
    # A newer version with another day stays in its alert's partition; a new alert opens one.
    sinks.alert_sink(table, dead, 7)(frame([_message(1, severity="low", timestamp=stamps[3]), _message(9, timestamp=stamps[3])]), 2)
    changed = first | {(7, "a1"): "low", (7, "a9"): "high"}
    assert current() == changed and files() == before and store.compact() == 2 and current() == changed
    after = files()
    moved = {str(p.parent) for p in before.keys() ^ after.keys()}
    assert moved == {"base/tenant_id=7/day=2024-01-02", "base/tenant_id=7/day=2024-01-03"}
    assert store.compact() == 2 and files() == after
    sinks.alert_sink(table, dead, 8)(frame([_message(1, severity="critical", timestamp=stamps[1])]), 3)
    assert current()[8, "a1"] == "critical" and current()[7, "a1"] == "low"


def test_dead_letter_replay(spark, tmp_path):
    source, target = tmp_path / "dead.jsonl", str(tmp_path / "input")
    lines = [json.dumps({"error": "x", "alert": json.loads(_message(i))}) for i in range(2)]
    lines.append(json.dumps({"error": "x", "alert": json.loads(_message(2)) | {"is_replay": False}}))
    source.write_text("\n".join([*lines, "{oops", "", json.dumps({"error": "no alert"})]))
    assert sinks.replay_to(spark, str(source), target, dry_run=True).count() == 3
    sinks.replay_to(spark, str(source), target, limit=2)
    assert spark.read.text(target).count() == 2
    # Through the sink and back: the mark is still there.
    table = str(tmp_path / "alerts")
    lines = spark.createDataFrame([(i, r.value) for i, r in enumerate(spark.read.text(target).collect())], "offset long, value string")
    sinks.alert_sink(table, str(tmp_path / "dead"), 7)(lines, 0)
    assert [r.is_replay for r in sinks.current_alerts(spark, table).collect()] == [True, True]


def test_log_files_to_alerts(spark, tmp_path):
    logs_dir, events, dead, alerts = (str(tmp_path / n) for n in ("logs", "events", "dead", "alerts"))
    (tmp_path / "logs").mkdir()
    conn = {"ts": 10.5, "seq": 1, "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "id.resp_p": 4444, "conn_state": "REJ",
            "orig_pkts": 500, "orig_bytes": "-", "resp_bytes": 0, "uid": "C1"}
    dns = {"ts": 11, "seq": 2, "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "query": "x" * 70 + ".com", "qtype_name": "TXT"}
    (tmp_path / "logs" / "conn.log").write_text("\n".join([json.dumps(conn), "{bad", json.dumps({"uid": "no ts"}), ""]))
    (tmp_path / "logs" / "dns.log").write_text(json.dumps(dns) + "\n")
    jobs.start_ingest(logs.stream_logs(spark, logs_dir), events, dead, str(tmp_path / "c1"), "s1").awaitTermination(60)
    stored = spark.read.option("basePath", events).parquet(f"{events}/batch=*")
    assert {(r.event_type, r.sensor_id) for r in stored.collect()} == {("conn", "s1"), ("dns", "s1")}
    assert spark.read.parquet(f"{dead}/batch=0").count() == 2
    stream = spark.readStream.schema(stored.drop("batch").schema).parquet(f"{events}/batch=*")
    found = jobs.stateless_alerts(stream.withColumn("error", F.lit(None).cast("string")))
    jobs.start_alerts(found, alerts, str(tmp_path / "c2")).awaitTermination(60)
    rows = spark.read.parquet(f"{alerts}/batch=0").collect()
    assert {r.model_name for r in rows} == {"RULE_DDOS_VOLUMETRIC", "RULE_DNS_TUNNELLING"}
    assert all("Live GeoIP" in json.loads(r.evidence) for r in rows)
    assert {r.trace_id for r in rows if r.event_type == "conn"} == {"C1"}
