import json

from pyspark.sql import functions as F

from hawkgrid.sources import logs
from hawkgrid.sources.topic import TopicLog, read_topic, start_topic_sink, write_topic
from hawkgrid.streaming import jobs, sinks

SCHEMA = "key string, value string, t_us long"


def _rows(spark, low, high):
    return spark.range(low, high).select(
        F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("value"), (F.col("id") * 1_000_000).alias("t_us"))


def _keys(df):
    return sorted(int(r.key) for r in df.collect())


def test_batches_append_and_an_empty_topic_reads_as_none(spark, tmp_path):
    path = str(tmp_path / "topic")
    assert read_topic(spark, path).collect() == []
    write_topic(_rows(spark, 0, 50), path)
    write_topic(_rows(spark, 50, 60).coalesce(1), path)
    write_topic(_rows(spark, 0, 0), path)
    assert _keys(read_topic(spark, path)) == list(range(60))
    assert read_topic(spark, path).where("key = '7'").first().value == "v7"
    write_topic(spark.createDataFrame([(None, None, None), ("k", "", None)], SCHEMA), path)
    assert read_topic(spark, path).count() == 62


def test_a_stream_goes_on_from_its_offset_and_repeats_nothing(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write_topic(_rows(spark, 0, 10), source)
    for high in (20, 30):
        start_topic_sink(read_topic(spark, source, stream=True), target, check, "copy").awaitTermination(120)
        assert _keys(read_topic(spark, target)) == list(range(high - 10))
        write_topic(_rows(spark, high - 10, high), source)
    # The same batch committed again, as after a crash before the checkpoint: nothing is added, its segments go.
    log = TopicLog(target)
    before, last = log.numbers(), log.entry(log.numbers()[-1])
    (tmp_path / "out" / "segments" / "again.parquet").write_bytes(b"")
    log.append({"segments": ["again.parquet"], "newest": 1, "writer": "copy", "batch": last["batch"]})
    assert log.numbers() == before and not (tmp_path / "out" / "segments" / "again.parquet").exists()


def test_retention_removes_whole_segments(spark, tmp_path):
    path = str(tmp_path / "topic")
    for low in (0, 100, 200):
        write_topic(_rows(spark, low, low + 10), path)
    hour = 3_600_000_000
    assert sinks.apply_retention(path, "raw_traffic", now_us=hour + 50_000_000) == 1
    assert _keys(read_topic(spark, path)) == [*range(100, 110), *range(200, 210)]
    assert sinks.apply_retention(path, "raw_traffic", now_us=10**15) == 1, "the newest entry stays"
    write_topic(_rows(spark, 300, 301), path)
    assert _keys(read_topic(spark, path)) == [*range(200, 210), 300]


def test_topic_to_job_to_topic(spark, tmp_path):
    raw, alerts = str(tmp_path / "raw"), str(tmp_path / "alerts")
    event = {"event_type": "conn", "ts": 10.5, "seq": 1, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "conn_state": "REJ",
             "orig_pkts": 500, "id.resp_p": 443, "orig_bytes": 1, "resp_bytes": 1}
    write_topic(spark.createDataFrame([("a", json.dumps(event), 1), ("b", "{bad", 2)], SCHEMA), raw)
    lines = read_topic(spark, raw, stream=True).select("value", F.lit(None).cast("string").alias("file"))
    found = jobs.stateless_alerts(logs.parse_events(lines, "s1"))
    out = found.select(F.col("alert_id").alias("key"), F.to_json(F.struct(*found.columns)).alias("value"), "t_us")
    start_topic_sink(out, alerts, str(tmp_path / "check"), "rules").awaitTermination(120)
    row = read_topic(spark, alerts).first()
    assert row.key == "RULE_DDOS_VOLUMETRIC-1" and json.loads(row.value)["trace_id"] == "C1" and row.t_us == 10_500_000


def test_equal_lines_and_rows_get_numbers_of_their_own(spark, tmp_path):
    line = json.dumps({"ts": 1.0, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8"})
    (tmp_path / "conn.log").write_text("\n".join([line] * 3 + [json.dumps({"ts": 2.0})]))
    path = str(tmp_path / "conn.log")
    runs = [sorted(r.seq for r in logs.parse_events(logs.read_logs(spark, path)).collect()) for _ in range(2)]
    assert len(set(runs[0])) == 4 and runs[0] == runs[1]
    streamed = logs.parse_events(spark.read.text(path).withColumn("file", F.input_file_name())).collect()
    assert {r.seq for r in streamed} < set(runs[0]), "the first of equal lines has the number it has in a stream"
