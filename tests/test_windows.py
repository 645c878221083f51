import random

import pytest
from pyspark.sql import functions as F

from hawkgrid.operators.conn_windows import conn_windows
from hawkgrid.operators.dns_windows import dns_windows

S = 1_000_000


def _conn(spark, rows):
    return spark.createDataFrame(
        [(s, d, int(t * S), i, b) for i, (s, d, t, b) in enumerate(rows)],
        "orig_h string, resp_h string, t_us long, seq long, orig_bytes long")


def _brute(rows):
    out, seen = {}, {}
    ordered = sorted(enumerate(rows), key=lambda x: (x[1][2], x[0]))
    for i, (s, d, t, b) in ordered:
        past = seen.setdefault((s, d), [])
        past.append((t, max(0, b)))
        ts = [x for x, _ in past if x > t - 21600]
        gaps = [y - x for x, y in zip(ts, ts[1:])]
        beacon = False
        if len(ts) >= 3:
            mean = sum(gaps) / len(gaps)
            if mean >= 5:
                sd = (sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5
                beacon = sd / mean <= 0.5
        out[i] = (sum(x >= t - 10 for x, _ in past), sum(v for x, v in past if x >= t - 600), len(ts), beacon)
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 30])
def test_trailing_windows_match_brute_force(spark, hot_rows):
    rng = random.Random(11)
    rows = [("10.0.0.1", f"10.9.0.{rng.randrange(1, 3)}", rng.randrange(0, 40000, rng.choice([1, 5, 600])),
             rng.randrange(-5, 200_000)) for _ in range(400)]
    got = {r.seq: (r.connection_count, r.total_bytes, r.observations, r.is_beacon)
           for r in conn_windows(_conn(spark, rows), hot_rows=hot_rows).collect()}
    assert got == _brute(rows)


def test_flood_fires_and_fan_out_does_not(spark):
    flood = [("10.0.0.5", "10.0.0.99", 1000 + i * 0.005, 0) for i in range(1200)]
    fan = [("10.0.0.6", f"10.0.1.{i % 3}", 1000 + i * 0.005, 0) for i in range(1200)]
    out = conn_windows(_conn(spark, flood + fan)).where("is_flood")
    assert [r.source_ip for r in out.select("source_ip").distinct().collect()] == ["10.0.0.5"]
    assert out.count() == 201


def test_beacon_cases(spark):
    steady = [("10.0.0.1", "1.1.1.1", t, 0) for t in (0, 60, 119, 181, 240)]
    burst = [("10.0.0.2", "1.1.1.1", i * 0.01, 0) for i in range(20)]
    human = [("10.0.0.3", "1.1.1.1", t, 0) for t in (0, 7, 900, 905, 4000)]
    two = [("10.0.0.4", "1.1.1.1", t, 0) for t in (0, 60)]
    bad = [("not-an-ip", "1.1.1.1", 0, 0)]
    fired = conn_windows(_conn(spark, steady + burst + human + two + bad)).where("is_beacon")
    assert {r.source_ip for r in fired.collect()} == {"10.0.0.1"}


def test_many_small_transfers_add_up(spark):
    rows = [("10.0.0.1", "1.1.1.1", i * 10, 30_000) for i in range(50)]
    assert conn_windows(_conn(spark, rows)).where("is_exfil").count() == 50 - 33


def _dns(spark, rows):
    return spark.createDataFrame(
        [(s, int(t * S), i, q, rc, kind) for i, (s, t, q, rc, kind) in enumerate(rows)],
        "orig_h string, t_us long, seq long, query string, rcode int, event_type string")


def _dns_brute(rows):
    out, state = {}, {}
    for i, (s, t, q, rc, kind) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        z = state.setdefault(s, {"names": set(), "q": None, "n": 0, "r": None, "x": 0, "xt": None})
        if kind == "dns":
            if z["q"] is None or t - z["q"] > 60:
                z["names"] = set()
            z["names"].add(q)
            z["q"] = t
            out[i] = (min(200, len(z["names"])), z["n"] if z["r"] is not None and t - z["r"] <= 60 else 0,
                      z["x"] if z["xt"] is not None and t - z["xt"] <= 60 else 0)
        else:
            z["n"] = 1 + (z["n"] if z["r"] is not None and t - z["r"] <= 60 else 0)
            z["r"] = t
            if rc == 3:
                z["x"] = 1 + (z["x"] if z["xt"] is not None and t - z["xt"] <= 60 else 0)
                z["xt"] = t
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_dns_sessions_match_brute_force(spark, hot_rows):
    rng = random.Random(2)
    rows, t = [], 0.0
    for _ in range(500):
        t += rng.choice([0, 1, 5, 20, 59, 60, 61, 90])
        rows.append((f"10.0.0.{rng.randrange(1, 3)}", t, f"d{rng.randrange(30)}.com", rng.choice([0, 3]),
                     rng.choice(["dns", "dns_response"])))
    got = {r.seq: (r.distinct_domains, r.total_responses, r.nxdomain_responses)
           for r in dns_windows(_dns(spark, rows), hot_rows=hot_rows).collect()}
    assert got == _dns_brute(rows)


def test_bursts(spark):
    names = [("10.0.0.1", i * 0.5, f"n{i}.com", None, "dns") for i in range(250)]
    failing = [("10.0.0.2", i, "a.com", 3 if i % 2 else 0, "dns_response") for i in range(8)]
    failing.append(("10.0.0.2", 9, "a.com", None, "dns"))
    single = [("10.0.0.3", 0, "a.com", 3, "dns_response"), ("10.0.0.3", 1, "a.com", None, "dns")]
    out = dns_windows(_dns(spark, names + failing + single)).where("reason is not null")
    by_source = {r.source_ip: (r.reason, r.n, r.top) for r in out.groupBy("source_ip", "reason").agg(
        F.count("*").alias("n"), F.max("distinct_domains").alias("top")).collect()}
    assert by_source == {"10.0.0.1": ("distinct_domain_burst", 211, 250), "10.0.0.2": ("high_nxdomain_rate", 1, 1)}
