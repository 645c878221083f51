import collections
import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from hawkgrid.functions import display, flow, text
from hawkgrid.functions.net import is_internal, is_public_ipv4, normalise_ip
from hawkgrid.functions.parse import safe_float, safe_int


def _python_ip(value):
    try:
        return str(ipaddress.ip_address(value.strip()))
    except ValueError:
        return None


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(3)
    samples = [
        "1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "1::", "2001:db8:0:0:1:0:0:1", "fe80::1%eth0", "fe80::1%",
        "fe80::%a%b", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":1:2",
        "12345::", "g::", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3", "ABCD::EF01", "1:2:3:4:5:6:7::", "", "x",
        "1:2:3:4:5:6:1.2.3.4", ":::", " 10.0.0.1 ", "10.0.0.5}:evil{",
    ]
    for _ in range(150):
        groups = [rng.choice(["0", "0", "0", f"{rng.randrange(65536):x}"]) for _ in range(8)]
        samples += [":".join(groups), ipaddress.ip_address(":".join(groups)).exploded]
    rows = spark.createDataFrame([(s,) for s in samples], "ip string").select("ip", normalise_ip("ip").alias("n"))
    assert [r for r in rows.collect() if r.n != _python_ip(r.ip)] == []


@pytest.mark.parametrize("address, internal, public", [
    ("172.15.255.255", False, True), ("172.16.0.0", True, False), ("172.31.255.255", True, False),
    ("172.32.0.0", False, True), ("100.64.1.1", False, False), ("192.0.0.9", False, True), ("8.8.8.8", False, True),
    ("169.254.0.1", True, False), ("224.0.0.1", False, False), ("fc00::1", True, False), ("2001:4860::1", False, False),
    ("::ffff:10.0.0.1", True, False), ("garbage", True, False),
])
def test_internal_and_public(spark, address, internal, public):
    row = spark.createDataFrame([(address,)], "ip string").select(
        is_internal("ip").alias("i"), is_public_ipv4(F.col("ip")).alias("p")).first()
    assert (row.i, row.p) == (internal, public)


def test_safe_numbers(spark):
    rows = spark.createDataFrame([("-",), ("",), (None,), ("12",), ("x",), ("1.5",)], "v string").select(
        safe_int(F.col("v")).alias("i"), safe_float(F.col("v")).alias("f")).collect()
    assert [(r.i, r.f) for r in rows] == [(0, 0.0), (0, 0.0), (0, 0.0), (12, 12.0), (0, 0.0), (0, 1.5)]


def _entropy(s):
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in collections.Counter(s).values()) if n else 0.0


def test_entropy_and_shape(spark):
    rng = random.Random(5)
    names = ["", "a", "aaaa", "x_y-z", "bücher", "www.example.com"] + [
        "".join(rng.choices("abcdefghij0123456789-", k=rng.randrange(1, 70))) for _ in range(50)]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select(
        "s", text.shannon_entropy(F.col("s")).alias("e"), text.lexical_vector(F.col("s")).alias("v")).collect()
    for r in rows:
        assert r.e == pytest.approx(_entropy(r.s), abs=1e-9)
        if r.s:
            runs = "".join(c if c in "bcdfghjklmnpqrstvwxyz" else " " for c in r.s).split(" ")
            n = len(r.s)
            expected = [min(n / 63, 1), min(_entropy(r.s) / 5.25, 1), sum(c.isdigit() for c in r.s) / n,
                        sum(c in "aeiou" for c in r.s) / n, len(set(r.s)) / n,
                        min(max(map(len, runs)) / 10, 1), r.s.count("-") / n]
            assert list(r.v) == pytest.approx(expected, abs=1e-9)
        else:
            assert list(r.v) == [0.0] * 7


def test_windows_cover_long_names_and_share_the_budget(spark):
    long_name = "a" * 100 + "." + "b" * 60 + ".com"
    q = F.col("q")
    row = spark.createDataFrame([(long_name,)], "q string").select(
        text.name_variants(q, q).alias("v"), text.character_windows(text.name_variants(q, q)).alias("w")).first()
    assert row.v == [long_name, "b" * 60 + ".com", "a" * 100, "b" * 60]
    assert len(row.w) <= 32 and all(len(w) <= 35 for w in row.w)
    per_name = {v: [w for w in row.w if w in v] for v in row.v}
    assert all(per_name.values())
    short = spark.createDataFrame([("ab.co",)], "q string").select(
        text.character_windows(text.name_variants(q, q)).alias("w")).first()
    assert short.w == ["ab.co"]


def test_registrable_domain(spark):
    cases = {"www.Example.COM.": "example.com", "localhost": None, "a.b_c.com": None, "x.-bad.com": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select(
        "q", text.registrable_domain(F.col("q")).alias("d")).collect()
    assert {r.q: r.d for r in rows} == cases


def test_infra_suffix_has_no_dot_boundary_unless_strict(spark):
    rows = spark.createDataFrame([("d1.cloudfront.net.",), ("evilcloudfront.net",), ("x.org",)], "q string").select(
        text.is_known_infra(F.col("q")).alias("a"), text.is_known_infra(F.col("q"), strict=True).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(True, True), (True, False), (False, False)]


def test_states_and_display(spark):
    states = {"S_": "S0", "SR_RA": "REJ", "S_RA": "REJ", "FSPA_FSPA": "", "": "", "CON": "", "A_R": ""}
    rows = spark.createDataFrame([(k,) for k in states], "s string").select("s", flow.zeek_state(F.col("s")).alias("z"))
    assert {r.s: r.z for r in rows.collect()} == states
    row = spark.range(1).select(
        display.mitre_label(F.lit("Impact"), F.lit("T1498")).alias("a"),
        display.mitre_label(F.lit(""), F.lit(None).cast("string")).alias("b"),
        display.escape_markdown(F.lit("a_b[c](d)")).alias("c"),
        display.display_timestamp(F.lit("2024-01-02T03:04:05Z")).alias("d"),
        display.display_timestamp(F.lit("nope")).alias("e"),
        display.relative_time(F.lit(0), F.lit(7_300_000_000)).alias("f"),
    ).first()
    assert list(row) == ["Impact (T1498)", "Unmapped", r"a\_b\[c\]\(d\)", "2024-01-02 03:04:05 UTC", "Invalid Time", "2h ago"]
    groups = display.evidence_groups(F.create_map(
        F.lit("port"), F.lit("53"), F.lit("label_entropy"), F.lit("4.1"), F.lit("host"), F.lit("unknown")))
    row = spark.range(1).select(*[v.alias(k) for k, v in groups.items()]).first()
    assert (row.observed, row.inferred, row.unknown) == ({"port": "53"}, {"label_entropy": "4.1"}, {"host": "unknown"})
