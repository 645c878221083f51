import ipaddress
import math
import random
import re

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hawkgrid.functions.net import address_hex
from hawkgrid.operators import gram_model, models, ranges
from hawkgrid.operators.enrich import enrich


def _mapped(ip):
    number = int(ipaddress.ip_address(ip))
    return number if ":" in ip else number + (0xFFFF << 32)


@pytest.mark.parametrize("ip", ["1.2.3.4", "255.0.0.1", "2001:db8::1", "::", "::ffff:10.1.2.3", "FE80::1%eth0", "1:2:3:4:5:6:7:8"])
def test_address_bits(spark, ip):
    got = spark.createDataFrame([(ip,)], "ip string").select(address_hex(F.col("ip"))).first()[0]
    assert got == f"{_mapped(ip.split('%')[0]):032x}"


def test_longest_prefix_equals_brute_force(spark):
    rng = random.Random(2)
    four = [f"{rng.randrange(1, 5)}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    six = [f"2001:db8:{rng.randrange(4):x}::{rng.randrange(65536):x}" for _ in range(150)]
    nets = [f"{ip}/{rng.choice([8, 13, 15, 16, 22, 24, 31, 32])}" for ip in rng.sample(four, 120)]
    nets += [f"{ip}/{rng.choice([0, 32, 45, 46, 47, 64, 126, 128])}" for ip in rng.sample(six, 60)] + ["9.9.9.9", "::1"]
    table = [(n, f"o{k}") for k, n in enumerate(nets)]
    bad = [("1.2.3/8", "x"), ("1.2.3.4/33", "x"), ("::1/129", "x"), ("", "x"), (None, "x"), ("1.2.3.4/8/9", "x"), ("1.2.3.4/", "x"), ("1.2.3.4/-1", "x")]
    asked = [*four, *six, "9.9.9.9", "nonsense", None, "300.1.1.1", four[0]]
    expected = {}
    for ip in asked:
        try:
            number = _mapped(ip)
        except (ValueError, TypeError):
            continue
        hits = []
        for net, owner in table:
            address, _, size = net.partition("/")
            bits = (int(size) if size else 128 if ":" in address else 32) + (0 if ":" in address else 96)
            if (_mapped(address) ^ number) >> (128 - bits) == 0:
                hits.append((-bits, owner))
        if hits:
            expected[ip] = (-min(hits)[0], min(hits)[1])
    out = ranges.longest_prefix(
        spark.createDataFrame([(i,) for i in asked], "ip string"), spark.createDataFrame(table + bad, "cidr string, owner string"))
    assert {r.ip: (r.bits, r.owner) for r in out.collect()} == expected
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_ranges_give_no_rows(spark):
    none = spark.createDataFrame([], "cidr string, owner string")
    assert ranges.longest_prefix(spark.createDataFrame([("1.2.3.4",)], "ip string"), none).collect() == []


def test_ranges_enrich_alerts(spark):
    alerts = spark.createDataFrame(
        [("a1", "10.0.0.1", "8.8.4.4", "{}"), ("a2", "9.9.9.9", "10.0.0.2", "{}")],
        "alert_id string, source_ip string, destination_ip string, evidence string")
    table = spark.createDataFrame([("8.8.0.0/16", "Lyon", "FR", "net", True)], "cidr string, city string, country string, isp string, hosting boolean")
    out = {r.alert_id: r.evidence for r in enrich(alerts, ranges.intel_from_ranges(alerts, table)).collect()}
    assert "Lyon, FR" in out["a1"] and "Lyon" not in out["a2"]


def test_gram_scores_equal_brute_force(spark):
    names = [("x9k2q7zt4w8v.com", 1.0), ("zq8xk3v9w2jt7p.net", 1.0), ("mail.example.com", 0.0), ("shop-online.de", 0.0), ("a", 0.0)]
    asked = ["mail.shop.com", "q7zt4w8vx9k2.com", "www." + "longlabel" * 8 + ".example.org", "a" * 400, "bücher.example", "", None, " mail.shop.com "]
    weights = gram_model.fit_weights(spark.createDataFrame(names, "domain string, label double"))
    table = {r.gram: r.weight for r in weights.collect()}
    scored = {r.query: r.score for r in gram_model.score_windows(spark.createDataFrame([(q,) for q in asked], "query string"), weights).collect()}

    cut = lambda n: [n] if len(n) <= 35 else [n[k:k + 35] for k in range(0, len(n) - 34, 15)] + ([n[-35:]] if (len(n) - 35) % 15 else [])
    parts = lambda t: [t[k:k + n] for n in (2, 3) for k in range(len(t) - n + 1)]
    counts = {y: {} for y in (0.0, 1.0)}
    for name, y in names:
        for g in (g for w in cut(name) for g in parts(w)):
            counts[y][g] = counts[y].get(g, 0) + 1
    kinds = counts[0.0].keys() | counts[1.0].keys()
    share = lambda g, y: (counts[y].get(g, 0) + 1) / (sum(counts[y].values()) + len(kinds))
    assert table == {g: round(math.log(share(g, 1.0) / share(g, 0.0)) * 1e9) for g in kinds} | {"": round(math.log(3 / 4) * 1e9)}

    def score(name):
        whole = name.strip().rstrip(".").lower()
        labels = [p for p in whole.split(".") if p]
        forms = [whole] + ([".".join(labels[-2:]), *[p for p in labels if len(p) >= 4]] if len(labels) > 1 else [])
        best = max(sum(table.get(g, 0) for g in parts(w)) for form in forms for w in cut(form))
        return 1 / (1 + math.exp(-(best + table[""]) / 1e9))

    plain = [q for q in asked if q and q.isascii()]
    assert {q: scored[q] for q in map(str.strip, plain)} == pytest.approx({q.strip(): score(q) for q in plain})
    assert set(scored) == {q.strip() for q in asked if q} and 0 < scored["bücher.example"] < 1


def test_grams_meet_their_weights_without_a_shuffle(spark):
    weights = gram_model.fit_weights(spark.createDataFrame([("abc.com", 1.0), ("xyz.org", 0.0)], "domain string, label double"))
    scored = gram_model.score_windows(spark.createDataFrame([("abcabc.com",), ("xyz.org",)], "query string"), weights)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text#" in plan and not re.search(r"hashpartitioning\([^)]*gram#", plan)


def test_equal_windows_are_classified_once(spark):
    class Recorder:
        def transform(self, rows):
            self.rows = rows
            return rows.withColumn("probability", array_to_vector(F.array(F.lit(0.75), F.length("text") / 100.0)))

    model = Recorder()
    asked = spark.createDataFrame([("aa1.shared.com",), ("bb22.shared.com",), (" bb22.shared.com",)], "query string")
    scores = {r.query: r.score for r in models.score_domains(asked, model).collect()}
    assert scores == {"aa1.shared.com": 0.14, "bb22.shared.com": 0.15}
    texts = [r.text for r in model.rows.select("text").collect()]
    assert sorted(texts) == ["aa1.shared.com", "bb22", "bb22.shared.com", "shared", "shared.com"]


def test_one_label_gives_no_weights(spark):
    weights = gram_model.fit_weights(spark.createDataFrame([("abc.com", 1.0)], "domain string, label double"))
    assert {r.weight for r in weights.where("gram <> ''").collect()} == {0}


def test_flow_model_leaves_no_error_in_its_subspace(spark):
    rng = random.Random(4)
    rows = [(int(math.exp(a)), int(math.exp(a)), float(b), int(math.exp(c)) + 1) for a, b, c in (
        (rng.uniform(3, 10), rng.uniform(0, 60), rng.uniform(0, 5)) for _ in range(400))]
    flows = spark.createDataFrame(rows, "orig_bytes long, resp_bytes long, duration double, orig_pkts long")
    model = models.flow_model(models.flow_moments(flows).first(), components=5)
    assert models.score_flows(flows, model).agg(F.max("reconstruction_mse")).first()[0] < 1e-20
    three = models.flow_model(models.flow_moments(flows).first(), components=3)
    assert models.score_flows(flows, three).agg(F.avg("reconstruction_mse")).first()[0] < 1e-3
