import hashlib
import re

from hawkgrid.llm import pii, queries

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = [
    None, "", "a@b.c", "a@b.co_x@d.com x@y..z a@b.c.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0000.000255.1.2", "4539578763621486", "4539 5787-6362 1486 12",
    "+1 (389) 555-5010 +12 +1--- 7", "é🙂 me@x.org 🙂 10.0.0.1,10.0.0.2", "9" * 300, "a" * 2000, "1." * 200, "a." * 200 + "@b.c",
    "x@" + "y." * 300 + "z", "+1" + " " * 400, "- " * 200 + "+1234567 8", "((\"1.2.3.4\"))!!", "1.2.3.4" + "!" * 50, "1 " * 9 + "2 " * 10, "٣٤٥ +٣٤٥٦٧٨٩٠"]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.extract(docs).collect():
        want = base(texts[row.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (texts[row.doc_id] or "")[:200]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert set(text.split(",")) - {""} <= set(row.spans.split(","))


def test_very_long_runs(spark):
    texts = ["9" * 100_000, "a" * 200_000, "a." * 20_000 + "@b.c", "x@" + "y." * 30_000 + "z", "+1" + " " * 40_000, "1." * 4_000, "!" * 40_000 + "7",
             "1 " * 10_000]
    rows = {r.doc_id: r for r in pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k].n_email for k in range(4)] == [0, 0, 1, 1] and rows[5].n_ip == 1000 and rows[0].n_card == 0


def test_contexts_find_other_forms(spark):
    seeds = [f"please write to: user{k}@mail.example.org today" for k in range(12)]
    seeds += [f"her card number: 45395787636214{k:02d}" for k in range(100)]  # a tenth of them pass
    plain = [f"in the year {1900 + k} there were {k * 37} ships" for k in range(40)]
    hidden = "please write to: odd_name@localhost today"
    docs = spark.createDataFrame([(k, t, -1) for k, t in enumerate([*seeds, *plain, hidden])], "doc_id long, text string, base int")
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    last = rows[len(rows) - 1]
    at = hidden.index("odd_name")
    assert last.spans == f"email:{at}:{at + len('odd_name@localhost')}" and last.n_found == 1 and last.n_email == 0
    assert all(r.n_found == 0 for k, r in rows.items() if k < len(rows) - 1)


def brute_values(links, rounds):
    values = {}
    for _ in range(rounds):
        sure, seen, total = {}, {}, {}
        for pattern, value, kind, n in links:
            total[pattern] = total.get(pattern, 0) + n
            kinds = {kind: 1.0} if kind >= 0 else {k: c for (v, k), c in values.items() if v == value}
            for k, c in kinds.items():
                sure[pattern, k] = sure.get((pattern, k), 0) + n * c
                seen[pattern, k] = seen.get((pattern, k), 0) + 1
        p = {key: s / (total[key[0]] + pii.SMOOTHING) for key, s in sure.items() if seen[key] >= pii.MIN_SEEDS}
        p = {key: s for key, s in p.items() if s >= pii.MIN_PATTERN}
        doubt = {}
        for pattern, value, kind, _ in links:
            for (q, k), s in p.items():
                if kind < 0 and q == pattern and (k != 0 or "@" in value) and (k < 2 or sum(map(str.isdigit, value)) >= 4):
                    doubt[value, k] = doubt.get((value, k), 1.0) * (1 - min(s, 0.999))
        values = {key: 1 - d for key, d in doubt.items()}
    return values


def test_rounds_match_brute_force(spark):
    links = [("mail", f"u{k}@x.org", 0, 2) for k in range(8)] + [("mail", "odd@host", -1, 1), ("to", "odd@host", -1, 5), ("to", "a@x.org", 0, 9),
             ("to", "b@x.org", 0, 9), ("to", "c@x.org", 0, 9), ("to", "next@host", -1, 1), ("card", "12345", -1, 1),
             *[("card", f"{k}", 2, 3) for k in range(5)], ("mail", "7", -1, 1)]
    got = pii.believe(spark.createDataFrame(links, "pattern string, value string, kind int, n long"), 3).collect()
    want = brute_values(links, 3)
    assert {(r.value, r.kind): round(r.confidence, 9) for r in got} == {k: round(c, 9) for k, c in want.items()} and want


def test_native_plan_repeats_and_empty(spark, sf):
    plan = queries.op2_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "x 10.1.1.1"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_email, r.n_ip) for r in pii.extract(docs).collect()) == [(0, 0), (0, 1), (1, 0), (1, 0)]
    assert pii.extract(docs.where("false")).count() == 0
