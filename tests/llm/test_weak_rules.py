import re
from collections import Counter

import pytest

from hawkgrid.llm import queries, weak_rules

WORD = re.compile(r"[^ \t-\r]+")
ODD = [None, "", " \n\t", "one two", "a b c d e f g a b c d e", "x " * 40_000, "same line\nsame line\n\n\nother", "## && **\n|<>|",
       "a b c d e a b c d e a b c d e tail", "é ü ñ x", "\n".join(["w1 w2 w3 w4 w5 w6"] * 3), "q w e r t q w e r t y"]


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    found = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if found[w] > 1 for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_features_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in weak_rules.judge(docs).collect():
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert got == base(texts[row.doc_id]), texts[row.doc_id]
        assert not (row.base_failed and row.kept)


def brute_em(counts, n_rules, iterations):
    good, acc = weak_rules.FIRST_GOOD, [(weak_rules.FIRST_ON_GOOD, weak_rules.FIRST_ON_BAD)] * n_rules
    for _ in range(iterations):
        post = {}
        for v in counts:
            g, b = good, 1 - good
            for x, (on_good, on_bad) in zip(v, acc, strict=True):
                g *= {1: on_good, -1: 1 - on_good, 0: 1}[x]
                b *= {1: 1 - on_bad, -1: on_bad, 0: 1}[x]
            post[v] = g / (g + b)
        n = sum(counts.values())
        good = (sum(c * post[v] for v, c in counts.items()) + 1) / (n + 2)
        new = []
        for k in range(n_rules):
            voted = {v: c for v, c in counts.items() if v[k]}
            on_good = (sum(c * post[v] for v, c in voted.items() if v[k] > 0) + 1) / (sum(c * post[v] for v, c in voted.items()) + 2)
            on_bad = (sum(c * (1 - post[v]) for v, c in voted.items() if v[k] < 0) + 1) / (sum(c * (1 - post[v]) for v, c in voted.items()) + 2)
            new.append((max(on_good, 1 - on_bad), on_bad))
        acc = new
    return good, acc


def flat(result):
    return [result[0], *[x for pair in result[1] for x in pair]]


def test_estimates_match_brute_force(spark, sf):
    voted = weak_rules.votes(weak_rules.features(spark.read.parquet(f"{sf}/documents.parquet")))
    counts = Counter(tuple(r.votes) for r in voted.select("votes").collect())
    counted = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<tinyint>, n long")
    assert flat(weak_rules.estimate(counted, 6)) == pytest.approx(flat(brute_em(counts, len(weak_rules.rules()), 6)))


def test_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    long = [r for r in found if r.n_words >= 30]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {q: [r.kept for r in long if labels[r.doc_id] == q] for q in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) >= 0.97 and sum(kept[0]) / len(kept[0]) < 0.3


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op5_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, n_words int")
    assert weak_rules.judge(docs).count() == 3
    assert weak_rules.judge(docs.where("false")).count() == 0
