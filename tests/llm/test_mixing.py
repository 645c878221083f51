import hashlib

import duckdb
import pytest

from hawkgrid.llm import mixing, queries


def fill(budget, children):
    """children: {name: (weight, limit)}; shares by repeated redistribution."""
    quota, open_, left = {}, dict(children), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, limit) in open_.items() if limit * total <= left * w}
        if not full:
            return quota | {k: left * w // total for k, (w, _) in open_.items()}
        for k in full:
            quota[k] = open_.pop(k)[1]
            left -= quota[k]
    return quota


def brute(rows, weights, total, epochs, seed):
    """rows: (doc_id, domain, lang, source, n)"""
    clean = [(d, *(x or "" for x in path), max(n or 0, 0)) for d, *path, n in rows]
    tokens = {}
    for _, *path, n in clean:
        tokens[tuple(path)] = tokens.get(tuple(path), 0) + n
    cap = {p: t * epochs for p, t in tokens.items()}
    budgets = {(): min(sum(tokens.values()) if total is None else total, sum(cap.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, budget in budgets.items():
            children = {}
            for p, c in cap.items():
                if p[:depth] == parent:
                    w = weights.get(level, {}).get(p[depth], 1)
                    children[p[:depth + 1]] = (w, children.get(p[:depth + 1], (0, 0))[1] + c)
            new |= fill(budget, children)
        budgets = new
    out = []
    for path, quota in budgets.items():
        t = tokens[path]
        whole, rest = (quota // t, quota % t) if t else (1, 0)
        own = sorted((r for r in clean if tuple(r[1:4]) == path), key=lambda r: (
            hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), str(r[0])))
        at, k = 0, 0
        while k < len(own):
            same = [r for r in own[k:] if r[0] == own[k][0]]
            out += [(r[0], whole + (at < rest)) for r in same]
            at += sum(r[4] for r in same)
            k += len(same)
    return sorted((str(d), c) for d, c in out if c)


ROWS = [(k, ["web", "books", None][k % 3], ["en", "de"][k % 2], f"s{k % 5}", (k * 37) % 101) for k in range(400)]
ROWS += [(5000 + k, "books", "fr", None, 3) for k in range(4)] + [(6000, "code", "en", "z", 0), (None, "web", "en", "s0", 50), (7, "web", "de", "s2", 9),
         (7, "web", "de", "s2", 9), (6001, "web", "en", "s1", None), (6002, "web", "en", "s1", -5)]


@pytest.mark.parametrize("total,epochs", [(None, 2), (500, 1), (10**7, 3), (0, 2), (15_001, 4)])
def test_quotas_and_copies_match_brute_force(spark, total, epochs):
    docs = spark.createDataFrame([(*r, -1) for r in ROWS], "doc_id long, domain string, lang string, source string, n_tokens long, copies int")
    got = mixing.mix(docs, mixing.DEFAULT_WEIGHTS, total, epochs).collect()
    assert sorted((str(r.doc_id), r.copies) for r in got) == brute(ROWS, mixing.DEFAULT_WEIGHTS, total, epochs, mixing.SEED)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)],
                                   "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.quota for r in mixing.leaf_quotas(leaves, {}, 800, 1).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(str, con.execute(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({mixing.SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op7_mixing(spark, sf).collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long")
    assert mixing.mix(docs, {}).count() == 0
