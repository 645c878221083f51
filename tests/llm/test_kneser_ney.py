import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hawkgrid.llm import kneser_ney, queries

B, E = "\x02", "\x03"


class Brute:
    """The same model by dictionaries."""

    def __init__(self, texts):
        tri = Counter()
        for t in texts:
            s = [B, B, *t, E]
            tri.update(tuple(s[k:k + 3]) for k in range(len(s) - 2))
        bi = Counter(k[1:] for k in tri)
        uni = Counter(k[1:] for k in bi)
        self.levels = [uni, bi, tri]
        self.d = [self.discount(c) for c in self.levels]
        self.rows = []
        for c, d in zip(self.levels, self.d, strict=True):
            context = defaultdict(lambda: [0, 0.0])
            for k, n in c.items():
                context[k[:-1]][0] += n
                context[k[:-1]][1] += d[min(n, 3) - 1]
            self.rows.append(context)
        self.v = len(uni) + 1

    @staticmethod
    def discount(c):
        n = Counter(c.values())
        if not (n[1] and n[2] and n[3] and n[4]):
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))

    def p(self, key, level=None):
        level = len(key) - 1
        total, left = self.rows[level].get(key[:-1], (0, 0.0))
        lower = self.p(key[1:]) if level else 1 / self.v
        if not total:
            return lower
        n = self.levels[level][key]
        return (n - self.d[level][min(n, 3) - 1] if n else 0) / total + left / total * lower

    def perplexity(self, t):
        s = [B, B, *t, E]
        return math.exp(-sum(math.log(self.p(tuple(s[k:k + 3]))) for k in range(len(s) - 2)) / (len(t) + 1))


@pytest.mark.parametrize("dense,block", [(1 << 24, 8 << 20), (0, 5000)])
def test_perplexity_matches_brute_force(spark, sf, monkeypatch, dense, block):
    monkeypatch.setattr(kneser_ney, "_DENSE", dense)
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    trusted = queries.trusted(spark, sf)
    rows = docs.join(trusted, "doc_id", "left_semi").select("text").collect()
    model = Brute([r.text for r in rows])
    got = kneser_ney.classify(docs, trusted).select("doc_id", "perplexity").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for doc, value in got[::7]:
        assert value == pytest.approx(model.perplexity(texts[doc]), rel=1e-9)


def test_probabilities_sum_to_one():
    model = Brute(["abracadabra", "banana", "a cab"])
    for context in [("a", "b"), (B, B), ("x", "y")]:
        symbols = {k[-1] for k in model.levels[0]} | {"unseen"}
        assert sum(model.p((*context, s)) for s in symbols) == pytest.approx(1)


def test_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    rate = {q: sum(r.kept for r in found if r.quality == q) / sum(r.quality == q for r in found) for q in (0, 1)}
    assert rate[1] >= 0.99 and rate[0] < 0.4


def test_discounts_leave_something_for_the_unseen(spark):
    # One count of three and four of four: the third discount comes out below zero.
    counts = [1, 1, 1, 2, 3, 4, 4, 4, 4, 9]
    assert min(kneser_ney.discounts(spark.createDataFrame([(n,) for n in counts], "n long"))) > 0


def junk_kind(text):
    words = text.split()
    if sum(w.endswith("!!") for w in words) > 0.3 * len(words):
        return "shouting"
    if sum(any(c * 3 in w for c in "#$%&*") for w in words) > 0.2 * len(words):
        return "symbols"
    if " | " in text:
        return "table"
    return "repeats" if sum(a == b for a, b in zip(words, words[1:])) > 0.2 * len(words) else "other"


def test_every_kind_of_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    rows = queries.op3_quality(spark, sf).join(labels.where("quality = 0"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    kinds = defaultdict(list)
    for r in rows:
        kinds[junk_kind(r.text)].append(r.kept)
    rate = {k: sum(v) / len(v) for k, v in kinds.items()}
    assert rate["repeats"] < 0.3 and max(rate[k] for k in ("shouting", "symbols", "table")) < 0.02, rate


def test_threshold_is_the_held_out_quantile(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 1 and 2000")
    trusted = queries.trusted(spark, sf)
    halves = docs.join(trusted, "doc_id", "left_semi").select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()
    models = [Brute([r.text for r in halves if r.h != h]) for h in (0, 1)]
    held = sorted((models[r.h].perplexity(r.text), len(r.text) + 1) for r in halves)
    middle = held[math.ceil(0.5 * len(held)) - 1][0]
    judged = sorted(math.exp((n * math.log(p) + 100 * math.log(middle)) / (n + 100)) for p, n in held)
    got = {r.threshold for r in kneser_ney.classify(docs, trusted, min_trusted=10**9).select("threshold").collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(judged[math.ceil(0.99 * len(judged)) - 1], rel=1e-9)


ROWS = [(1, "plain text of some words", "en", 1), (2, None, "en", 2), (3, "", None, 3), (None, "plain words", None, 4),
        (4, "plain text of some words", "xx", 5), (4, "###$$$%%%&&&" * 40, "xx", 6), (4, "###$$$%%%&&&" * 40, "xx", 6),
        (5, "word " * 50_000, "en", 7), (6, "\U0001f600 日本", "en", 8)]


def test_nulls_repeats_and_filter(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, _row int")
    trusted = spark.createDataFrame([(1,), (None,), (5,)], "doc_id long")
    found = kneser_ney.classify(docs, trusted).collect()
    assert len(found) == len(ROWS)
    assert all((r.perplexity is None) == (r.n_chars == 0) for r in found)
    kept = sorted(kneser_ney.keep_good(docs, trusted, margin=50.0).collect(), key=repr)
    assert {r._row for r in kept} >= {1, 4, 5, 7} and not {2, 3} & {r._row for r in kept}
    assert kept[0].asDict().keys() == set(docs.columns)


def test_nothing_trusted_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, _row int")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted(r._row for r in kneser_ney.keep_good(docs, none).collect()) == [1, 4, 5, 6, 6, 7, 8]
    assert kneser_ney.classify(docs.where("false"), none).count() == 0


def test_models_are_joined_one_at_a_time(spark, monkeypatch):
    joins, kept = [], kneser_ney.durable
    monkeypatch.setattr(kneser_ney, "durable", lambda df: joins.append(
        df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or kept(df))
    docs = spark.createDataFrame([(i, "en", f"some plain text {i}") for i in range(20)], "doc_id long, lang string, text string")
    assert kneser_ney.classify(docs, docs.where("doc_id < 10").select("doc_id")).count() == 20
    # Six joins give one model's scores and one adds them; the plan of all three had 21.
    assert max(joins) <= 7


def keys_of(text):
    codes = [kneser_ney.BEGIN] * 2 + [ord(c) for c in text] + [kneser_ney.END]
    return [a << 42 | b << 21 | c for a, b, c in zip(codes, codes[1:], codes[2:])]


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("letters", [60, 400])
def test_a_block_is_worked_through_in_chunks(letters):
    some = random.Random(3)
    symbols = [chr(97 + k) for k in range(letters)]
    texts, size = [""], 0
    while size < kneser_ney.BLOCK_BYTES:
        texts.append("".join(some.choices(symbols[:30], k=3000)) + some.choice(symbols))
        size += len(texts[-1].encode())
    columns = [pa.array(range(len(texts))), pa.array(["en"] * len(texts)), pa.array(range(len(texts))), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "text_hash", "text"])
    blocks, packed = peak_mb(lambda: list(kneser_ney._pack(iter([batch]))))
    keys = blocks[0].column(4)[0].values.to_numpy()
    assert len(blocks) == 1 and keys.tolist() == sorted({k for t in texts for k in keys_of(t)})
    logps = [-np.random.default_rng(k).random(len(keys)) for k in range(3)]
    means, scored = peak_mb(lambda: kneser_ney._score_block(texts, keys, logps))
    for mean, logp in zip(means, logps, strict=True):
        known = dict(zip(keys.tolist(), logp.tolist(), strict=True))
        for t in range(0, len(texts), 97):
            assert mean[t] == pytest.approx(sum(known[k] for k in keys_of(texts[t])) / (len(texts[t]) + 1), rel=1e-9)
    # The arrays of the whole block at once took more than 200 and 300 MB in each worker.
    assert packed < 120 and scored < 120, (packed, scored)
