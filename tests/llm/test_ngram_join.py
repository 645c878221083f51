import random

import numpy as np
import pyarrow as pa
import pytest

from hawkgrid.llm import ngram_join


def brute(rows, threshold=0.75):
    """Component of every row, from all pairs."""
    def words(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in "\t\n\v\f\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w]

    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= round(100 * threshold) * (len(one) + len(sets[j]) - both):
                parent[root(i)] = root(j)
            elif one and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return [(d, len(s), least.get(root(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n_bases, copies, length=60, vocabulary=500):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = " ".join(word() for _ in range(50))
    rows = []
    for _ in range(n_bases):
        base = [word() for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text) + (f" {passage}" if rng.random() < 0.3 else ""))
    rng.shuffle(rows)
    return [(3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("wide,chunk,block", [(24, 2048, 2000), (3, 64, 7)])
def test_components_match_brute_force(spark, monkeypatch, wide, chunk, block):
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "COLUMN_CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", block)
    rows = corpus(1, 40, 4) + [(9000 + k, t) for k, (_, t) in enumerate(corpus(2, 1, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == sorted(brute(rows))


def test_groups_are_not_multiplied_block_by_block(spark, monkeypatch):
    """A group of near copies in many row blocks is one component after the first products: its blocks do not meet again."""
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 20)
    rng = random.Random(5)
    base = [f"g{k}" for k in range(120)]
    texts = [" ".join(f"x{k}" if j == rng.randrange(120) else w for j, w in enumerate(base)) for k in range(400)]
    # These share the first 50 words with the group, and each other's, but are no copies of it.
    texts += [" ".join(base[:50] + [f"y{k}_{j}" for j in range(k)]) for k in range(1, 21)]
    rows = list(enumerate(texts))
    met = []

    def meeting(blocks, threshold):
        pairs = ngram_join_meeting(blocks, threshold)
        met.append((blocks.count(), blocks.where("big is not null").count(), pairs.count()))
        return pairs

    ngram_join_meeting = ngram_join._meeting
    monkeypatch.setattr(ngram_join, "_meeting", meeting)
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows))
    for n, n_big, pairs in met:
        assert n_big >= 10
        assert pairs <= n * (n - n_big)


def test_row_blocks_are_small(spark):
    """Pairs of blocks go through Spark as rows, so the bytes of a block are bounded, not only its rows."""
    assert ngram_join.BLOCK_BYTES <= 4 << 20
    parts = [pa.RecordBatch.from_arrays(
        [pa.array(range(40), pa.int64()), pa.array([np.arange(40_000, dtype=np.uint64).tobytes()] * 40, pa.binary())], names=["row", "set"])]
    held = list(ngram_join._cut(iter(parts), 1000, ngram_join.BLOCK_BYTES))
    assert [r[0] for some in held for r in some] == list(range(40))
    assert all(sum(len(r[1]) for r in some) < ngram_join.BLOCK_BYTES + 320_001 for some in held)


def test_shared_ngrams_come_last_among_many():
    """Among a billion n-grams, one that 30 texts share comes after the first part of a text."""
    rng = np.random.default_rng(7)
    counts = rng.poisson(1e9 / (1 << ngram_join.COUNTER_BITS), 1 << ngram_join.COUNTER_BITS)
    early = 0
    for _ in range(200):
        hashes = np.unique(rng.integers(0, 2**64, 400, np.uint64))
        common = rng.choice(hashes)
        at = int(common >> np.uint64(64 - ngram_join.COUNTER_BITS))
        counts[at] += 30
        early += common in ngram_join.first_columns(hashes, counts, 0.75)
        counts[at] -= 30
    assert early <= 2


def test_counters(spark, monkeypatch):
    """Counters of several tasks and of several rounds of a task add up."""
    monkeypatch.setattr(ngram_join, "COUNTED", 7)
    texts = [f"a b c d e f{k} g h i j" for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = ngram_join._counters(docs.mapInArrow(ngram_join._measure(5), ngram_join._SIZES))
    expected = np.zeros(1 << ngram_join.COUNTER_BITS, np.int64)
    for text in texts:
        np.add.at(expected, (ngram_join.shingles(text.encode()) >> np.uint64(64 - ngram_join.COUNTER_BITS)).astype(np.int64), 1)
    assert (counts == expected).all()


def test_nulls_ties_and_clashing_names(spark):
    long = " ".join(f"t{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (7, long), (8, long + " end"),
            (7, long), (9, "other words are here now"), (9, "ONE TWO")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows] + [(None, "one two", 1, "x"), (None, "alone here", 1, "y")],
                                 "doc_id long, text string, row int, n string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([*brute(rows), (None, 1, 4), (None, 1, None)], key=repr)


def test_sample_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == sorted(brute(rows))


def test_block_product_with_itself():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(300)]
    one = (np.arange(300), np.array([len(s) for s in sets]), np.concatenate(sets))
    link = ngram_join.block_product(one, one, 0.75)
    assert link.tolist() == [[4 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y)) for y in sets] for x in sets]


def test_block_product():
    rng = np.random.default_rng(3)

    def side(k):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(k)]
        return sets, (np.arange(k), np.array([len(s) for s in sets]), np.concatenate(sets))

    (xs, one), (ys, two) = side(30), side(20)
    link = ngram_join.block_product(one, two, 0.75)
    assert link.tolist() == [[4 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y)) for y in ys] for x in xs]


def test_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
