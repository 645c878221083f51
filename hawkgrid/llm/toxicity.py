"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. *Examples.* At most ``MAX_EXAMPLES`` labelled texts, half of each label, in the order of a hash; equal texts count once.
   This bound is a parameter of the classifier. Votes are weighted so that each label counts as in all labelled rows.
2. *Terms.* Words and beginnings of words (insults also come as stems with changing ends) whose share of texts is clearly
   higher among examples of label 1: by two-sample z score and at least ``MIN_LIFT`` times, in at least ``MIN_TEXTS`` of them; all such
   terms, so their number is bounded by the texts of the examples alone. Other terms say nothing about the label and only add to the
   length of a vector.
3. *Vectors.* Every whole text is read once more for these terms; document frequencies cover all documents.
4. *Index.* Examples with equal vectors are one entry. Entries lie in blocks of similar ones; each block has its
   own postings and, per term, the largest weight in it. A query adds these up to a bound of its cosine with anything in
   the block, takes blocks from the highest bound down, and stops when no bound reaches the k-th best cosine: the result is exact.
   The index is bounded by the examples and these terms, so every task has a copy of it.
5. *Scores.* Neighbours vote with the inverse of their distance. Votes of the examples themselves, each without
   its own, are set against their labels in bins; a rising step function from vote to share of label 1 is the calibration.
   A text without any of the terms gets the share among such examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches
from hawkgrid.session import durable

MAX_EXAMPLES, MIN_Z, MIN_TEXTS, MIN_LIFT = 20_000, 4.0, 4, 4.0
STEMS = range(3, 9)
NEIGHBOURS, BLOCK, BINS, NEAR, PRIOR = 25, 64, 20, 0.05, 1.0
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def word_terms(word: str) -> list[str]:
    """The word itself and its proper beginnings, marked by a hyphen."""
    return [word, *[f"{word[:k]}-" for k in STEMS if k < len(word)]]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


# Fitting -----------------------------------------------------------------------------------------------------------

def sample_examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """Examples (doc_id, toxic) outside fold 0, and the weight of one example of each label.

    Labels that contradict each other count as 1. The first ``max_examples / 2`` of each label by a hash of the id are taken.
    """
    usable = (
        labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0))
    usable = durable(usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    totals = {r["toxic"]: r["n"] for r in usable.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = max_examples // 2
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    return durable(parts[0].unionByName(parts[1])), {y: totals.get(y, 0) / max(min(totals.get(y, 0), half), 1) for y in (0, 1)}


def select_terms(docs: DataFrame, examples: DataFrame) -> list[str]:
    """Words that speak for label 1, from the distinct texts of the examples."""
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(examples), "doc_id").select("text", "toxic").dropDuplicates())
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def count(parts):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found[toxic].update({t for w in set(words(text)) for t in word_terms(w)})
                found[toxic][""] += 1  # counts texts
        yield from batches(schema, ((t, found[1][t], found[0][t]) for t in found[1].keys() | found[0].keys()))

    terms = durable(texts.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b")))
    total = terms.where("term = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return []
    n, m = total["a"], total["b"]
    p, q = (F.col("a") + 0.5) / (n + 1), (F.col("b") + 0.5) / (m + 1)
    z = (p - q) / F.sqrt(p * (1 - p) / n + q * (1 - q) / m)
    best = terms.where((F.col("term") != "") & (F.col("a") >= MIN_TEXTS) & (p >= MIN_LIFT * q)).select("term", z.alias("z")).where(F.col("z") >= MIN_Z)
    return sorted(r["term"] for r in best.select("term").collect())


_VECTORS = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per row: doc_id, numbers of the terms in the text, ascending, and how often each occurs."""
    number = {t: k for k, t in enumerate(terms)}

    def rows(parts):
        known: dict[str, list[int]] = {}
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found: Counter = Counter()
                for word in words(text or ""):
                    at = known.get(word)
                    if at is None:
                        if len(known) > 500_000:
                            known.clear()
                        at = known[word] = [number[t] for t in word_terms(word) if t in number]
                    if at:
                        found.update(at)
                yield doc_id, sorted(found), [found[t] for t in sorted(found)]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda parts: batches(_VECTORS, rows(parts)), "doc_id long, terms array<int>, counts array<int>")


# Index -------------------------------------------------------------------------------------------------------------

class BlockMaxIndex:
    """Entries of (vector, weight of label 1, weight of all, smallest doc_id)."""

    def __init__(self, idf: np.ndarray, entries: list[tuple[tuple, tuple, float, float, int]]):
        self.idf = idf
        weighted = [self.weigh(t, c) for t, c, *_ in entries]
        # Similar entries share a block: by heaviest term, then its weight.
        heavy = [(int(t[np.argmax(w)]), -float(w.max()), e[4]) if len(t) else (-1, 0.0, e[4]) for e, (t, w) in zip(entries, weighted, strict=True)]
        order = sorted(range(len(entries)), key=lambda k: (heavy[k], entries[k][0], entries[k][1]))
        self.keys = {(entries[k][0], entries[k][1]): at for at, k in enumerate(order)}
        self.toxic = np.array([entries[k][2] for k in order])
        self.mass = np.array([entries[k][3] for k in order])
        self.doc = np.array([entries[k][4] for k in order], np.int64)
        self.n_blocks = -(-len(order) // BLOCK)
        self.max = np.zeros((len(idf), self.n_blocks))
        self.postings = []
        for b in range(self.n_blocks):
            part = [weighted[k] for k in order[b * BLOCK:(b + 1) * BLOCK]]
            term = np.concatenate([t for t, _ in part])
            local = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            weight = np.concatenate([w for _, w in part])
            by_term = np.argsort(term, kind="stable")
            self.postings.append((term[by_term], local[by_term], weight[by_term], len(part)))
            np.maximum.at(self.max[:, b], term, weight)

    def weigh(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(terms, np.int64)
        weight = (1 + np.log(np.array(counts, float))) * self.idf[at] if len(at) else np.zeros(0)
        return at, weight / math.sqrt(float(weight @ weight)) if len(at) else weight

    def nearest(self, terms, counts, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Entries with the k highest cosines above zero (of equal ones the first), and these; ``skip`` is left out."""
        at, weight = self.weigh(terms, counts)
        if not len(at) or not self.n_blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weight @ self.max[at]
        query = np.zeros(len(self.idf))
        query[at] = weight
        found, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(found) >= k and bounds[b] < least - 1e-9):
                break
            term, local, value, n = self.postings[b]
            score = np.bincount(local, query[term] * value, minlength=n)
            hits = np.flatnonzero(score > 0)
            hits = hits[hits + b * BLOCK != skip]
            found, cosines = np.r_[found, hits + b * BLOCK], np.r_[cosines, score[hits]]
            if len(found) > k:
                top = np.lexsort((found, -np.round(cosines, 12)))[:k]
                found, cosines = found[top], cosines[top]
                least = cosines[-1]
        top = np.lexsort((found, -np.round(cosines, 12)))[:k]
        return found[top], cosines[top]

    def vote(self, terms, counts, own: tuple[float, float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the votes for label 1, the neighbours and their cosines; nan without votes.

        ``own`` takes one example's (weight if label 1, weight) out of the entry with the same vector.
        """
        found, cosines = self.nearest(terms, counts)
        toxic, mass = self.toxic[found].copy(), self.mass[found].copy()
        if own is not None:
            same = found == self.keys.get((tuple(terms), tuple(counts)), -1)
            toxic[same] -= own[0]
            mass[same] -= own[1]
        near = 1 / (NEAR + np.maximum(1 - cosines, 0))
        total = float((near * mass).sum())
        return (float((near * toxic).sum()) / total if total > 1e-9 else math.nan), found, cosines


def rising(shares: list[float], weights: list[float]) -> list[float]:
    """The closest sequence that never falls (pool adjacent violators)."""
    pools: list[list[float]] = []
    for share, weight in zip(shares, weights, strict=True):
        pools.append([share, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            s, w, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + s * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + n]
    return [s for s, _, n in pools for _ in range(int(n))]


# Scoring -----------------------------------------------------------------------------------------------------------

def _bin(vote: float) -> int:
    return BINS if math.isnan(vote) else min(int(vote * BINS), BINS - 1)


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("vote", pa.float64()), ("neighbours", pa.int32()), ("nearest", pa.int64()),
                     ("similarity", pa.float64()), ("evidence", pa.list_(pa.string()))])


def score(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, vote, neighbours, nearest, similarity, evidence.

    ``score`` is the calibrated probability of label 1 (0 to 1); ``vote`` the neighbours' share before calibration (null
    without neighbours); ``nearest`` the id of the nearest example and ``similarity`` its cosine; ``evidence`` the terms of
    the text that it was compared by. Null and empty texts have no terms. Labels (doc_id, toxic) in fold 0 are never used, nor are
    null ones. Without labels of both kinds there are no terms, and all scores are the share of label 1 (one half without any).
    Repeated rows are scored alike; other columns are ignored.
    """
    spark = docs.sparkSession
    examples, weights = sample_examples(docs, labels, max_examples)
    terms = select_terms(docs, examples)
    found = durable(vectors(docs, terms))
    n_docs = found.count()
    df = np.zeros(len(terms))
    for row in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # one row per term
        df[row["t"]] = row["n"]
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    # At most max_examples short rows.
    mine = found.join(F.broadcast(examples), "doc_id").groupBy("terms", "counts", "toxic").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).collect()
    merged: dict[tuple, list] = {}
    for r in mine:
        weight = r["n"] * weights[r["toxic"]]
        entry = merged.setdefault((tuple(r["terms"]), tuple(r["counts"])), [0.0, 0.0, r["doc_id"]])
        entry[0] += weight * r["toxic"]
        entry[1] += weight
        entry[2] = min(entry[2], r["doc_id"])
    index = spark.sparkContext.broadcast(BlockMaxIndex(idf, [(*key, *value) for key, value in sorted(merged.items()) if key[0]]))
    tallies = spark.createDataFrame(
        [(list(r["terms"]), list(r["counts"]), r["toxic"], r["n"]) for r in mine], "terms array<int>, counts array<int>, toxic int, n long")
    tally = pa.schema([("bin", pa.int32()), ("toxic", pa.float64()), ("mass", pa.float64())])

    def leave_one_out(parts):
        def rows():
            for part in parts:
                for t, c, toxic, n in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    vote, *_ = index.value.vote(t, c, (weights[toxic] * toxic, weights[toxic]))
                    yield _bin(vote), n * weights[toxic] * toxic, n * weights[toxic]

        yield from batches(tally, rows())

    sums = {r["bin"]: (r["t"], r["m"]) for r in tallies.repartition(8).mapInArrow(leave_one_out, "bin int, toxic double, mass double").groupBy(
        "bin").agg(F.sum("toxic").alias("t"), F.sum("mass").alias("m")).collect()}
    base_toxic, base_mass = (sum(x[k] for x in sums.values()) for k in (0, 1))
    base = (base_toxic + 0.5) / (base_mass + 1)
    unit = max(weights.values()) or 1.0
    # An empty bin is drawn towards its own vote.
    pull = lambda b, own: (sums.get(b, (0, 0))[0] + PRIOR * unit * own) / (sums.get(b, (0, 0))[1] + PRIOR * unit)
    shares = rising([pull(b, (b + 0.5) / BINS) for b in range(BINS)], [sums.get(b, (0, 0))[1] + PRIOR * unit for b in range(BINS)])
    shares.append(pull(BINS, base))

    def rate(parts):
        cache: dict[tuple, tuple] = {}

        def rows():
            for part in parts:
                for doc_id, t, c in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    key = (tuple(t), tuple(c))
                    if key not in cache:
                        if len(cache) > 100_000:
                            cache.clear()
                        vote, near, cosines = index.value.vote(t, c)
                        cache[key] = (
                            shares[_bin(vote)], None if math.isnan(vote) else vote, len(near), int(index.value.doc[near[0]]) if len(near) else None,
                            float(cosines[0]) if len(near) else None, [terms[k] for k in t])
                    yield doc_id, *cache[key]

        yield from batches(_SCORES, rows())

    return found.mapInArrow(
        rate, "doc_id long, score double, vote double, neighbours int, nearest long, similarity double, evidence array<string>")
