import math
import random
import zlib

import numpy as np
import pytest

from hawkgrid.llm import queries, toxicity


def test_index_gives_the_exact_neighbours():
    rng = random.Random(4)
    n_terms = 40
    entries = {}
    for k in range(700):
        terms = tuple(sorted(rng.sample(range(n_terms), rng.randint(1, 5))))
        entries[terms, tuple(rng.randint(1, 3) for _ in terms)] = (float(rng.random() < 0.5), 1.0, k)
    idf = np.array([1 + rng.random() * 3 for _ in range(n_terms)])
    index = toxicity.BlockMaxIndex(idf, [(*key, *value) for key, value in entries.items()])
    dense = np.zeros((len(entries), n_terms))
    for (t, c), at in index.keys.items():
        dense[at, list(t)] = [(1 + math.log(n)) * idf[k] for k, n in zip(t, c, strict=True)]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for t, c in [*list(entries)[:60], ((3,), (1,)), ((1, 2, 3, 4, 5, 6), (1,) * 6)]:
        q = np.zeros(n_terms)
        q[list(t)] = [(1 + math.log(n)) * idf[k] for k, n in zip(t, c, strict=True)]
        cosines = dense @ (q / np.linalg.norm(q))
        want = sorted(range(len(cosines)), key=lambda k: (-round(cosines[k], 12), k))[:25]
        found, got = index.nearest(t, c)
        assert found.tolist() == [k for k in want if cosines[k] > 1e-12] and got == pytest.approx(cosines[found])


def test_calibration_never_falls():
    assert toxicity.rising([0.1, 0.5, 0.3, 0.2, 0.9], [1, 1, 1, 2, 1]) == pytest.approx([0.1, 0.3, 0.3, 0.3, 0.9])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert len(found) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    toxic = [found[d].score for d, y in labels if y == 1]
    clean = [found[d].score for d, y in labels if y == 0]
    # About 400 examples of label 1, a few of which hold none of the words that the others share.
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.85 and sum(s >= 0.5 for s in clean) / len(clean) < 0.02


def test_held_out_labels_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", None), (1, "bad " * 30_000, "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs, labels.where("false")).first().score == 0.5
    assert toxicity.score(docs.where("false"), labels).count() == 0
