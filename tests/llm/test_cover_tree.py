import math

import numpy as np
import pytest

from hawkgrid.llm import cover_tree


def brute(rows, threshold=0.93):
    """rows: (vec_id, vector or None, label)."""
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(n):
        for j in range(i):
            (_, v, x), (_, w, y) = rows[i], rows[j]
            if x is None or x != y or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, (vec, *_) in enumerate(rows):
        least[root(k)] = min(vec, least.get(root(k), vec))
    return sorted((v, links[k], least[root(k)], v == least[root(k)]) for k, (v, *_) in enumerate(rows))


def cloud(seed, n, dim=8, spread=0.25):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(max(n // 8, 1), dim))
    for k in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * spread * rng.random()
        rows.append((k * 3 + 1, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2048, 9])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = cloud(1, 260)
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    rows += [(3000, None, 1), (3001, [0.0] * 8, 1), (3002, [None, *rows[0][1][1:]], rows[0][2]), (3003, [math.nan] * 8, 1),
             (3004, [math.inf] * 8, 1), (3005, rows[0][1], None), (3006, [], 1), (3007, rows[0][1][:4], rows[0][2]),
             (3008, [2 * x for x in rows[0][1]], rows[0][2]), (3009, [-0.0, 1.0], 9), (3010, [0.0, 1.0], 9)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("threshold,spread", [(0.93, 0.3), (0.5, 1.0), (0.99, 0.02)])
def test_traversal_counts(threshold, spread):
    def side(seed):
        x = np.array([v for _, v, _ in cloud(seed, 150, 5, spread)])
        return x / np.linalg.norm(x, axis=1)[:, None]

    x, y = side(1), side(2)
    y[:20] = x[:20]
    weights = [np.random.default_rng(3).integers(1, 4, 150).astype(float) for _ in range(2)]
    trees = []
    for unit, weight in zip((x, y), weights, strict=True):
        trees.append(cover_tree.CoverTree(unit, weight))
        trees[-1].weight = weight
    link, left, right = cover_tree.dual(trees[0], x, trees[1], y, threshold)
    want = x @ y.T >= threshold
    assert left.tolist() == (want @ weights[1]).tolist() and right.tolist() == (want.T @ weights[0]).tolist()
    assert not (link & ~want).any()
    # What the links span is what all links span.
    def parts(m):
        label = np.arange(300)
        for _ in range(300):
            new = label.copy()
            a, b = np.nonzero(m)
            np.minimum.at(new, a, label[150 + b])
            np.minimum.at(new, 150 + b, label[a])
            if (new == label).all():
                return label.tolist()
            label = new
    assert parts(link) == parts(want)


def test_levels_nest():
    x = np.array([v for _, v, _ in cloud(5, 200)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x, np.ones(200))
    for above, below in zip(tree.levels, tree.levels[1:]):
        assert set(above[0]) <= set(below[0]) and (above[4] == below[2][below[4]]).all()
    assert sorted(tree.levels[-1][0]) == list(range(200))


def test_sample_table_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in docs.collect()]
    assert sorted(map(tuple, cover_tree.near_duplicates(docs).collect())) == brute(rows)
    assert cover_tree.near_duplicates(docs.where("false")).count() == 0
