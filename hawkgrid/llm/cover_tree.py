"""Near-duplicate vectors by dual traversal of cover trees.

On the unit sphere a cosine of at least t is a distance of at most ``sqrt(2 - 2 t)``, and distances obey the triangle inequality.

1. Equal vectors of a label are one point with a count.
2. Points of a label are put into blocks of up to ``BLOCK`` neighbours in an order by the signs of their components. Every
   block is a cover tree: nested levels with halving radii, each node the centre of all points below it, with the
   largest distance to any of them as its covering radius.
3. Pairs of blocks of a label whose roots may reach each other are traversed together, level by level. A pair of nodes is
   dropped if its centres are further apart than the distance sought and both radii, and counted as a whole if they are
   nearer than that distance less both radii. What is left at the leaves is decided by the cosine itself, in double precision.
4. A block pair returns counts of links per point and links that span its connected parts, never all pairs.

Rows travel in packed blocks; a label with a third of all rows has more blocks, not larger tasks. In data without structure (random
directions in many dimensions) no bound can drop pairs before the leaves, and the work within a label stays quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches, components, shuffle_partitions
from hawkgrid.session import durable

THRESHOLD, BLOCK, SIGNS = 0.93, 2048, 16
_SLACK = 1e-7  # of distances, so that rounding never drops or counts a pair that the cosine would decide otherwise


# Trees -------------------------------------------------------------------------------------------------------------

class CoverTree:
    """Levels of one block: each has centres (point numbers), radii, parents in the level above and sizes."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray):
        n = len(unit)
        self.levels = []
        owner, centres = np.zeros(n, np.int64), np.array([0])
        radius = 2.0
        parents = np.zeros(1, np.int64)
        while True:
            own = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", unit, unit[centres[owner]]), 0))
            reach = np.zeros(len(centres))
            np.maximum.at(reach, owner, own)
            self.levels.append((centres, reach, parents, np.bincount(owner, weight, len(centres)), owner))
            if len(centres) == n:
                break
            radius /= 2
            if radius < 1e-3:  # the points themselves
                parents, centres, owner = owner, np.arange(n), np.arange(n)
                continue
            centres, parents, owner = self._split(unit, owner, centres, radius)

    @staticmethod
    def _split(unit, owner, centres, radius):
        """Centres of the next level: every point within ``radius`` of one below its own node; old centres stay."""
        nearest = np.full(len(unit), np.inf)
        new_owner = np.zeros(len(unit), np.int64)
        found, parents = [], []
        for node in range(len(centres)):
            members = np.flatnonzero(owner == node)
            left = members[members != centres[node]]
            pick = centres[node]
            while True:
                at = len(found)
                found.append(pick)
                parents.append(node)
                distance = np.sqrt(np.maximum(2 - 2 * unit[members] @ unit[pick], 0))
                distance[members == pick] = -1.0
                closer = distance < nearest[members]
                nearest[members[closer]] = distance[closer]
                new_owner[members[closer]] = at
                left = left[nearest[left] > radius]
                if not len(left):
                    break
                pick = left[0]
        return np.array(found), np.array(parents), new_owner


def dual(one: CoverTree, x: np.ndarray, two: CoverTree, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks: (matrix of the links at the leaves, counts for each side from whole node pairs and leaves).

    Both trees go down together; the shorter one waits at its leaves.
    """
    cosine = x @ y.T
    distance = np.sqrt(np.maximum(2 - 2 * cosine, 0))
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    counts = [np.zeros(len(x)), np.zeros(len(y))]
    link = np.zeros(cosine.shape, bool)
    active = np.ones((1, 1), bool)
    for level in range(max(len(one.levels), len(two.levels))):
        (c, r, p, n, own), (d, s, q, m, other) = (t.levels[min(level, len(t.levels) - 1)] for t in (one, two))
        if level:
            up = p if level < len(one.levels) else np.arange(len(c))
            across = q if level < len(two.levels) else np.arange(len(d))
            active = active[np.ix_(up, across)]
        gap = distance[np.ix_(c, d)]
        both = r[:, None] + s[None, :]
        active &= gap <= limit + both + _SLACK
        if not active.any():
            break
        whole = active & (gap + both <= limit - _SLACK)
        if whole.any():
            counts[0] += (whole @ m)[own]
            counts[1] += (whole.T @ n)[other]
            # Every point of one node links to every point of the other: its centre stands for them.
            a, b = np.nonzero(whole)
            centre = np.zeros(len(d), bool)
            for i in np.unique(a):
                centre[:] = False
                centre[b[a == i]] = True
                link[np.ix_(own == i, d[centre])] = True
                link[c[i]] |= centre[other]
            active &= ~whole
    else:
        # Leaves: single points, in the order of the last levels.
        c, d = one.levels[-1][0], two.levels[-1][0]
        near = np.zeros(cosine.shape, bool)
        near[np.ix_(c, d)] = active
        near &= cosine >= threshold
        counts[0] += near @ two.weight
        counts[1] += near.T @ one.weight
        link |= near
    return link, counts[0], counts[1]


def _tree(raw: tuple) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    ids, weight, values = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.float64)
    unit = values.reshape(len(ids), -1)
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    tree = CoverTree(unit, weight)
    tree.weight = weight.astype(float)
    return ids, unit, tree


# Spark -------------------------------------------------------------------------------------------------------------

def _usable(vector: Column) -> Column:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda v: v != 0)


_BLOCKS = "label string, dim int, block long, centre array<double>, reach double, ids binary, weights binary, vectors binary"


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK points of one label and dimension, from sorted rows."""
    held: list[tuple] = []
    number = TaskContext.get().partitionId() << 32

    def block():
        vectors = np.array([v for *_, v in held], np.float64)
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        centre = unit[0]
        reach = float(np.sqrt(np.maximum(2 - 2 * unit @ centre, 0)).max())
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0][0]], pa.string()), pa.array([held[0][1]], pa.int32()), pa.array([number], pa.int64()),
             pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([reach]),
             pa.array([np.array([h[2] for h in held], np.int64).tobytes()], pa.binary()),
             pa.array([np.array([h[3] for h in held], np.int64).tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())],
            names=["label", "dim", "block", "centre", "reach", "ids", "weights", "vectors"])

    for part in parts:
        for row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
            if held and (row[:2] != held[0][:2] or len(held) >= BLOCK):
                yield block()
                held, number = [], number + 1
            held.append(row)
    if held:
        yield block()


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _traverse(threshold: float):
    from hawkgrid.llm.ngram_join import _spanning

    def run(parts):
        def rows():
            for part in parts:
                for k in range(part.num_rows):
                    v = [part.column(c)[k].as_py() for c in range(7)]
                    ids, x, one = _tree(tuple(v[1:4]))
                    if v[0]:
                        others, y, two = ids, x, one
                    else:
                        others, y, two = _tree(tuple(v[4:7]))
                    link, left, right = dual(one, x, two, y, threshold)
                    if v[0]:  # a block with itself: a point's own copies link too, it itself does not
                        np.fill_diagonal(link, False)
                        left = left - 1
                    yield from ((int(i), None, int(n)) for i, n in zip(ids, left, strict=True) if n)
                    if not v[0]:
                        yield from ((int(i), None, int(n)) for i, n in zip(others, right, strict=True) if n)
                    yield from ((a, b, None) for a, b in _spanning(link, ids, others))

        yield from batches(_FOUND, rows())

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label).

    Vectors of the same label (and length) link when their cosine is at least ``threshold`` (above zero). Without a label, and null, empty
    or zero vectors or such with null or non-finite components, link with nothing. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, ``kept`` tells whether it is the row's own. Rows with the same
    vec_id count as rows of their own; one without an id counts as a link, but ``kept`` is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        # -0.0 and 0.0 are one value.
        F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("v"))
    good = rows.where(F.col("label").isNotNull() & _usable(F.col("v")))
    key = ["label", "v"]
    points = durable(
        good.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("point", F.xxhash64("label", "v")))
    signs = F.concat(*[F.when(F.coalesce(F.get("v", F.lit(k)), F.lit(0.0)) > 0, "1").otherwise("0") for k in range(SIGNS)])
    ordered = points.select("label", F.size("v").alias("dim"), "point", "n", "v", signs.alias("_s"))
    order = ["label", "dim", "_s", "point"]
    packed = durable(
        ordered.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        .select("label", "dim", "point", "n", "v").mapInArrow(_blocks, _BLOCKS))
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    roots = packed.select("label", "dim", "block", F.col("centre").alias("c"), F.col("reach").alias("r"))
    far = roots.select("label", "dim", *[F.col(x).alias(f"{x}2") for x in ("block", "c", "r")])
    dot = F.aggregate(F.zip_with("c", "c2", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    meet = roots.join(far, ["label", "dim"]).where("block <= block2").where(
        F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) <= limit + F.col("r") + F.col("r2") + _SLACK).select("block", "block2")
    body = ["ids", "weights", "vectors"]
    pairs = (
        meet.join(packed.select("block", *body), "block")
        .join(packed.select(F.col("block").alias("block2"), *[F.col(b).alias(f"{b}2") for b in body]), "block2")
        .select((F.col("block") == F.col("block2")).alias("same"), *body, *[f"{b}2" for b in body]))
    found = durable(pairs.repartition(shuffle_partitions(spark)).mapInArrow(_traverse(threshold), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("links"))
    # Rows with the same vec_id do not connect their vectors: points are the nodes.
    parts = components(found.where("b is not null"), "a", "b")
    joined = points.select("point", "label", "v", "first", "n").join(counts, "point", "left").join(
        parts, F.col("point") == parts["node"], "left").withColumn("part", F.coalesce("component", "point"))
    least = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    known = joined.join(least, "part").select(
        *key, F.coalesce("links", F.lit(0)).alias("n_links"), "component_id")
    linked = good.join(known, key, "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(F.col("label").isNotNull() & _usable(F.col("v")), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: The same rows by comparing all candidates of a label, or of an n-gram, with each other.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.reached = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT vec_id, min(reached) AS component_id FROM c GROUP BY vec_id) AS m USING (vec_id)
"""
