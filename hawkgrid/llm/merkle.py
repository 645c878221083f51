"""A Merkle manifest of a dataset: subtree per source, proofs and their check, by nested intervals.

Every node carries the interval of leaf ranks that it covers. Ranks come from one range shuffle of thin rows
(no text moves), so a source of any size spans many tasks: a row's rank is its place in its chunk plus the
rows of its source in the chunks before. Each level groups ``arity`` neighbouring intervals, so no group is
larger, however large the source. Then proofs go down from the roots: a node finds its parent by a join on
(tree, level bucket) with containment of intervals, where a parent meets at most ``arity`` nodes, and its
siblings are the parent's other intervals, those before and those behind its own.

All main path work is DataFrame expressions. Level tables are written to the shared folder; each holds one
``arity``-th of the level below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.llm.common import shuffle_partitions
from hawkgrid.session import durable

ARITY = 16
TAMPER_EVERY = 5
#: Largest height of a tree: 16 ** 15 leaves and more than any table has.
_MAX_HEIGHT = 15
_POSITION = (1 << 33) - 1
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def tampered(doc_id: Column, every: int = TAMPER_EVERY) -> Column:
    """Whether the tampering trial touches the row: ``every`` divides the CRC-32 of the decimal number. Null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def _ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``rank`` (from 0) and ``n`` of each row within its ``tree``, and the largest ``n``.

    Equal rows are told apart by where they stand in the input, so a block of them spans several ranges, too.
    """
    placed = durable(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(rows.sparkSession), "tree", *order, "_row")
        .sortWithinPartitions("tree", *order, "_row").drop("_row")
        .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({
        "_chunk": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit(_POSITION))}).drop("_at")
    # At most chunks + trees rows.
    whole = Window.partitionBy("tree")
    carry = durable(
        placed.groupBy("tree", "_chunk").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .select("tree", "_chunk", F.sum("_n").over(whole).alias("n"), (
            F.sum("_n").over(whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first")
        ).alias("_shift")))
    largest = carry.agg(F.max("n")).first()[0] or 0
    out = placed.join(carry, ["tree", "_chunk"]).withColumn("rank", F.col("_pos") + F.col("_shift"))
    return out.drop("_chunk", "_pos", "_shift"), largest


def _height(n: Column, arity: int) -> Column:
    """The least height of a tree with ``n`` leaves."""
    return sum((F.when(n > arity**k, 1).otherwise(0) for k in range(_MAX_HEIGHT)), F.lit(0))


@dataclass
class Forest:
    """Trees by level: ``leaves`` (tree, rank, height, digest, ...) and inner ``levels`` 1, 2, ...

    Rows of a level: tree, height, lo, hi, digest, kids (lo, hi, digest and, at level 1, ``data``), in order.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    arity: int

    def tops(self) -> DataFrame:
        """tree, digest of each tree's root."""
        parts = [self.leaves.where("height = 0").select("tree", "digest")]
        parts += [level.where(F.col("height") == k).select("tree", "digest") for k, level in enumerate(self.levels, 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def grow(rows: DataFrame, order: list[Column], data: Column, arity: int = ARITY) -> Forest:
    """Trees over ``rows`` (tree, digest, ...) in ``order``; ``data`` is kept beside each leaf."""
    ranked, largest = _ranked(rows, order)
    leaves = ranked.select(
        "tree", "rank", "digest", data.alias("data"), _height(F.col("n"), arity).cast("int").alias("height"))
    below = leaves.select("tree", "height", F.struct(
        F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", "data").alias("kid"))
    levels: list[DataFrame] = []
    while arity ** len(levels) < largest:
        k = len(levels) + 1
        grouped = (
            below.where(F.col("height") >= k)
            .groupBy("tree", F.expr(f"kid.lo div {arity**k}L").alias("bucket"))
            .agg(F.first("height").alias("height"), F.sort_array(F.collect_list("kid")).alias("kids")))
        levels.append(durable(grouped.select(
            "tree", "height", F.col("kids")[0]["lo"].alias("lo"), F.expr("kids[size(kids) - 1].hi").alias("hi"),
            digest(F.array_join(F.transform("kids", lambda c: c["digest"]), "")).alias("digest"), "kids")))
        below = levels[-1].select("tree", "height", F.struct("lo", "hi", "digest").alias("kid"))
    return Forest(leaves, levels, arity)


def _beside(kids: str, lo: str, hi: str) -> Column:
    """The parent's interval without (lo, hi): digests of the intervals before it and behind it."""
    def joined(keep):
        return F.array_join(F.transform(F.filter(kids, keep), lambda c: c["digest"]), "")

    return F.struct(
        joined(lambda c: c["hi"] < F.col(lo)).alias("left"), joined(lambda c: c["lo"] > F.col(hi)).alias("right"))


def leaf_paths(forest: Forest, base: DataFrame | None = None) -> DataFrame:
    """tree, data, digest, above, path of each leaf: the siblings on its way up, lowest level first.

    ``base`` has, for each tree, what continues beyond its root: ``path`` and any struct ``above``.
    """
    if base is None:
        base = forest.tops().select("tree", F.array().cast(_PATH).alias("path"), F.struct(F.lit(0).alias("_")).alias("above"))
    carried: DataFrame | None = None
    for k in range(len(forest.levels), 0, -1):
        level = forest.levels[k - 1]
        rows = level.where(F.col("height") == k).join(base, "tree").select("tree", "lo", "hi", "kids", "path", "above")
        if carried is not None:
            width = forest.arity ** (k + 1)
            inner = level.where(F.col("height") > k).withColumn("bucket", F.expr(f"lo div {width}L"))
            parents = carried.select(
                "tree", F.expr(f"lo div {width}L").alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.transform("kids", lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest"))).alias("p_kids"),
                "path", "above")
            found = inner.join(parents, ["tree", "bucket"]).where("p_lo <= lo and hi <= p_hi")
            rows = rows.unionByName(found.select(
                "tree", "lo", "hi", "kids", F.concat(F.array(_beside("p_kids", "lo", "hi")), "path").alias("path"), "above"))
        carried = rows
    single = forest.leaves.where("height = 0").join(base, "tree").select("tree", "data", "digest", "above", "path")
    if carried is None:
        return single
    # Level 1 holds its leaves with their data, so leaves need no join at all.
    each = carried.select("tree", "kids", "path", "above", F.explode("kids").alias("kid")).select(
        "tree", "kids", "path", "above", "kid.data", "kid.digest", "kid.lo", "kid.hi")
    return single.unionByName(each.select(
        "tree", "data", "digest", "above", F.concat(F.array(_beside("kids", "lo", "hi")), "path").alias("path")))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings on its way give."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, arity: int = ARITY, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves hash doc_id, source, lang, n_chars and text, each field null-marked or length-prefixed; they stand in the
    order of doc_id within their source (null ids last, equal ids by digest), sources in byte order, null first.
    ``folded_root`` starts from the tampered leaf where ``tampered`` says so. Repeated rows are leaves of their own;
    other columns are ignored; an empty table gives no rows. A missing ``n_chars`` or other field is an error.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    head = F.concat(field(doc_id), *[field(F.col(c)) for c in ("source", "lang", "n_chars")])
    leaf, forged = digest(head, field(text)), digest(head, field(lower_ascii(text)))
    rows = docs.select(
        doc_id.alias("doc_id"),
        # Byte order with null first; joins need a key that is never null.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        leaf.alias("digest"), F.when(tampered(doc_id, tamper_every), forged).alias("forged"))
    sources = grow(rows, [F.col("doc_id").asc_nulls_last(), F.col("digest")], F.struct("doc_id", "forged"), arity)
    subroots = sources.tops().select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source_key"))
    upper = grow(subroots, [F.col("source_key")], F.struct("source_key"), arity)
    root = upper.tops().select("tree", F.col("digest").alias("root"))
    base = durable(
        leaf_paths(upper).join(root, "tree")
        .select(F.col("data.source_key").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), "root").alias("above")))
    found = leaf_paths(sources, base).select(
        "data.doc_id", F.col("digest").alias("leaf"), "above.subroot", "above.root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("data.forged", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))

#: The same manifest level by level in recursive queries.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_FIELDS} AS head, text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
      4294967295) AS crc
  FROM documents),
h AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx FROM h),
n AS (SELECT tree, 0 AS level, idx, leaf AS digest FROM r
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM n) WHERE size > 1 GROUP BY tree, level, idx // 16),
t AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx
  FROM (SELECT tree, arg_max(digest, level) AS digest, max(level) AS top FROM n GROUP BY tree)),
u AS (SELECT 0 AS level, idx, digest FROM t
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS size FROM u) WHERE size > 1 GROUP BY level, idx // 16),
b AS (SELECT *, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS top FROM n)
  WHERE level < top WINDOW w AS (PARTITION BY tree, level, idx // 16 ORDER BY idx)),
v AS (SELECT *, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM (SELECT *, max(level) OVER () AS top FROM u)
  WHERE level < top WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)),
w1 AS (SELECT doc_id, tree, leaf, idx AS rank, 0 AS level, idx, coalesce(forged, leaf) AS acc, '' AS proof FROM r
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.rank, w.level + 1, w.idx // 16, sha256(b.lefts || w.acc || b.rights), w.proof || b.lefts || b.rights
  FROM w1 AS w JOIN b ON w.tree = b.tree AND w.level = b.level AND w.idx = b.idx),
w2 AS (SELECT w.doc_id, w.tree, w.leaf, w.rank, 0 AS level, t.idx, w.acc, w.proof
  FROM (SELECT *, max(level) OVER (PARTITION BY tree, rank) AS last FROM w1) AS w JOIN t ON w.tree = t.tree WHERE w.level = w.last
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.rank, w.level + 1, w.idx // 16, sha256(v.lefts || w.acc || v.rights), w.proof || v.lefts || v.rights
  FROM w2 AS w JOIN v ON w.level = v.level AND w.idx = v.idx),
e AS (SELECT * FROM (SELECT *, max(level) OVER () AS last FROM w2) WHERE level = last),
root AS (SELECT arg_max(digest, level) AS root FROM u)
SELECT e.doc_id, e.leaf, t.digest AS subroot, root.root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = root.root AS verified
FROM e JOIN t ON e.tree = t.tree CROSS JOIN root
"""
