"""Mixing sources to target weights by budgets that flow down a domain-language-source tree.

Every node may take at most what its leaves hold times ``max_epochs``. From the root, a node's budget is
shared among its children by weight; a child that cannot use its share leaves the rest to its siblings. As a
node's limit is the sum over its subtree, a shortage reaches the siblings of an ancestor only when
all siblings below that ancestor are full. Leaf by leaf, whole epochs come first, then the prefix of one more
epoch in a seeded order of its documents, up to the document in which the budget ends.

Only sums of tokens are shuffled. A leaf with a third of all rows is cut into ``2^12`` parts by the seeded
order; sums per part find the one part in which the budget ends, and only that part is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.session import durable

LEVELS = ["domain", "lang", "source"]
SEED, MAX_EPOCHS = 17, 2
_HEX = 3
# Weights by level and value; values not listed have weight 1.
DEFAULT_WEIGHTS = {"domain": {"web": 3, "books": 2, "code": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}
_DOMAINS = ["web", "books", "code"]


def word_count() -> Column:
    """Words of the text between ASCII white space (null: none), as the token count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def with_domain(docs: DataFrame) -> DataFrame:
    """Adds ``domain`` from the source's number: the tables have no such column."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in _DOMAINS]), number % len(_DOMAINS) + 1))


def _weight(level: str, weights: dict) -> Column:
    found = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == value, weight).otherwise(found)
    return found.cast("decimal(18,0)")


def _share(nodes: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """Adds ``quota``: the budget of the parent among its children by weight, none above its limit.

    Children in the order of limit / weight: those before the water level are full, the others share
    what is left by weight, rounded down. Rounding may leave up to one token per child unused.
    """
    full = F.struct((F.col("cap").cast("decimal(38,18)") / F.col("w")).alias("r"), *[F.col(c) for c in LEVELS if c in nodes.columns])
    w = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = w.orderBy("_full").rowsBetween(Window.unboundedPreceding, -1)
    rest = w.orderBy("_full").rowsBetween(0, Window.unboundedFollowing)
    big = "decimal(38,0)"
    return (
        nodes.withColumn("w", weight).withColumn("_full", full)
        .withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big))
        .withColumn("_weights", F.sum("w").over(rest).cast("decimal(18,0)"))
        # Full if its limit is at most its share of what those before it leave.
        .withColumn("_open", F.col("cap") * F.col("_weights") > (F.col("budget") - F.col("_used")) * F.col("w"))
        .withColumn("_left", F.min(F.when(F.col("_open"), F.struct("_full", (F.col("budget") - F.col("_used")).alias("b"), "_weights"))).over(w))
        .withColumn("quota", F.when(
            F.col("_left").isNull() | (F.col("_full") < F.col("_left")["_full"]), F.col("cap"))
            .otherwise(F.floor((F.col("_left")["b"] * F.col("w")).cast(big) / F.col("_left")["_weights"])).cast("long"))
        .drop("w", "_full", "_used", "_weights", "_open", "_left"))


def leaf_quotas(leaves: DataFrame, weights: dict, total_tokens: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, quota) from the tokens per leaf.

    ``total_tokens`` None asks for as many tokens as there are. A budget above what all leaves may give
    fills every leaf.
    """
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("long"))
    total = F.lit(total_tokens).cast("long") if total_tokens is not None else F.sum("tokens")
    budget = leaves.agg(total.alias("t"), F.sum("cap").alias("c")).select(F.least("t", "c").alias("budget"))
    known = budget
    for depth in range(len(LEVELS)):
        keys, parents = LEVELS[:depth + 1], LEVELS[:depth]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        # The root's budget is one row.
        nodes = nodes.join(known, parents) if parents else nodes.join(F.broadcast(known), F.lit(True))
        known = _share(nodes, parents, _weight(LEVELS[depth], weights)).select(*keys, F.col("quota").alias("budget"))
    return leaves.drop("cap").join(known.withColumnRenamed("budget", "quota"), LEVELS)


def mix(
    docs: DataFrame, weights: dict, total_tokens: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``docs`` that are taken, with ``copies``: how often each occurs in the mixture.

    ``docs`` has doc_id, domain, lang, source, n_tokens; null levels become the empty string's leaf, null
    or negative counts are zero, and a column ``copies`` is replaced. A document without tokens stays
    once per whole epoch of its leaf (once if the leaf has no tokens at all). Documents of a leaf are ordered by
    md5 of seed, epoch and doc_id, then doc_id; rows with equal doc_id follow each other in one place.
    The same input and seed give the same mixture. An empty table gives an empty mixture.
    """
    rest = [c for c in docs.columns if c != "copies"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_all"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS],
        F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("_n"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    small = rows.select(*LEVELS, "_n", "_id")
    leaves = durable(small.groupBy(*LEVELS).agg(F.sum("_n").alias("tokens")))
    plan = durable(leaf_quotas(leaves, weights, total_tokens, max_epochs).select(
        *LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long").alias("_whole"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).cast("long").alias("_rest")))
    # One row per leaf: the hint holds only below a counted size.
    plan = F.broadcast(plan) if plan.count() <= 10_000 else plan
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.col("_id")))
    part = F.substring("_order", 1, _HEX)
    keyed = rows.join(plan, LEVELS).withColumn("_order", order).withColumn("_part", part)
    sums = keyed.groupBy(*LEVELS, "_part", "_rest").agg(F.sum("_n").alias("_sum"))
    up = Window.partitionBy(*LEVELS).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    bounds = (
        sums.withColumn("_through", F.sum("_sum").over(up))
        .where(F.col("_through") >= F.col("_rest")).groupBy(*LEVELS)
        .agg(F.min("_part").alias("_last"), F.min_by(F.col("_through") - F.col("_sum"), "_part").alias("_before")))
    bounds = durable(bounds)
    bounds = F.broadcast(bounds) if bounds.count() <= 10_000 else bounds
    placed = keyed.join(bounds, LEVELS)
    ahead = Window.partitionBy(*LEVELS, "_part").orderBy("_order", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*LEVELS, "_part", "_order", "_id")
    clear = placed.where("_part <> _last").withColumn("copies", F.col("_whole") + (F.col("_part") < F.col("_last")).cast("long"))
    edge = (
        placed.where("_part = _last")
        .withColumn("_start", F.col("_before") + F.sum("_n").over(ahead) - F.sum("_n").over(same))
        .withColumn("copies", F.col("_whole") + (F.col("_start") < F.col("_rest")).cast("long"))
        .drop("_start"))
    return clear.unionByName(edge).where("copies > 0").select(*[F.col("_all")[c].alias(c) for c in rest], "copies")


def _sql(weights: dict, max_epochs: int, seed: int) -> str:
    """The mixture of the documents table in DuckDB's SQL."""
    def weight(level: str) -> str:
        cases = "".join(f" WHEN '{v}' THEN {w}" for v, w in weights.get(level, {}).items())
        return f"CASE {level}{cases} ELSE 1 END" if cases else "1"

    names = ", ".join(f"'{d}'" for d in _DOMAINS)
    out = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
    ([{names}])[1 + coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % {len(_DOMAINS)}] AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::HUGEINT AS tokens, (sum(n) * {max_epochs})::HUGEINT AS cap FROM d GROUP BY ALL),
q0 AS (SELECT least(sum(tokens), sum(cap))::HUGEINT AS budget FROM leaves)"""
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[:depth + 1])
        parents = ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parents}" if parents else ""
        order = f"ORDER BY cap::DOUBLE / w, {keys}"
        join = f"JOIN q{depth} USING ({parents})" if parents else "CROSS JOIN q0"
        out += f""",
n{depth} AS (SELECT {keys}, sum(cap)::HUGEINT AS cap, ({weight(level)})::HUGEINT AS w FROM leaves GROUP BY {keys}),
b{depth} AS (SELECT *, row_number() OVER ({by} {order}) AS k,
    budget - coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n{depth} {join}),
o{depth} AS (SELECT *, min(CASE WHEN cap * ws > remaining * w THEN k END) OVER ({by}) AS level_at FROM b{depth}),
f{depth} AS (SELECT *, max(CASE WHEN k = level_at THEN remaining END) OVER ({by}) AS rem,
    max(CASE WHEN k = level_at THEN ws END) OVER ({by}) AS wsum FROM o{depth}),
q{depth + 1} AS (SELECT {keys}, CASE WHEN level_at IS NULL OR k < level_at THEN cap
    ELSE ((rem * w)::HUGEINT // wsum::HUGEINT) END::HUGEINT AS budget FROM f{depth})"""
    return out + f""",
p AS (SELECT d.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM d JOIN leaves USING (domain, lang, source) JOIN q3 USING (domain, lang, source)),
s AS (SELECT *, md5(concat('{seed}:', whole::BIGINT::VARCHAR, ':', doc_id::VARCHAR)) AS key FROM p),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(n) OVER (PARTITION BY domain, lang, source, key, doc_id) AS start FROM s),
r AS (SELECT doc_id, domain, lang0 AS lang, source0 AS source, n AS n_tokens, (whole + CASE WHEN start < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT * FROM r WHERE copies > 0
"""


SQL = _sql(DEFAULT_WEIGHTS, MAX_EPOCHS, SEED)
