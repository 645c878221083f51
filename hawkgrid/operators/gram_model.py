"""Domain scores as joins: a table of n-gram weights, and the best window of each name.

The weights are the log ratios of a gram's smoothed share among generated and benign names, a linear model that is fitted by one
aggregation and stored as a table (gram, weight) of any size. Scoring needs no model object: windows give grams, grams meet
their weights in a join, and a window's sum goes through the logistic function. Weights are whole numbers of 10^-9, so
sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.functions.text import character_windows, name_variants, sanitise_domain
from hawkgrid.operators.models import DGA_THRESHOLD, normal_names
from hawkgrid.operators.rules import DGA_MODEL, detection, fire
from hawkgrid.session import durable

SIZES = (2, 3)
_UNIT = 10**9
#: Characters that ``sanitise_domain`` leaves (a-z, 0-9, hyphen, dot): they bound the number of different grams, whatever the input.
_ALPHABET, _BROADCAST_GRAMS = 38, 100_000
#: The row of the weight table that holds the constant term.
BIAS = ""


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """All runs of the given numbers of characters, as an array."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def fit_weights(labelled: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """gram, weight from ``domain, label`` (1.0 generated, 0.0 benign); distinct names and labels count once.

    A name longer than a window gives one row per window, as in scoring. Without names of both labels all weights are 0.
    """
    windows = labelled.select("domain", "label").distinct().select(
        F.explode(character_windows(F.array(sanitise_domain(F.lower("domain"))))).alias("text"), "label").where("text <> ''")
    # Each window also counts once under the constant term, so one pass counts windows, too. Read several times below.
    every = durable(windows.select("label", F.explode(F.concat(F.array(F.lit(BIAS)), grams("text", sizes))).alias("gram")).groupBy("gram").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("good"),
        F.count_if(F.col("label") != 1).alias("not_bad")))
    counted = every.where(F.col("gram") != BIAS)
    # One row each: totals over grams and over windows.
    totals = counted.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("kinds"))
    sizes_of = every.where(F.col("gram") == BIAS).agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"), F.coalesce(F.sum("not_bad"), F.lit(0)).alias("n_good"))
    both = (F.col("all_bad") > 0) & (F.col("all_good") > 0)
    share = lambda n, total: (F.col(n) + 1) / (F.col(total) + F.col("kinds"))
    whole = lambda x: F.round(F.when(both, F.log(x)).otherwise(0.0) * _UNIT).cast("bigint").alias("weight")
    weights = counted.crossJoin(F.broadcast(totals)).select("gram", whole(share("bad", "all_bad") / share("good", "all_good")))
    return weights.unionByName(totals.crossJoin(F.broadcast(sizes_of)).select(
        F.lit(BIAS).alias("gram"), whole((F.col("n_bad") + 1) / (F.col("n_good") + 1))))


def score_windows(queries: DataFrame, weights: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``query, score``: the highest probability over the windows of each distinct query; grams without a weight count 0.

    Equal windows of different names are scored once. Grams stay in the task of their window, where they meet a copy of the
    weights and are summed: only names and windows are shuffled, and no (window, gram) pair is kept. Names have 38 different
    characters, which bounds the copy (56,317 rows for two and three characters); longer grams are joined by shuffles.
    """
    unique = queries.select(F.trim("query").alias("query")).where(F.length("query") > 0).distinct()
    windows = normal_names(unique).select("query", F.explode(F.array_distinct(character_windows(
        name_variants(F.col("ascii"), F.col("plain"))))).alias("text")).where("text <> ''")
    known = weights.where(F.col("gram") != BIAS)
    if sum(_ALPHABET**n for n in sizes) <= _BROADCAST_GRAMS:
        known = F.broadcast(known)
    found = windows.select("text").distinct().select("text", F.explode(grams("text", sizes)).alias("gram"))
    sums = found.join(known, "gram").groupBy("text").agg(F.sum("weight").alias("sum"))
    bias = weights.where(F.col("gram") == BIAS).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("bias"))
    best = windows.join(sums, "text", "left").groupBy("query").agg(F.max(F.coalesce("sum", F.lit(0))).alias("sum"))
    return best.crossJoin(F.broadcast(bias)).select(
        "query", (1 / (1 + F.exp(-(F.col("sum") + F.col("bias")) / F.lit(float(_UNIT))))).alias("score"))


def gram_detections(dns: DataFrame, weights: DataFrame, threshold: float = DGA_THRESHOLD) -> DataFrame:
    """Detections for queries scored strictly above the threshold; only flagged names meet the events."""
    rows = dns.where(F.col("event_type") == "dns").withColumn("query", F.trim("query"))
    hits = rows.join(score_windows(rows, weights).where(F.col("score") > threshold), "query")
    evidence = F.to_json(F.struct(F.col("query").alias("domain")))
    return fire(hits, [(F.col("score") > threshold, detection(DGA_MODEL, evidence, F.col("score")))])
