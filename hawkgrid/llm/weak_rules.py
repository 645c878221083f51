"""Text quality by weak supervision: rules vote or abstain, and their accuracies are estimated from the votes.

Each rule looks at one feature of a text and votes good (1), bad (-1) or abstains (0). No rule rejects a text by
itself: expectation-maximisation estimates how often each rule is right, without labels, and a text's quality
is the posterior probability of being good given all its votes.

All features come from functions over the row's own arrays, so texts are read once and never shuffled. Texts with the same
votes have the same posterior: they are counted per combination of votes (at most 3^9), and the iterations run over
those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.functions.bind import let
from hawkgrid.session import durable

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
ITERATIONS, KEEP_FROM = 15, 0.1
# First guesses: most texts are good, a rule seldom blames a good one, and finds only some kinds of bad ones.
FIRST_GOOD, FIRST_ON_GOOD, FIRST_ON_BAD = 0.8, 0.995, 0.15


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Per rule: when it votes good, and when it votes bad. Between the two it abstains."""
    symbols, dup, repeat = _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words")
    mean, upper, ends = _ratio("word_chars", "n_words"), _ratio("n_upper", "n_letters"), _ratio("n_marks", "n_words")
    distinct, letters = _ratio("n_distinct", "n_words"), _ratio("n_letters", "word_chars")
    words = F.col("n_words")
    return {
        "symbols": (symbols <= 0.02, symbols > 0.1),
        "duplicate_lines": (dup <= 0.05, dup > 0.3),
        "repeated_words": (repeat <= 0.05, repeat > 0.2),
        "word_length": (mean.between(2.5, 12), (mean < 2) | (mean > 15)),
        "capitals": (upper <= 0.2, upper > 0.5),
        "shouting": (ends <= 0.02, ends > 0.2),
        "vocabulary": ((words >= 50) & (distinct >= 0.3), (words >= 50) & (distinct < 0.1)),
        "letters": (letters >= 0.94, (words >= 30) & (letters < 0.9)),
        "length": (words >= 30, words < 5),
    }


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur at least twice, from the hash of the window at each position.

    Texts without such windows are told by the count of distinct hashes; only the others are sorted.
    """
    def again(p: Column, i: Column) -> Column:
        own = F.get(p, i)["h"]
        return F.coalesce(own == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(p, i + 1)["h"], F.lit(False))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        # ``let``: sorted once, not once for each element.
        starts = let(pairs, lambda p: F.sort_array(F.filter(
            F.transform(p, lambda x, i: F.when(again(p, i), x["k"])), lambda k: k.isNotNull())))
        # Windows in order: each adds the words that the one before it did not cover.
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
            lambda acc, k: F.struct(
                (acc["words"] + F.least(F.lit(WINDOW), k - acc["last"])).alias("words"), k.alias("last")), lambda acc: acc["words"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    A null text counts as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("_t"))
    cut = base.select(
        "doc_id", "_t", F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("_l"))
    last = F.size("_w") - WINDOW
    windows = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda k: F.xxhash64(*[F.get("_w", k + i) for i in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    # Lengths instead of lists of matches.
    count = lambda pattern: (F.length("_t") - F.length(F.regexp_replace("_t", f"{pattern}+", ""))).cast("long")
    return cut.withColumn("_h", windows).select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_h")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        count("\\p{L}").alias("n_letters"),
        count("\\p{Lu}").alias("n_upper"),
        count("[!?]").alias("n_marks"))


def votes(featured: DataFrame) -> DataFrame:
    """Adds ``votes``: 1, -1 or 0 of each rule, in the order of ``rules``. A text without words gets no votes."""
    def vote(good: Column, bad: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    return featured.withColumn("votes", F.array(*[vote(*rule) for rule in rules().values()]))


def estimate(counted: DataFrame, iterations: int = ITERATIONS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and the accuracy of each rule on good and on bad texts, from (votes, n).

    ``counted`` has one row per combination of votes; every iteration is one aggregation over them. Estimates are smoothed by
    one right and one wrong vote. A vote never speaks for the other side: at worst it says nothing.
    """
    n_rules = len(rules())
    good, accuracies = FIRST_GOOD, [(FIRST_ON_GOOD, FIRST_ON_BAD)] * n_rules
    for _ in range(iterations):
        judged = counted.select("n", posterior(good, accuracies).alias("p"), F.posexplode("votes").alias("rule", "vote"))
        good_n, bad_n = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        found = {r["rule"]: r for r in judged.groupBy("rule").agg(  # one row per rule
            F.sum("n").alias("n"), F.sum(good_n).alias("good"),
            F.sum(F.when(F.col("vote") == 1, good_n)).alias("good_right"), F.sum(F.when(F.col("vote") != 0, good_n)).alias("good_voted"),
            F.sum(F.when(F.col("vote") == -1, bad_n)).alias("bad_right"), F.sum(F.when(F.col("vote") != 0, bad_n)).alias("bad_voted")).collect()}
        if not found:
            break
        good = (found[0]["good"] + 1) / (found[0]["n"] + 2)
        accuracies = []
        for k in range(n_rules):
            on_good, on_bad = (((found[k][f"{c}_right"] or 0) + 1) / ((found[k][f"{c}_voted"] or 0) + 2) for c in ("good", "bad"))
            accuracies.append((max(on_good, 1 - on_bad), on_bad))
    return good, accuracies


def posterior(good: float, accuracies: list[tuple[float, float]]) -> Column:
    """Probability of a good text given ``votes``, by log-odds of independent rules.

    The odds of each rule's votes are array constants, so the compiled code is the same for every estimate.
    """
    odds = F.array(*[F.array(F.lit(math.log((1 - g) / b)), F.lit(0.0), F.lit(math.log(g / (1 - b)))) for g, b in accuracies])
    each = F.zip_with("votes", odds, lambda vote, o: F.get(o, vote.cast("int") + 1))
    total = F.aggregate(each, F.array(F.lit(math.log(good / (1 - good))))[0], lambda a, x: a + x)
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, keep_from: float = KEEP_FROM, iterations: int = ITERATIONS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): features, votes, quality (posterior), base_failed and kept.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated windows; such texts are never kept.
    Other texts are kept if their quality is at least ``keep_from``. A null or empty text has no words, so it
    fails. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    featured = durable(votes(features(docs)).withColumn("base_failed", failed))
    # Texts that fail anyway are another kind of bad and would stand for all of it.
    counted = durable(featured.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n")))
    good, accuracies = estimate(counted, iterations)
    return (
        featured.withColumn("quality", posterior(good, accuracies))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from)))
