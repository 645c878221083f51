"""Detector quality against labelled traffic, threshold sweeps and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.operators.rules import BEACON, BYTE_VOLUME, CONN_RATE, FLOW_MODEL, conn_conditions

# Allowed change in percentage points, and the risk from which an incident counts.
MAX_POINTS, MAX_FAMILY_POINTS = 5.0, 10.0
INCIDENT_RISK = 50.0


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, FPR and F1 from ``tp, fp, tn, fn``; 0 when undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def _cells(hit: Column, label: Column) -> Column:
    return F.struct(
        F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"),
        F.count_if(~hit & ~label).alias("tn"), F.count_if(~hit & label).alias("fn"))


def confusion(rows: DataFrame, label: str, hits: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """One confusion matrix per named hit column, from a single pass over the rows.

    All cells are counters of one aggregation; the few result rows are unfolded after it.
    """
    truth = F.col(label)
    cells = [F.struct(F.lit(n).alias("detector"), _cells(F.coalesce(h, F.lit(False)), truth).alias("c"))
             for n, h in hits.items()]
    wide = rows.groupBy(*keys).agg(F.array(*cells).alias("_all"))
    long = wide.select(*keys, F.explode("_all").alias("_x")).select(*keys, "_x.detector", "_x.c.*")
    return with_metrics(long)


def threshold_sweep(rows: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion at each candidate threshold (score strictly above), still one pass."""
    hits = {repr(float(t)): F.col(score) > t for t in sorted(set(thresholds))}
    return confusion(rows, label, hits).withColumn("threshold", F.col("detector").cast("double")).drop("detector")


def family_recall(rows: DataFrame, family: str, label: str, classifier: Column, rule: Column) -> DataFrame:
    """Per family of positives: share caught by the classifier, the rule, and either."""
    c, r = F.coalesce(classifier, F.lit(False)), F.coalesce(rule, F.lit(False))
    counted = rows.where(F.col(label)).groupBy(F.col(family).alias("family")).agg(
        F.count("*").alias("total"), F.count_if(c).alias("classifier_caught"),
        F.count_if(r).alias("rule_caught"), F.count_if(c | r).alias("combined_caught"))
    return counted.withColumns({
        f"{n}_recall": _ratio(F.col(f"{n}_caught"), F.col("total")) for n in ("classifier", "rule", "combined")})


def scenario_recall(rows: DataFrame, scenario: str, label: str, hits: dict[str, Column]) -> DataFrame:
    """Per scenario: positives and how many each detector caught, one column per detector."""
    return rows.where(F.col(label)).groupBy(F.col(scenario).alias("scenario")).agg(
        F.count("*").alias("total"), *[F.count_if(F.coalesce(h, F.lit(False))).alias(n) for n, h in hits.items()])


def regressions(
    current: DataFrame, baseline: DataFrame, key: str, max_points: float = MAX_POINTS,
    higher_is_better: tuple[str, ...] = ("precision", "recall"), lower_is_better: tuple[str, ...] = ("fpr",),
) -> DataFrame:
    """Metrics that got worse than the baseline by more than the allowed points.

    An empty result passes the gate; keys without a baseline are new and pass.
    """
    names = [*higher_is_better, *lower_is_better]
    base = baseline.select(key, *[F.col(m).alias(f"_b_{m}") for m in names])
    changes = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_b_{m}").alias("baseline"), F.col(m).alias("value"),
                 ((F.col(m) - F.col(f"_b_{m}")) * 100).alias("delta_points"), F.lit(m in higher_is_better).alias("_up"))
        for m in names])
    worse = F.when(F.col("_up"), F.col("delta_points") < -max_points).otherwise(F.col("delta_points") > max_points)
    return (
        current.join(base, key).select(key, F.explode(changes).alias("_x")).select(key, "_x.*")
        .where(worse).drop("_up")
    )


def family_regressions(current: DataFrame, baseline: DataFrame, max_points: float = MAX_FAMILY_POINTS) -> DataFrame:
    """Families whose recall (classifier, rule or either) fell by more than the points allowed for a family."""
    return regressions(current, baseline, "family", max_points, ("classifier_recall", "rule_recall", "combined_recall"), ())


def detector_hits(flow_threshold: float | None = None) -> dict[str, tuple[Column, Column]]:
    """Condition and confidence of every detector on a connection with its window flags (and ``reconstruction_mse``).

    Taken from the rules themselves; rules that share an id are one detector.
    """
    holds = {**conn_conditions(), CONN_RATE: F.col("is_flood"), BEACON: F.col("is_beacon"), BYTE_VOLUME: F.col("is_exfil")}
    out: dict[str, tuple[Column, Column]] = {}
    for rule, condition in holds.items():
        before = out.get(rule.rule_id)
        grade = F.lit(rule.confidence)
        out[rule.rule_id] = (condition, grade) if before is None else (
            before[0] | condition, F.when(before[0], before[1]).otherwise(grade))
    if flow_threshold is not None:
        mse = F.col("reconstruction_mse")
        out[FLOW_MODEL.rule_id] = (mse > flow_threshold, F.least(F.lit(0.99), mse / (2 * flow_threshold)))
    return out


def composite_risk(hits: dict[str, tuple[Column, Column | float]]) -> Column:
    """Row-wise risk of the detectors that fire on one connection.

    ``hits`` maps a detector to its condition and confidence. Each detector appears once
    per row, so pooling needs no grouping at all.
    """
    total, any_hit = F.lit(0.0), F.lit(False)
    for condition, confidence in hits.values():
        c = F.lit(confidence) if isinstance(confidence, float) else confidence
        c = F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99))
        on = F.coalesce(condition, F.lit(False))
        total = total + F.when(on, F.log(c / (1 - c))).otherwise(F.lit(0.0))
        any_hit = any_hit | on
    return F.when(any_hit, F.round(100.0 / (1.0 + F.exp(-total)), 2)).otherwise(F.lit(0.0))


def without_leakage(labelled: DataFrame, holdout: DataFrame, held_out_scenario: str) -> DataFrame:
    """Evaluation rows no model was trained on.

    All positives, the negatives of the held-out scenario, and the separate holdout set.
    """
    columns = ["label", "orig_bytes", "resp_bytes", "duration", "tot_pkts"]
    usable = labelled.where(
        (F.col("label") == "botnet") | ((F.col("label") == "normal") & (F.col("scenario") == held_out_scenario)))
    rest = holdout.withColumn("label", F.lit("normal"))
    return usable.select(*columns).unionByName(rest.select(*columns))


def overlap(left: DataFrame, right: DataFrame, column: str = "domain") -> DataFrame:
    """Values present in both sets."""
    return left.select(column).intersect(right.select(column))
