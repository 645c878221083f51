"""Domain classifier and flow anomaly model on Spark ML.

Inputs, windows, thresholds and confidences are fixed by the detection contract; the models are linear
ones: hashed character n-grams plus lexical shape for names, a three-component
projection for flows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkgrid.functions.flow import flow_vector
from hawkgrid.functions.text import character_windows, lexical_vector, name_variants, sanitise_domain, strip_dots
from hawkgrid.operators.rules import DGA_MODEL, FLOW_MODEL, detection, fire
from hawkgrid.session import durable

try:
    import idna
except ImportError:  # names are then scored in their normalised form
    idna = None

# Decision thresholds.
DGA_THRESHOLD = 0.97
FLOW_THRESHOLD = 0.0008
NON_ASCII = r"[^\x00-\x7F]"
# Fixed values of training-set assembly.
BENIGN_PREFIXES = ["www", "api", "mail", "dev", "staging"]
MALICIOUS_TLDS = [
    ".com", ".net", ".org", ".biz", ".info", ".sbs", ".cc", ".cyou", ".lat", ".su", ".top", ".xyz", ".ru", ".tk",
]
SERVICE_LABELS = [
    "_ldap._tcp.Default-First-Site-Name._sites", "_ldap._tcp.dc._msdcs", "_kerberos._tcp.dc._msdcs", "wpad", "isatap",
]
HYPHEN_SHARE, BARE_SHARE = 0.40, 0.35


def _international():
    """Pandas UDF for names beyond ASCII: NFKC form and its punycode spelling.

    Built on call, so that it travels to the workers by value.
    """
    forms = T.StructType([T.StructField("plain", T.StringType()), T.StructField("ascii", T.StringType())])

    def spell(name):
        plain = unicodedata.normalize("NFKC", name).rstrip(".").lower()
        try:
            return plain, idna.encode(plain, uts46=True).decode("ascii").lower() if idna else plain
        except ValueError:  # idna errors and UnicodeError are both ValueErrors
            return plain, plain

    @F.pandas_udf(forms)
    def encode(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spell(n) for n in names], columns=["plain", "ascii"])

    return encode


def normal_names(queries: DataFrame) -> DataFrame:
    """Add ``plain`` and ``ascii`` forms; only names beyond ASCII visit a Python worker."""
    query = F.col("query")
    simple = F.lower(strip_dots(query))
    ascii_only = queries.where(~query.rlike(NON_ASCII)).withColumns({"plain": simple, "ascii": simple})
    other = queries.where(query.rlike(NON_ASCII)).withColumn("_n", _international()(query))
    return ascii_only.unionByName(other.select(*queries.columns, "_n.plain", "_n.ascii"))


def _chars(names: DataFrame) -> DataFrame:
    return names.withColumn("chars", F.filter(F.split("text", ""), lambda c: c != ""))


def _features(names: DataFrame) -> DataFrame:
    """Inputs of the classifier: characters of ``text`` and the lexical vector."""
    return _chars(names).withColumn("lexical", array_to_vector(lexical_vector(F.col("text"))))


def fit_domain_model(labelled: DataFrame, hash_features: int = 4096, seed: int = 7) -> tuple[PipelineModel, float]:
    """Train on ``domain, label`` (1.0 generated, 0.0 benign); returns model and held-out accuracy.

    A name longer than a window gives one row per window, as in scoring.
    """
    whole = F.array(sanitise_domain(F.lower("domain")))
    data = labelled.select(F.explode(character_windows(whole)).alias("text"), "label").where("text <> ''")
    # Fitting reads its rows twice: names are assembled and shapes worked out once, and written with their text.
    train, test = (_chars(durable(_features(part).drop("chars"))) for part in data.randomSplit([0.8, 0.2], seed=seed))
    stages = [
        NGram(n=2, inputCol="chars", outputCol="pairs"), NGram(n=3, inputCol="chars", outputCol="triples"),
        HashingTF(numFeatures=hash_features, inputCol="pairs", outputCol="pair_counts"),
        HashingTF(numFeatures=hash_features, inputCol="triples", outputCol="triple_counts"),
        VectorAssembler(inputCols=["pair_counts", "triple_counts", "lexical"], outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.001),
    ]
    model = Pipeline(stages=stages).fit(train)
    accuracy = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return model, float(accuracy or 0.0)


def score_domains(queries: DataFrame, model: PipelineModel, max_length: int | None = None) -> DataFrame:
    """``query, score`` for each distinct query: the highest score over all its windows.

    All of them, unless ``max_length`` leaves out longer ones.

    Repeated queries are folded before scoring, with map-side combine, and equal windows of different names are scored once.
    """
    fits = F.length("query") >= 1 if max_length is None else F.length("query").between(1, max_length)
    unique = queries.select(F.trim("query").alias("query")).where(fits).distinct()
    windows = normal_names(unique).select("query", F.explode(F.array_distinct(character_windows(
        name_variants(F.col("ascii"), F.col("plain"))))).alias("text"))
    scored = model.transform(_features(windows.select("text").distinct())).select(
        "text", vector_to_array("probability").getItem(1).alias("p"))
    return windows.join(scored, "text").groupBy("query").agg(F.max("p").alias("score"))


def domain_detections(
    dns: DataFrame, model: PipelineModel, threshold: float = DGA_THRESHOLD, max_length: int | None = None,
) -> DataFrame:
    """Detections for queries scored strictly above the threshold.

    Scores are filtered before they meet the events, so the join carries flagged names only.
    """
    rows = dns.where(F.col("event_type") == "dns").withColumn("query", F.trim("query"))
    flagged = score_domains(rows, model, max_length).where(F.col("score") > threshold)
    hits = rows.join(flagged, "query")
    evidence = F.to_json(F.struct(F.col("query").alias("domain")))
    return fire(hits, [(F.col("score") > threshold, detection(DGA_MODEL, evidence, F.col("score")))])


@dataclass(frozen=True)
class FlowModel:
    """Mean and residual projection of benign flow vectors, with the alert threshold."""

    mean: list[float]
    residual: list[list[float]]
    threshold: float

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(
            [(self.mean, self.residual, self.threshold)],
            "mean array<double>, residual array<array<double>>, threshold double",
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FlowModel:
        row = spark.read.parquet(path).first()
        return FlowModel(list(row["mean"]), [list(r) for r in row["residual"]], row["threshold"])


def _shape(flows: DataFrame) -> Column:
    return flow_vector(F.col("orig_bytes"), F.col("resp_bytes"), F.col("duration"), F.col("orig_pkts"))


def reconstruction_error(model: FlowModel, vector: Column) -> Column:
    """Mean squared distance of a flow vector from the benign subspace, as plain arithmetic."""
    n = len(model.mean)
    centred = [vector.getItem(i) - model.mean[i] for i in range(n)]
    total = F.lit(0.0)
    for weights in model.residual:
        part = sum((centred[i] * weights[i] for i in range(1, n)), centred[0] * weights[0])
        total = total + part * part
    return total / n


def flow_moments(flows: DataFrame) -> DataFrame:
    """One row with ``n``, means ``m0``-``m4`` and covariances ``c00``-``c44`` of the flow vectors: one aggregation."""
    x = flows.select(_shape(flows).alias("x")).select(*[F.col("x").getItem(i).alias(f"x{i}") for i in range(5)])
    return x.agg(
        F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(5)],
        *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)])


def flow_model(moments, components: int = 3, threshold: float = FLOW_THRESHOLD) -> FlowModel:
    """The model of a row of ``flow_moments``: residual of the leading eigenvectors of a matrix of 5 by 5."""
    if not moments["n"]:
        raise ValueError("no benign flows to fit")
    cov = np.array([[moments[f"c{min(i, j)}{max(i, j)}"] or 0.0 for j in range(5)] for i in range(5)])
    _, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :components]
    residual = np.eye(5) - axes @ axes.T
    return FlowModel([float(moments[f"m{i}"]) for i in range(5)], [[float(v) for v in row] for row in residual], threshold)


def flow_threshold(held_out: DataFrame, model: FlowModel, sigmas: float = 4.0) -> float:
    """Mean + ``sigmas`` standard deviations of the error on flows that the model was not fitted on."""
    stats = score_flows(held_out, model).agg(
        F.avg("reconstruction_mse").alias("m"), F.stddev_samp("reconstruction_mse").alias("s")).first()
    return float((stats["m"] or 0.0) + sigmas * (stats["s"] or 0.0))


def fit_flow_model(benign: DataFrame, components: int = 3, sigmas: float = 4.0, seed: int = 7) -> FlowModel:
    """Fit on four fifths of the benign flows; the others give the threshold. Two aggregations."""
    train, held_out = benign.select("orig_bytes", "resp_bytes", "duration", "orig_pkts").randomSplit([0.8, 0.2], seed=seed)
    draft = flow_model(flow_moments(train).first(), components)
    return FlowModel(draft.mean, draft.residual, flow_threshold(held_out, draft, sigmas))


def score_flows(conn: DataFrame, model: FlowModel) -> DataFrame:
    """Add the unthresholded ``reconstruction_mse``; entirely native."""
    return conn.withColumn("reconstruction_mse", reconstruction_error(model, _shape(conn)))


def flow_detections(conn: DataFrame, model: FlowModel, threshold: float | None = None) -> DataFrame:
    limit = model.threshold if threshold is None else threshold
    mse = F.col("reconstruction_mse")
    confidence = F.least(F.lit(0.99), mse / (2 * limit)) if limit else F.lit(0.5)
    evidence = F.to_json(F.struct(mse, F.lit(limit).alias("threshold")))
    return fire(score_flows(conn, model), [(mse > limit, detection(FLOW_MODEL, evidence, confidence))])


def _share(column: str, salt: str, share: float) -> Column:
    """A repeatable pseudo-random choice: true for about ``share`` of the values."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(10_000)) < int(share * 10_000)


def _choice(values: list[str], column: str, salt: str) -> Column:
    index = F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(len(values))) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def dictionary_domains(words: DataFrame, buckets: int, rounds: int = 4) -> DataFrame:
    """Two words, bare or hyphenated, with a TLD.

    Each word meets the words of one hash bucket per round. With about as many buckets as
    words this is one partner on average: an equi-join, never all pairs.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    left = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn(
        "b", F.pmod(F.xxhash64("word", "r"), F.lit(buckets)))
    right = words.select(F.col("word").alias("second"), bucket.alias("b"))
    pair = left.join(right, "b").withColumn("pair", F.concat_ws("|", "word", "second", "r"))
    hyphen = F.when(_share("pair", "hyphen", HYPHEN_SHARE), "-").otherwise("")
    return pair.select(
        F.concat("word", hyphen, "second", _choice(MALICIOUS_TLDS, "pair", "tld")).alias("domain")).distinct()


def homoglyph(domain: Column) -> Column:
    """Look-alike digits for letters; unchanged names give null."""
    swapped = F.translate(domain, "olie", "0113")
    return F.when(swapped != domain, swapped)


def training_domains(benign: DataFrame, generated: DataFrame, words: DataFrame, word_buckets: int) -> DataFrame:
    """Labelled names: generated, dictionary and look-alike against benign, prefixed and service names.

    About a third of all names also contribute one long label on its own, with the same label.
    """
    benign = benign.select("domain").where("domain is not null").distinct()
    bad = (
        generated.select("domain").distinct().unionByName(dictionary_domains(words, word_buckets))
        .unionByName(benign.select(homoglyph(F.col("domain")).alias("domain")).where("domain is not null"))
        .withColumn("label", F.lit(1.0))
    )
    prefixed = F.when(_share("domain", "service", 0.30), F.concat(
        _choice(SERVICE_LABELS, "domain", "which"), F.lit("."), "domain")).otherwise(
        F.concat(_choice(BENIGN_PREFIXES, "domain", "prefix"), F.lit("."), "domain"))
    good = benign.select(F.explode(F.array("domain", prefixed)).alias("domain")).withColumn("label", F.lit(0.0))
    every = bad.unionByName(good)
    long_labels = F.filter(F.split("domain", r"\."), lambda p: F.length(p) >= 4)
    spot = F.pmod(F.xxhash64("domain"), F.greatest(F.size(long_labels), F.lit(1))) + 1
    bare = every.where(_share("domain", "bare", BARE_SHARE) & (F.size(long_labels) > 0)).select(
        F.element_at(long_labels, spot.cast("int")).alias("domain"), "label")
    return every.unionByName(bare)
