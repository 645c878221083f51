"""Perplexity under an interpolated modified Kneser-Ney model of trusted text, with thresholds by language.

The model is over characters, three at a time: one table for all languages and scripts, no unknown-word problem,
and three code points fit exactly into one 63-bit key, so nothing is hashed or pruned.

Texts are packed once into compressed blocks of about 8 MB, stored in buckets by block number. Each block lists
its distinct keys. Everything else is a join of small tables:

* counts: blocks with the documents that are trusted give counts per key, summed over all blocks;
* model: discounts from counts of counts, continuation counts and back-off weights are aggregations of the counts;
* scores: each distinct key of the corpus is joined with its count, its context, its shorter key and so on,
  then with the blocks that hold it, and the block's own scores come back to it.

Thresholds are quantiles of held-out scores: trusted texts fall into halves by their hash, so that copies stay together, and
each half is scored by a model of the other one.

A task works through the texts of a block in chunks of about a million characters, as the arrays of a whole block are many times its size.

Texts are never shuffled: buckets are read where they lie, and only keys and scores move to them. A key found in every
block has one row per block, and the joins can be split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.llm.common import key_of, shuffle_partitions, utf8
from hawkgrid.session import durable, shared_folder

BLOCK_BYTES = 8 << 20
CHUNK_CHARS = 1 << 20
BEGIN, END = 0x110000, 0x110001
_BITS = 21
_DENSE = 1 << 22
QUANTILE, MARGIN, MIN_TRUSTED, PRIOR_CHARS = 0.99, 0.0, 50, 100
_USUAL = 0.5, 0.75, 0.9
_MODELS = ["logp", "held_0", "held_1"]


# Blocks ------------------------------------------------------------------------------------------------------------

def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, each as BEGIN BEGIN text END, and where each starts."""
    parts, starts, at = [], [], 0
    edge, end = np.array([BEGIN, BEGIN], np.uint32), np.array([END], np.uint32)
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        parts += [edge, codes, end]
        starts.append(at)
        at += len(codes) + 3
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(starts, np.int64)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts, about ``CHUNK_CHARS`` characters at a time."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class _Alphabet:
    """Small numbers for the symbols of a block, so that keys index an array."""

    def __init__(self, texts: list[str]):
        seen = np.zeros(END + 1, bool)
        for chunk in _chunks(texts):
            seen[_symbols(chunk)[0]] = True
        self.symbols = np.flatnonzero(seen)
        self.size = len(self.symbols)
        self.number = np.zeros(END + 1, np.int32)  # wide enough for keys below _DENSE
        self.number[self.symbols] = np.arange(self.size)
        self.dense = self.size ** 3 <= _DENSE

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The small key that ends at each symbol from the third on (or the real one, for large alphabets)."""
        if self.dense:
            n = self.number[codes]
            return (n[:-2] * self.size + n[1:-1]) * self.size + n[2:]
        c = codes.astype(np.int64)
        return (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]

    def real(self, keys: np.ndarray) -> np.ndarray:
        if not self.dense:
            return keys
        s, a = self.symbols, self.size
        return (s[keys // (a * a)] << 2 * _BITS) | (s[keys // a % a] << _BITS) | s[keys % a]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct real keys and their counts; keys that end in BEGIN lie between documents."""
    alphabet = _Alphabet(texts)
    found = np.zeros(alphabet.size ** 3 if alphabet.dense else 0, np.int64)
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for chunk in _chunks(texts):
        codes, _ = _symbols(chunk)
        some = alphabet.keys(codes)[codes[2:] != BEGIN]
        if alphabet.dense:
            part = np.bincount(some)
            found[:len(part)] += part
        else:
            some, part = np.unique(some, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, some]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, part])).astype(np.int64)
    if alphabet.dense:
        keys = np.flatnonzero(found)
        return alphabet.real(keys), found[keys]
    return keys, n


def _unpack(payload: bytes, sizes: list[int]) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum([0, *sizes]).tolist()
    return [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, texts, total = [], [], 0

    def block():
        keys, _ = _counts([t.decode() for t in texts])
        payload = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([docs], _DOCS), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
             pa.array([payload], pa.binary()), pa.array([keys], pa.list_(pa.int64()))],
            names=["block", "docs", "sizes", "payload", "keys"])

    for part in (p.slice(low, 500) for p in parts for low in range(0, p.num_rows, 500)):
        for doc_id, lang, text_hash, text in zip(*(part.column(k).to_pylist() for k in range(3)), utf8(part.column(3)), strict=True):
            docs.append({"doc_id": doc_id, "lang": lang, "text_hash": text_hash, "row": len(docs), "empty": not text})
            texts.append(text or b"")
            total += len(texts[-1])
            if total >= BLOCK_BYTES or len(texts) >= 50_000:
                yield block()
                docs, texts, total = [], [], 0
    if texts:
        yield block()


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64()), ("row", pa.int32()), ("empty", pa.bool_())]))
_BLOCKS = ("block long, docs array<struct<doc_id: long, lang: string, text_hash: long, row: int, empty: boolean>>, sizes array<long>, "
           "payload binary, keys array<long>")


def text_blocks(docs: DataFrame) -> DataFrame:
    """Packed texts as a table in the shared folder, in buckets by block number."""
    spark = docs.sparkSession
    name = f"text_blocks_{uuid.uuid4().hex}"
    packed = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
    ).mapInArrow(_pack, _BLOCKS)
    (packed.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "snappy")
     .bucketBy(shuffle_partitions(spark), "block").saveAsTable(name))
    return spark.table(name)


# Model -------------------------------------------------------------------------------------------------------------

def half(text_hash: str = "text_hash") -> Column:
    """0 or 1; texts that are equal share it."""
    return F.pmod(F.col(text_hash), F.lit(2)).cast("int")


def trusted_counts(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(half, k, n): how often each key occurs in the documents of a half whose ``doc_id`` is in ``trusted``."""
    held = blocks.select("block", F.explode("docs").alias("d")).select("block", "d.doc_id", "d.row", half("d.text_hash").alias("half"))
    rows = held.join(trusted.select("doc_id").distinct(), "doc_id").groupBy("block", "half").agg(F.collect_list("row").alias("rows"))
    rows = rows.groupBy("block").agg(F.collect_list(F.struct("half", "rows")).alias("halves"))

    def count(parts):
        for part in parts:
            for row in range(part.num_rows):
                sizes, payload, halves = (part.column(k)[row].as_py() for k in range(3))
                texts = _unpack(payload, sizes)
                for h in halves:
                    keys, n = _counts([texts[r] for r in h["rows"]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), h["half"]), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())],
                        names=["half", "k", "n"])

    found = blocks.select("block", "sizes", "payload").join(rows.hint("shuffle_hash"), "block").select("sizes", "payload", "halves")
    return found.mapInArrow(count, "half int, k long, n long").groupBy("half", "k").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, n: str = "n") -> tuple[float, float, float]:
    """Discounts of counts of one, two, and three or more, from the counts of counts."""
    row = counts.agg(*[F.sum((F.col(n) == k).cast("long")).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return _USUAL  # too little text for an estimate
    y = n1 / (n1 + 2 * n2)
    found = [min(k - (k + 1) * y * b / a, float(k)) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    # Few symbols can give a discount of nothing, which would leave no probability for what a context has not seen.
    return tuple(d if d > 0 else usual for d, usual in zip(found, _USUAL, strict=True))


def _discount(n: str, d: tuple[float, float, float]) -> Column:
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, context: Column, d: tuple[float, float, float], names: tuple[str, str, str]) -> DataFrame:
    """Per context: total count and the weight left to the shorter one."""
    key, total, left = names
    return counts.groupBy(context.alias(key)).agg(
        F.sum("n").alias(total), (F.sum(_discount("n", d)) / F.sum("n")).alias(left))


class Model:
    """Tables of the model: trigrams (k, n), bigrams (k, n), unigrams (k, n) and their contexts."""

    def __init__(self, counts: DataFrame):
        self.tri = durable(counts)
        mask2, mask1 = (1 << 2 * _BITS) - 1, (1 << _BITS) - 1
        self.bi = durable(self.tri.groupBy(F.col("k").bitwiseAND(mask2).alias("k")).agg(F.count("*").alias("n")))
        self.uni = durable(self.bi.groupBy(F.col("k").bitwiseAND(mask1).alias("k")).agg(F.count("*").alias("n")))
        self.d3, self.d2, self.d1 = (discounts(t) for t in (self.tri, self.bi, self.uni))
        row = self.uni.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum(_discount("n", self.d1)).alias("d")).first()
        self.symbols, self.total = row["v"] + 1, row["n"] or 0
        self.left = row["d"] / row["n"] if row["n"] else 1.0
        self.mask2, self.mask1 = mask2, mask1

    def log_probabilities(self, keys: DataFrame) -> DataFrame:
        """(k, logp) for distinct keys, by joins on the key, its context and its shorter keys."""
        bits = _BITS
        uniform = self.left / self.symbols
        ctx3 = _contexts(self.tri, F.shiftright("k", bits), self.d3, ("c3", "t3", "l3"))
        ctx2 = _contexts(self.bi, F.shiftright("k", bits), self.d2, ("c2", "t2", "l2"))
        one = self.uni.select(F.col("k").alias("k1"), ((F.col("n") - _discount("n", self.d1)) / F.lit(float(self.total or 1)) + uniform).alias("p1"))
        two = self.bi.select(F.col("k").alias("k2"), (F.col("n") - _discount("n", self.d2)).alias("n2"))
        three = self.tri.select(F.col("k"), (F.col("n") - _discount("n", self.d3)).alias("n3"))
        # Shorter keys first: they are fewer.
        pairs = keys.select(F.col("k").bitwiseAND(self.mask2).alias("k2")).distinct()
        pairs = (
            pairs.join(two, "k2", "left").withColumn("c2", F.shiftright("k2", bits)).join(ctx2, "c2", "left")
            .withColumn("k1", F.col("k2").bitwiseAND(self.mask1)).join(one, "k1", "left")
            .withColumn("p1", F.coalesce("p1", F.lit(uniform)))
            .select("k2", F.when(F.col("t2").isNull(), F.col("p1")).otherwise(
                F.coalesce("n2", F.lit(0.0)) / F.col("t2") + F.col("l2") * F.col("p1")).alias("p2")))
        return (
            keys.join(three, "k", "left").withColumn("c3", F.shiftright("k", bits)).join(ctx3, "c3", "left")
            .withColumn("k2", F.col("k").bitwiseAND(self.mask2)).join(pairs, "k2")
            .select("k", F.log(F.when(F.col("t3").isNull(), F.col("p2")).otherwise(
                F.coalesce("n3", F.lit(0.0)) / F.col("t3") + F.col("l3") * F.col("p2"))).alias("logp")))


# Scores ------------------------------------------------------------------------------------------------------------

def _score_block(texts: list[str], keys: np.ndarray, logps: list[np.ndarray]) -> list[np.ndarray]:
    """Mean log probability of each text's characters and its end, under each model."""
    alphabet = _Alphabet(texts)
    if alphabet.dense:
        small = alphabet.number
        mask = (1 << _BITS) - 1
        at = (small[keys >> 2 * _BITS] * alphabet.size + small[keys >> _BITS & mask]) * alphabet.size + small[keys & mask]
        place = np.zeros(alphabet.size ** 3, np.int32)
        place[at] = np.arange(len(keys))
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    means = [[] for _ in logps]
    for chunk in _chunks(texts):
        codes, starts = _symbols(chunk)
        found = alphabet.keys(codes)
        found = place[found] if alphabet.dense else order[np.minimum(np.searchsorted(ordered, found), len(keys) - 1)]
        between, size = codes[2:] == BEGIN, np.array([len(t) + 1 for t in chunk])
        for mean, logp in zip(means, logps, strict=True):
            scores = logp[found]
            scores[between] = 0.0
            mean.append(np.add.reduceat(scores, starts) / size)
    return [np.concatenate(mean) for mean in means]


_SCORED = "doc_id long, lang string, text_hash long, n_chars long, perplexity double, held_0 double, held_1 double"


def perplexities(blocks: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang, text_hash, n_chars, perplexity of every document (null for an empty text).

    ``models`` are of all trusted texts, of those outside half 0, and of those outside half 1; the last two give held_0 and held_1.
    """
    held = blocks.select("block", F.explode("keys").alias("k"))
    keys = durable(blocks.select(F.explode("keys").alias("k")).distinct())
    scored = keys
    for name, model in zip(_MODELS, models, strict=True):
        # One model at a time: the driver never plans, compiles and broadcasts for all of them at once.
        scored = durable(scored.join(model.log_probabilities(keys).withColumnRenamed("logp", name), "k"))
    own = held.join(scored, "k").groupBy("block").agg(F.collect_list(F.struct("k", *_MODELS)).alias("scores"))

    def score(parts):
        for part in parts:
            for row in range(part.num_rows):
                docs, sizes, payload = (part.column(k)[row].as_py() for k in range(3))
                scores = part.column(3)[row].values
                texts = _unpack(payload, sizes)
                means = _score_block(texts, scores.field(0).to_numpy(), [scores.field(k + 1).to_numpy() for k in range(len(_MODELS))])
                values = [[None if d["empty"] else float(np.exp(-m)) for d, m in zip(docs, mean, strict=True)] for mean in means]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array([d["lang"] for d in docs], pa.string()),
                     pa.array([d["text_hash"] for d in docs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                     *(pa.array(v, pa.float64()) for v in values)], names=["doc_id", "lang", "text_hash", "n_chars", "perplexity", *_MODELS[1:]])

    both = blocks.select("block", "docs", "sizes", "payload").join(own.hint("shuffle_hash"), "block")
    return both.select("docs", "sizes", "payload", "scores").mapInArrow(score, _SCORED)


def _judged(perplexity: str, middle: str, prior_chars: int) -> Column:
    """The perplexity as if ``prior_chars`` characters of perplexity ``middle`` came before the text."""
    size = F.col("n_chars") + 1
    return F.exp((size * F.log(perplexity) + prior_chars * F.log(middle)) / (size + prior_chars))


def classify(
    docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, min_trusted: int = MIN_TRUSTED,
    prior_chars: int = PRIOR_CHARS,
) -> DataFrame:
    """doc_id, lang, text_hash, n_chars, perplexity, judged, threshold, kept of each row of ``docs`` (doc_id, lang, text).

    The model learns from all documents whose doc_id is in ``trusted`` (doc_id). ``judged`` is the perplexity as if
    ``prior_chars`` characters of the language's median came before the text, so that a short text is not rejected
    for a single odd word; a document is kept if it is not above the threshold. The threshold of a language is the ``quantile`` of
    its trusted documents' ``judged``, each under a model of the other half of them (under the whole model while one half is empty),
    plus ``margin`` times its distance from their median; languages with fewer than ``min_trusted`` of them, unknown ones and null
    share median and threshold of all trusted documents.

    A null or empty text has no perplexity and is not kept. Without trusted documents nothing can be judged: the threshold is
    null and every text is kept. Null ids are never trusted; repeated rows are scored each (``text_hash`` tells texts
    of one id apart); other columns are ignored.
    """
    blocks = text_blocks(docs)
    trusted = durable(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct())
    counts = durable(trusted_counts(blocks, trusted))
    whole = counts.groupBy("k").agg(F.sum("n").alias("n"))
    halves = [counts.where(F.col("half") != h).select("k", "n") for h in (0, 1)]
    scored = durable(perplexities(blocks, [Model(c) for c in (whole, *halves)]))
    held = F.when(half() == 0, F.col("held_0")).otherwise(F.col("held_1"))
    both_halves = counts.select("half").distinct().count() == 2
    sure = durable(scored.where("perplexity is not null").join(trusted, "doc_id", "left_semi").select(
        "lang", "n_chars", (held if both_halves else F.col("perplexity")).alias("_held")))
    median = F.percentile_approx("_held", 0.5, 10_000).alias("_middle")
    at = F.percentile_approx(_judged("_held", "_middle", prior_chars), quantile, 10_000)
    limit = (at + margin * (at - F.max("_middle"))).alias("_limit")
    # One row per language with enough trusted documents.
    middles = sure.where("lang is not null").groupBy("lang").agg(median, F.count("*").alias("_n")).where(F.col("_n") >= min_trusted).drop("_n")
    middles = durable(middles)
    small = lambda t: F.broadcast(t) if t.count() <= 10_000 else t
    by_lang = durable(sure.join(small(middles), "lang").groupBy("lang").agg(F.max("_middle").alias("_middle"), limit))
    overall = sure.agg(median).first()["_middle"]
    overall_limit = sure.withColumn("_middle", F.lit(overall).cast("double")).agg(limit).first()["_limit"]
    out = scored.join(small(by_lang), "lang", "left").withColumns({
        "threshold": F.coalesce("_limit", F.lit(overall_limit).cast("double")),
        "_middle": F.coalesce("_middle", F.lit(overall).cast("double"))})
    judged = _judged("perplexity", "_middle", prior_chars)
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("judged") <= F.col("threshold")))
    return out.withColumn("judged", judged).select(
        "doc_id", "lang", "text_hash", "n_chars", "perplexity", "judged", "threshold", kept.alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps, with all their columns."""
    columns = docs.columns
    verdicts = classify(docs, trusted, **options).where("kept").select(
        key_of().alias("_doc"), F.col("text_hash").alias("_row")).distinct()
    held = docs.select(key_of().alias("_doc"), F.xxhash64("text").alias("_row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    return held.join(verdicts, ["_doc", "_row"], "left_semi").select(*[F.col("_all")[c].alias(c) for c in columns])
