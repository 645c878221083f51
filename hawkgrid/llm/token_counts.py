"""Token counts of documents through a cache of digests.

A document's key is the digest of its normalised content; normalisation removes only what the tokenizer cannot see, so
equal keys mean equal counts. Counts are stored below the digest of the tokenizer's version. A run

1. reads every text once for its key (texts do not move),
2. joins the distinct keys with the cache; for each key that is not there, one row is chosen,
3. moves and encodes the texts of those rows only, spread by (key, row), so that a text that a third of all rows share
   is one text here,
4. appends their counts to the cache, and joins the cache with all keys.

A cache is a folder of Parquet files, one subfolder per version. Jobs may append at the same time: a key that two of
them counted has the same count twice, and readers take one. A failed job leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches, key_of
from hawkgrid.llm.token_file import cuts_at_white_space, slabs, word_encoder
from hawkgrid.session import durable, shared_folder

TOKEN_LIMIT = 2048
_SCHEMA = "digest binary, n_tokens long"
_COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class TokenizerVersion:
    """A tokenizer file with all that its counts depend on; ``path`` is the same on every executor."""

    path: str
    digest: str
    folds: bool
    marks: tuple[str, ...]

    @classmethod
    def of(cls, path: str) -> TokenizerVersion:
        library = "sentencepiece" if path.endswith(".model") else "tokenizers"
        with open(path, "rb") as file:
            raw = file.read()
        told = f"{library} {importlib.metadata.version(library)} default special tokens, none added, whole texts"
        spec = json.loads(raw) if library == "tokenizers" else {}
        marks = tuple(t["content"] for t in spec.get("added_tokens", ()))
        lowers = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        return cls(path, hashlib.sha256(told.encode() + b"\0" + raw).hexdigest(), cuts_at_white_space(spec) and lowers, marks)

    def normalised(self, text: Column) -> Column:
        """The text without what the tokenizer cannot see: case and runs of white space of plain ASCII texts.

        Only if the tokenizer lower-cases and drops white space; texts with characters beyond ASCII (some
        combine with a letter of one case only) or with anything like a special token stay as they are.
        """
        if not self.folds:
            return text
        plain = F.octet_length(text) == F.length(text)
        for mark in self.marks:
            plain = plain & ~F.contains(F.lower(text), F.lit(mark.lower()))
        return F.when(plain, F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))).otherwise(text)


class CountCache:
    """Counts by content digest of one tokenizer version, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, version: TokenizerVersion):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/version={version.digest}"
        spark.createDataFrame([], _SCHEMA).write.mode("ignore").parquet(self.path)

    def read(self) -> DataFrame:
        """digest, n_tokens; every digest once."""
        return self.spark.read.schema(_SCHEMA).parquet(self.path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").parquet(self.path)


def _counter(path: str):
    """A function from a column of texts to token counts, with whatever the worker has loaded already."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: [len(x) for x in processor.encode(column.to_pylist(), num_threads=1)]
    coder = word_encoder(path)
    return lambda column: np.diff(coder.encode_column(column)[1]).tolist()


def encode_missing(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens from rows (digest, text); a digest that a task meets again is not counted again."""

    def rows(parts: Iterator[pa.RecordBatch]):
        count, seen = _counter(path), set()
        for part in parts:
            fresh = [k for k, d in enumerate(part.column(0).to_pylist()) if not (d in seen or seen.add(d))]
            for some in slabs(part.take(pa.array(fresh, pa.int64())), 1):
                yield from zip(some.column(0).to_pylist(), count(some.column(1)), strict=True)

    return texts.select("digest", "text").mapInArrow(lambda parts: batches(_COUNTED, rows(parts)), _SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is a ``.json`` of the tokenizers library or a ``.model`` of sentencepiece. Nothing is added, cut or padded;
    strings of special tokens inside texts are handled as the library does by default. ``cache`` is a shared folder that
    later runs use again; without one, a new folder below ``spark.checkpoint.dir`` is taken. A null text counts as empty and
    has no tokens. Repeated rows, equal texts and rows without a doc_id each keep their row; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    version = TokenizerVersion.of(tokenizer)
    store = CountCache(spark, cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", version)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.unhex(F.sha2(version.normalised(text).cast("binary"), 256)).alias("digest"))
    keyed = durable(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    missing = durable(
        keyed.groupBy("digest").agg(F.min(key_of()).alias("_key")).join(store.read(), "digest", "left_anti"))
    if not missing.isEmpty():
        # Few missing keys are a small table, which Spark sends to all tasks: then texts stay where they are.
        chosen = rows.withColumn("_key", key_of()).join(missing, ["digest", "_key"], "left_semi")
        store.append(encode_missing(chosen, tokenizer))
    return keyed.join(store.read(), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
