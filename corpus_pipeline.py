"""A training corpus from raw documents, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.llm import kneser_ney, line_dedup, mixing, ngram_join, piece_codec
from hawkgrid.llm.common import key_of, table
from hawkgrid.llm.queries import trusted
from hawkgrid.session import shared_folder


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above their language's threshold; empty ones go."""
    return kneser_ney.keep_good(docs, trusted(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first only. ``n_chars`` follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies, once; rows without an id stay."""
    groups = ngram_join.jaccard_components(docs).where("doc_id = component_id").select(key_of().alias("_doc")).distinct()
    columns = docs.columns
    held = docs.select(key_of().alias("_doc"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    numbered = held.where(F.col("_all.doc_id").isNotNull()).join(groups, "_doc").dropDuplicates(["_doc"])
    return numbered.unionByName(held.where(F.col("_all.doc_id").isNull())).select(*[F.col("_all")[c].alias(c) for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that fills several epochs occurs as often."""
    sized = mixing.with_domain(docs).withColumn("n_tokens", mixing.word_count())
    mixed = mixing.mix(sized, mixing.DEFAULT_WEIGHTS)
    copied = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copied.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, lang, source, n_ids, ids."""
    coded = piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_ids", "ids")


STAGES = [
    ("quality classifier", keep_good_text),
    ("line dedup", drop_repeated_lines),
    ("n-gram join", one_of_each_group),
    ("source mixing", mix_sources),
    ("piece encoding", encode),
]

#: Model scores and ids have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
