"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.llm import (
    alignment, cover_tree, kneser_ney, line_dedup, merkle, mixing, ngram_join, pii, piece_codec, token_counts, token_file, toxicity,
    weak_rules)
from hawkgrid.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "nearest", "evidence")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels call good: the text the quality model learns from."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir)).drop("text_hash")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), counts=True)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(
  regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(table(spark, sf_dir, "documents")).withColumn("n_tokens", mixing.word_count())
    mixed = mixing.mix(docs.select("doc_id", "domain", "lang", "source", "n_tokens"), mixing.DEFAULT_WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_file.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_file.read_token_files(manifest, ids=False)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own: every call does the whole work.
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup,
        "op5_rules": op5_rules,
        "op6_cover_tree": op6_cover_tree,
        "op7_mixing": op7_mixing,
        "op8_ngram_join": op8_ngram_join,
        "op9_pieces": op9_pieces,
        "op10_token_file": op10_token_file,
        "op11_token_counts": op11_token_counts,
        "op12_alignment": op12_alignment,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": OP4_SQL, "op6_cover_tree": cover_tree.SQL, "op7_mixing": mixing.SQL, "op8_ngram_join": ngram_join.SQL,
        "op13_merkle": merkle.SQL}
