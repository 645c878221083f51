"""Each stage against the brute force of its operator, on what the stage before it kept."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from hawkgrid.llm import kneser_ney, mixing, piece_codec, queries
from tests.llm import test_line_dedup, test_mixing, test_ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert set(after.columns) == set(docs.columns), name
        seen.append((docs, after))
        docs = after

    before, after = seen[0]
    verdicts = {r.doc_id: r.kept for r in kneser_ney.classify(before, queries.trusted(spark, sf)).collect()}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if verdicts[r[0]]) and len(set(verdicts.values())) == 2
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(verdicts[d] for d in good) >= 0.98 * len(good)

    before, after = seen[1]
    want = {d: t for d, t in test_line_dedup.brute([r[:2] for r in rows(before)])}
    assert {r[0]: r[1] for r in rows(after)} == want and all(r[4] == len(r[1]) for r in rows(after))

    before, after = seen[2]
    keep = [d for d, _, c in test_ngram_join.brute([r[:2] for r in rows(before)]) if d == c]
    assert sorted(r[0] for r in rows(after)) == sorted(keep)

    before, after = seen[3]
    sized = mixing.with_domain(before).withColumn("n", mixing.word_count()).select("doc_id", "domain", "lang", "source", "n").collect()
    copies = test_mixing.brute([tuple(r) for r in sized], mixing.DEFAULT_WEIGHTS, None, mixing.MAX_EPOCHS, mixing.SEED)
    found = after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert sorted((str(r.doc_id), r.n) for r in found) == copies

    before, after = seen[4]
    coder = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows(before)}
    for row in after.collect():
        assert np.array(row.ids, "<i4").tobytes() == coder.encode(texts[row.doc_id]) and row.n_ids == len(row.ids)
    assert after.count() == before.count()


ODD = [(None, None, None, None, None), (1, "", "en", "src1", 0), (2, "words of a text here", None, None, 5), (2, "words of a text here", None, None, 5),
       (None, "words without a number", "xx", "src2", 3), (3, "long " * 30_000, "en", "src1", 1)]


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (ODD, []):
        docs = spark.createDataFrame(data, schema).withColumns({"_all": F.lit(1), "copies": F.lit("c")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert set(out.columns) == set(docs.columns), name
            assert (out.count() > 0) == bool(data), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(data)
