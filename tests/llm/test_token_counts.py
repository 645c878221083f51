import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hawkgrid.llm import token_counts as tc
from hawkgrid.llm.queries import op11_token_counts
from hawkgrid.llm.token_file import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
TEXTS = [
    "", " ", "\n\t ", "Hello, World. It's 3.14 o'clock...", "hello, world. it's 3.14 O'CLOCK...", "  hello,\nworld.  it's 3.14 o'clock...",
    "a<|endoftext|>b", "a<|ENDOFTEXT|>b", "<|endoftext|><|startoftext|> <|", "İstanbul H̱ ẖ ẖ", "a\x1cb\x85c\xa0d", "U.S.A. e.g., x.", "日本語 text、あ",
    "Å Å", "x" * 50_000, "word " * 30_000, "\U0001F600‍", "\x00 a", "don't DON'T 'S 's", "a,b. c,\x0bd",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_equals_library(text):
    code = WordEncoder(WORDS).encode([text.encode()])[0]
    assert [int.from_bytes(code[k:k + 4], "little") for k in range(0, len(code), 4)] == library(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aAbhHİ.,'’<|>é̱ \n\t1sS-", "<|endoftext|>", "<|EndOfText|>"]), max_size=40))
def test_encoder_equals_library_on_odd_texts(parts):
    text = "".join(parts)
    coder = test_encoder_equals_library_on_odd_texts.coder
    code = coder.encode([text.encode()])[0]
    assert [int.from_bytes(code[k:k + 4], "little") for k in range(0, len(code), 4)] == library(text)


test_encoder_equals_library_on_odd_texts.coder = WordEncoder(WORDS)


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_counts_equal_library(spark, tmp_path):
    texts = [*TEXTS, None, *TEXTS[3:6], "tok " * 2048, "tok " * 2049]
    got = {r.doc_id: tuple(r)[1:] for r in tc.token_counts(docs(spark, texts), WORDS, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t)), len(library(t)) > 2048) for i, t in enumerate(texts)}


def test_other_tokenizers_equal_their_library(spark, tmp_path):
    import sentencepiece

    texts = [*TEXTS, None]
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path)).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, texts), model, str(tmp_path)).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert got == {i: len(pieces.encode(t or "")) for i, t in enumerate(texts)}


def test_second_run_encodes_only_new_texts(spark, tmp_path):
    cache = tc.CountCache(spark, str(tmp_path), tc.TokenizerVersion.of(WORDS))
    tc.token_counts(docs(spark, ["one two", "One  TWO ", "three", "drei ä"]), WORDS, str(tmp_path)).collect()
    first = {r.digest: r.n_tokens for r in cache.read().collect()}
    assert len(first) == 3, "case and white space of plain texts share a key"
    tc.token_counts(docs(spark, ["one two", "three", "four", "four", None]), WORDS, str(tmp_path)).collect()
    assert spark.read.parquet(cache.path).count() == 5, "only two texts were new, each counted once"
    assert {r.digest: r.n_tokens for r in cache.read().collect()}.items() >= first.items()
    # What the cache says is believed: a stored count is not worked out again.
    digest = next(iter(first))
    before = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, ["one two", "three", "drei ä"]), WORDS, str(tmp_path)).collect()}
    cache.append(spark.createDataFrame([(digest, 99)], "digest binary, n_tokens long"))
    after = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, ["one two", "three", "drei ä"]), WORDS, str(tmp_path)).collect()}
    assert sorted(after.values()) == sorted([99, *[n for n in before.values() if n != first[digest]], *[
        n for n in before.values() if n == first[digest]][1:]])


def test_versions_do_not_mix(spark, tmp_path):
    a, b = (tc.TokenizerVersion.of(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert a.digest != b.digest and a.folds and not b.folds
    one = docs(spark, ["Some  TEXT"])
    counts = [tc.token_counts(one, public_tokenizers.path(n), str(tmp_path)).first().n_tokens for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    assert counts[0] == 2 and counts[1] == len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Some  TEXT").ids)


def test_many_missing_keys_are_shuffled(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    texts = [f"text {i % 40}" for i in range(200)] + ["hot"] * 100
    try:
        got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs(spark, texts), WORDS, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: len(library(t)) for i, t in enumerate(texts)}


def test_repeated_rows_nulls_clashing_columns_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string").select(
        "*", F.lit(1).alias("digest"), F.lit(2).alias("_key"), F.lit(3).alias("n_tokens"), F.lit(4).alias("n_bytes"))
    got = sorted(map(repr, (tuple(r) for r in tc.token_counts(rows, WORDS, str(tmp_path)).collect())))
    assert got == sorted(map(repr, [(1, 3, 2, False), (1, 3, 2, False), (None, 3, 2, False), (None, 0, 0, False)]))
    assert tc.token_counts(rows.limit(0), WORDS).collect() == []


def test_query_equals_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_counts(spark, sf).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t)), len(library(t)) > 2048) for i, t in texts.items()}
