import zlib

import numpy as np
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from hawkgrid.llm import token_file

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "Plain words.", "Élan ÉTÉ d'été it's 3.14", "a <|endoftext|> b", "x" * 3000, "İstanbul ΣΑΣ ΟΔΟΣ", "é ́x y",
       "日本語 テキスト 🙂🙂", "!!!..,,", "KK", "<|ENDOFTEXT|>", "word " * 4000]


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_whole_texts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    coded = token_file.WordEncoder(PATH).encode([None if t is None else t.encode() for t in texts])
    library = Tokenizer.from_file(PATH)
    for text, code in zip(texts, coded, strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_round_trip_order_ties_and_nulls(spark, tmp_path):
    rows = [(k * 7 % 14, t, "x") for k, t in enumerate(ODD)] + [(None, "last one", "y"), (3, "again", None), (3, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    manifest = token_file.write_token_files(docs, PATH, folder=str(tmp_path / "ids"))
    got = token_file.read_token_files(manifest).collect()
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id, list(r.ids)) for r in got] == [(d, whole(t)) for d, t, _ in expected]
    at = 0
    for row in got:
        assert row.start == at and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        at += row.n_tokens


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file.read_token_files(token_file.write_token_files(docs, PATH)).count() == 0


def _file(tmp_path, docs):
    path = tmp_path / "one.zst"
    with path.open("wb") as out:
        writer = token_file.FrameWriter(out)
        for doc_id, ids in docs:
            writer.add(doc_id, np.array(ids, "<u4").tobytes())
        writer.close()
    return path


class _Source:
    def __init__(self, path):
        self.raw, self.at, self.reads = path.read_bytes(), 0, 0

    def size(self):
        return len(self.raw)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.reads += n
        return self.raw[self.at:self.at + n]


def test_only_asked_frames_are_read(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 50_000, 40_000)) for k in range(40)]
    path = _file(tmp_path, docs)
    source = _Source(path)
    ((doc, before, ids),) = token_file.FrameReader(source).documents({21})
    assert (doc, before) == (21, 21 * 40_000) and np.frombuffer(ids, "<u4").tolist() == docs[21][1].tolist()
    assert source.reads < len(source.raw) / 8
    # Any reader of the format gets all ids, one frame after the other.
    with path.open("rb") as file:
        content = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert content == b"".join(np.array(x, "<u4").tobytes() for _, x in docs)


def test_damage_is_found(tmp_path):
    import pytest

    path = _file(tmp_path, [(1, [5, 6, 7])])
    source = _Source(path)
    reader = token_file.FrameReader(source)
    reader.entries = reader.entries.copy()
    reader.entries["check"][0] ^= 1
    with pytest.raises(ValueError):
        list(reader.documents())
