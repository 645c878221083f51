import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from hawkgrid.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   two  spaces\n\nand\ttabs ", "日本語 と 🙂🙂́", "a" * 5000, "▁ mark ▁▁", "<s> </s> <0x0A> <unk>", "\x00\x01 ctrl", "word " * 20_000,
       "Ünïcödé ñandú", "x▁y"]


def unigram(path):
    """The library's encoder for the same pieces and scores, told to look for the best path."""
    with open(path, "rb") as file:
        raw = file.read()

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in piece_codec._fields(raw):
        value += b"\x18\x01" if number == 2 else b""  # trainer settings: kind of model
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_no_path_of_the_library_is_better(spark, sf):
    """The library, told to use these scores, sometimes takes another path; its score is then never the higher one."""
    library, coder = unigram(PATH), piece_codec.PieceCodec(PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    known = coder.singles | {" "}
    parts = {" ".join(words[k:k + 5]) for t in texts for words in [t.split()] for k in range(0, len(words), 5)}
    parts = sorted(p for p in parts if known.issuperset(p))
    score = lambda ids: sum(coder.pieces[i][1] for i in ids)
    pairs = [(np.frombuffer(coder.encode(p), "<i4").tolist(), library.encode(p)) for p in parts]
    assert len(pairs) > 5000 and all(score(one) >= score(two) for one, two in pairs)
    assert sum(one == two for one, two in pairs) > len(pairs) / 2
    for text in ["日本語 と 🙂", "a\tb\n", "\x00"]:  # byte pieces
        assert np.frombuffer(coder.encode(text), "<i4").tolist() == library.encode(text)


def test_words_alone_equal_whole_texts():
    coder = piece_codec.PieceCodec(PATH)
    for text in ["  hello  world\nfoo\t bar ", "one two  three", "日本 x 🙂"]:
        whole = coder.segment(piece_codec.MARK + text.replace(" ", piece_codec.MARK))
        assert np.frombuffer(coder.encode(text), "<i4").tolist() == whole


def brute(coder, text):
    """Best total score by trying every piece at every position."""
    pieces = {p: s for p, s, k in coder.pieces if k == piece_codec.NORMAL}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            score = pieces.get(text[start:end], coder.unknown_score if end - start == 1 else None)
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_best_score():
    coder = piece_codec.PieceCodec(PATH)
    for word in ["▁internationalisation", "▁zzxqj", "▁Größenordnung", "▁日本語"]:
        ids = coder.segment(word)
        total = sum(coder.pieces[i][1] if i not in coder.byte_of else 0.0 for i in ids)
        lost = word.encode() if not ids else b"".join(bytes([coder.byte_of[i]]) for i in ids if i in coder.byte_of)
        assert total + coder.unknown_score * len(lost.decode()) == brute(coder, word)


def test_round_trip(spark):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(ODD)] + [(None, "again", 2, None)] * 2,
                                 "doc_id long, text string, ids int, _all string")
    coded = piece_codec.encode_pieces(docs, PATH)
    back = piece_codec.decode_pieces(coded, PATH)
    assert set(back.columns) == {"doc_id", "_all", "ids", "n_ids", "text"}
    for row in back.collect():
        want = "again" if row.doc_id is None else ODD[row.doc_id] or ""
        assert row.n_ids == len(row.ids) and row.text == want.replace(piece_codec.MARK, " ")
    for row in piece_codec.round_trip(docs, PATH).collect():
        text = "again" if row.doc_id is None else ODD[row.doc_id] or ""
        assert row.round_trip == (piece_codec.MARK not in text)
    ids = {r.doc_id: zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in coded.collect()}
    assert ids == {r.doc_id: r.ids_crc32 for r in piece_codec.round_trip(docs, PATH).collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.encode_pieces(docs, PATH).count() == 0 and piece_codec.round_trip(docs, PATH).count() == 0
