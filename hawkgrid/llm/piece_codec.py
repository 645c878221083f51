"""SentencePiece ids by an Aho-Corasick automaton and a single-pass Viterbi, and back to text.

The automaton holds all pieces. Reading a text once, each position reports all pieces that end there
(the automaton follows its output links, longest piece first), and each of them relaxes the best
score of that position. Characters without a piece cost the unknown score and become byte pieces.

No piece has a word mark after another character, so no piece crosses the start of a word, and
segmenting each word (marks and the characters after them) by itself gives the same best path. Distinct
words are therefore segmented once per worker and kept in a bounded store; if a vocabulary does have
such pieces, whole texts are segmented instead.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkgrid.llm.common import batches, utf8

MARK = "▁"
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0
_MAX_WORDS = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at:at + size]
            at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id from a model file."""
    with open(path, "rb") as file:
        raw = file.read()
    found = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            found.append((piece[1].decode(), score, piece.get(3, NORMAL)))
    return found


class PieceCodec:
    """Encodes and decodes single texts. White space is kept; a mark is put before the text."""

    def __init__(self, path: str):
        self.pieces = read_pieces(path)
        normal = [s for _, s, k in self.pieces if k == NORMAL]
        top = max(normal, default=0.0)
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER_DEFINED) and piece:
                # A piece of the user's own costs less than any way around it.
                score = score if kind == NORMAL else len(piece.encode()) * top - 0.1
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        crossing = any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))
        self.words = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best path through ``text`` (word marks already in place)."""
        best = [0.0] + [float("-inf")] * len(text)
        back: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        odd = iter([k for k, c in enumerate(text) if c not in self.singles] if not self.singles.issuperset(text) else ())
        next_odd = next(odd, -1)
        for end, (size, score, i) in self.automaton.iter(text):
            while -1 < next_odd < end:
                self._relax_unknown(best, back, next_odd)
                next_odd = next(odd, -1)
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (size, i)
            if next_odd == end and size == 1:
                next_odd = next(odd, -1)
        while next_odd > -1:
            self._relax_unknown(best, back, next_odd)
            next_odd = next(odd, -1)
        ids: list[int] = []
        at = len(text)
        while at:
            size, i = back[at]
            if i == self.unknown and self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(text[at - size:at].encode()))
            else:
                ids.append(i)
            at -= size
        return ids[::-1]

    def _relax_unknown(self, best, back, at: int) -> None:
        total = best[at] + self.unknown_score
        if total > best[at + 1]:
            best[at + 1], back[at + 1] = total, (1, self.unknown)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; an empty text has none."""
        if not text:
            return b""
        known, found = self.known, []
        for word in self.words.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(word)
            if ids is None:
                if len(known) >= _MAX_WORDS:
                    known.clear()
                ids = np.array(self.segment(word), "<i4").tobytes()
                if len(word) < 64:
                    known[word] = ids
            found.append(ids)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        out = []
        for i in np.frombuffer(ids, "<i4").tolist():
            out.append(bytes((self.byte_of[i],)) if i in self.byte_of else self._text(i))
        return b"".join(out).decode("utf-8", "replace").replace(MARK, " ")[1:]

    def _text(self, i: int) -> bytes:
        return self.pieces[i][0].encode() if self.pieces[i][2] in (NORMAL, USER_DEFINED) else b""


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model: str, ids: str = "ids", n_ids: str = "n_ids") -> DataFrame:
    """``docs`` without ``text``, with the ids of the whole text and their count.

    ``model`` is a path that every executor has. A null or empty text has no ids. Columns of ``docs`` with
    the new names are replaced. Rows stay where they are: nothing is shuffled.
    """
    rest = [c for c in docs.columns if c not in (ids, n_ids, "text")]
    held = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_all"), F.col("text").cast("string"))

    def run(parts):
        coder = codec(model)
        for part in parts:
            for low in range(0, part.num_rows, 500):
                some = part.slice(low, 500)
                codes = [coder.encode(t or "") for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(c) // 4 for c in codes]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["_all", "_ids"])

    schema = held.select("_all").schema.add("_ids", T.ArrayType(T.IntegerType()))
    out = held.mapInArrow(run, schema)
    return out.select(*[F.col("_all")[c].alias(c) for c in rest], F.size("_ids").cast("long").alias(n_ids), F.col("_ids").alias(ids))


def decode_pieces(coded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with ``text`` decoded from its ids (null ids: null text)."""
    rest = [c for c in coded.columns if c != text]
    held = coded.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_all"), F.col(f"`{ids}`").cast("array<int>").alias("_ids"))

    def run(parts):
        coder = codec(model)
        for part in parts:
            texts = [None if i is None else coder.decode(np.array(i, "<i4").tobytes()) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_all", "_text"])

    out = held.mapInArrow(run, held.select("_all").schema.add("_text", "string"))
    return out.select(*[F.col("_all")[c].alias(c) for c in rest], F.col("_text").alias(text))


_ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_ids, ids_crc32 (of the ids as 32-bit integers), round_trip.

    ``round_trip`` tells whether the decoded text equals the text (null counts as empty); it fails only
    for texts that hold the word mark itself. The ids do not leave the task.
    """

    def rows(parts):
        coder = codec(model)
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                text = (text or b"").decode()
                code = coder.encode(text)
                yield doc_id, len(code) // 4, zlib.crc32(code), coder.decode(code) == text

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda parts: batches(_ROUND_TRIP, rows(parts)), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
