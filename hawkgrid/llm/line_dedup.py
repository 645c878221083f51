"""Lines found in several documents stay only in the first of them, as compressed keep bitmaps.

1. Each task hashes the keys of its lines (128 bits) and folds what it holds of a key: one row with
   the key's first document and position, and all its other places packed beside. A key held by a
   third of all documents thus gives a row per block of lines, not one per line.
2. Rows are range-partitioned by hash. Hashes are uniform, so equal ranges are even and need no
   sampling. Within a range they are sorted by hash, document and position.
3. A stream over each range keeps the first document of a key and reports the places of all others.
4. Places are gathered per document into a bitmap: one bit per line, zlib-compressed.

Texts are not moved for any of this; only ``apply_bitmaps`` joins them with the bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches, key_of, shuffle_partitions, utf8

MIN_CHARS = 10
BLOCK_LINES = 200_000
_PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("line", "<i8")])
_KEYS = pa.schema([("range", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()),
                   ("line", pa.int64()), ("others", pa.binary())])
_DROPS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("line", pa.int64())])


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased, or None if it is too short."""
    key = line.strip().lower()
    if len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode()) >= min_chars):
        return key
    return None


def _text_row() -> Column:
    """Tells rows with the same doc_id apart; equal rows share their decisions."""
    return F.xxhash64(F.col("text"))


def _fold(parts: Iterator[pa.RecordBatch], n_ranges: int, min_chars: int) -> Iterator[tuple]:
    held: dict[bytes, list] = {}
    n = 0

    def flush():
        for digest, places in held.items():
            places.sort()
            hi, lo = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
            doc, row, line = places[0]
            others = np.array(places[1:], _PLACE).tobytes() if len(places) > 1 else None
            yield (hi * n_ranges >> 64, hi - 2**63, lo - 2**63, doc, row, line, others)
        held.clear()

    for part in parts:
        for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
            for at, line in enumerate((text or b"").split(b"\n")):
                key = line_key(line, min_chars)
                if key is not None:
                    held.setdefault(xxhash.xxh3_128_digest(key), []).append((doc, row, at))
                    n += 1
            if n >= BLOCK_LINES:
                yield from flush()
                n = 0
    yield from flush()


def _later_places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash, document, row and line: the places outside a key's first document."""
    last, first = None, 0
    for part in parts:
        hi, lo, doc, row, line = (part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
        if not len(hi):
            continue
        new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        new[0] = last != (hi[0], lo[0])
        # A row's first document is the one of the latest start, or the one carried over.
        start = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
        firsts = np.where(start >= 0, doc[np.maximum(start, 0)], first)
        late = doc != firsts
        out = [np.stack([doc[late], row[late], line[late]], 1)]
        others = part.column(6)
        for k in np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False)):
            places = np.frombuffer(others[int(k)].as_py(), _PLACE)
            places = places[places["doc"] != firsts[k]]
            out.append(np.stack([places["doc"], places["row"], places["line"]], 1))
        last, first = (hi[-1], lo[-1]), int(firsts[-1])
        found = np.concatenate(out)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], schema=_DROPS)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per distinct (doc_id, text): doc, row, n_lines, n_dropped, keep_bitmap.

    ``doc`` is the doc_id (a null one counts as the largest number), ``row`` a hash of the text that tells
    rows of the same doc_id apart; ``keep_bitmap`` has bit i (from the lowest bit of the first byte) set if line i
    stays, zlib-compressed. Rows of the same doc_id are one document: they never drop each
    other's lines. A null or empty text has one empty line. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    n_ranges = shuffle_partitions(spark)
    rows = docs.select(key_of().alias("doc"), _text_row().alias("row"), F.col("text").cast("string").alias("text"))
    keys = rows.mapInArrow(
        lambda parts: batches(_KEYS, _fold(parts, n_ranges, min_chars)),
        "range int, hi long, lo long, doc long, row long, line long, others binary")
    drops = (
        keys.repartitionById(n_ranges, "range").sortWithinPartitions("hi", "lo", "doc", "row", "line")
        .mapInArrow(_later_places, "doc long, row long, line long"))
    # Without a map-side combine: the lists are bounded by a document's lines.
    dropped = drops.groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = rows.select("doc", "row", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    both = sizes.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines")).join(dropped, ["doc", "row"], "left")

    def pack(parts):
        for part in parts:
            maps, counts = [], []
            for n, lines in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[lines or []] = False
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
                counts.append(len(lines or []))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
                names=["doc", "row", "n_lines", "n_dropped", "keep_bitmap"])

    return both.mapInArrow(pack, "doc long, row long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_lines(text: bytes, bitmap: bytes) -> bytes:
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return b"\n".join(lines) if bits.all() else b"\n".join([x for x, keep in zip(lines, bits.tolist(), strict=True) if keep])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines; other columns stay as they are.

    With ``counts``, n_lines and n_dropped follow (names that ``docs`` already has are taken from
    the bitmaps). A null text stays null: nothing is dropped from it.
    """
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    held = docs.select(
        key_of().alias("_doc"), _text_row().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    maps = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("row").alias("_row"), "n_lines", "n_dropped",
        F.when(F.col("n_dropped") > 0, F.col("keep_bitmap")).alias("_map"))
    joined = held.join(maps, ["_doc", "_row"], "left").select("_all", "n_lines", "n_dropped", "_map")
    at = columns.index("text")

    def cut(parts):
        for part in parts:
            found = [t if b is None or t is None else kept_lines(t, b) for t, b in zip(
                utf8(part.column(0).field(at)), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(found, pa.binary()).cast(pa.string())],
                names=["_all", "n_lines", "n_dropped", "_text"])

    schema = joined.drop("_map").schema.add("_text", "string")
    out = joined.mapInArrow(cut, schema)
    fields = [(F.col("_text") if c == "text" else F.col("_all")[c]).alias(c) for c in columns]
    return out.select(*fields, *(["n_lines", "n_dropped"] if counts else []))
