import hashlib
import re
import zlib

import pytest

from hawkgrid.llm import line_dedup

SHARED = "A line that many documents hold"
ROWS = [
    (1, f"{SHARED}\nown line one here\nshort\n{SHARED}", "x", 1), (2, f"  {SHARED.upper()}\t\nshort\nother own text", "x", 2),
    (3, None, None, 3), (4, "", None, 4), (5, "\n\n", "n", 5), (None, f"{SHARED}\nnothing else", "z", 6),
    (6, "ééééééééé\nééééééééé1", None, 7), (7, "ééééééééé\nééééééééé1", None, 8), (7, "ééééééééé\nééééééééé1", None, 8),
    (2, f"{SHARED}\nsecond text of two", "x", 9), (8, "y" * 100_000 + "\n" + SHARED, None, 10), (9, SHARED, None, 11)]
SCHEMA = "doc_id long, text string, n_lines string, _all int"


def brute(rows):
    strip = re.compile(r"^[ \t-\r]+|[ \t-\r]+$")
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in strip.sub("", line))
    number = lambda d: 2**63 - 1 if d is None else d
    held = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(number(doc))
    out = []
    for doc, text, *rest in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == number(doc)]
        out.append((doc, None if text is None else "\n".join(kept), *rest))
    return out


@pytest.mark.parametrize("block", [1, 3, 200_000])
def test_kept_lines_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(ROWS)))


def test_bitmaps(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = {(r.doc, r.n_lines, r.n_dropped): r.keep_bitmap for r in line_dedup.keep_bitmaps(docs).collect()}
    assert zlib.decompress(found[1, 4, 0]) == bytes([0b1111])
    assert zlib.decompress(found[2, 3, 1]) == bytes([0b110])
    assert (3, 1, 0) in found and (5, 3, 0) in found


def test_query_matches_brute_force(spark, sf):
    from hawkgrid.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in brute(rows)}
    assert {r.doc_id: r.kept_sha256 for r in queries.op4_line_dedup(spark, sf).collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == 0
