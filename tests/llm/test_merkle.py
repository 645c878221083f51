import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from hawkgrid.llm import merkle
from hawkgrid.llm.queries import op13_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf_of(row, forged=False):
    doc_id, text, lang, source, n_chars = row
    text = lower(text) if forged and text is not None else text
    return H(*map(enc, (doc_id, source, lang, n_chars, text)))


def tree(digests, arity):
    """Levels of digests; the siblings of each place of the lowest level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + arity]) for k in range(0, len(levels[-1]), arity)])
    paths = []
    for at in range(len(digests)):
        path = []
        for level in levels[:-1]:
            low = at // arity * arity
            path.append((level[low:at], level[at + 1:low + arity]))
            at //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, arity=16):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for source in order:
        members = sorted(by_source[source], key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        sub[source] = (members, *tree([leaf_of(r) for r in members], arity))
    root, upper = tree([sub[s][1] for s in order], arity)
    out = []
    for k, source in enumerate(order):
        members, subroot, paths = sub[source]
        for row, path in zip(members, paths):
            path = path + upper[k]
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            acc = leaf_of(row, bad)
            for left, right in path:
                acc = H(*left, acc, *right)
            proof = H(*[d for left, right in path for d in left + right])
            out.append((row[0], leaf_of(row), subroot, root, proof, acc, acc == root))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 16])
def test_equals_brute_force(spark, arity):
    rng = random.Random(5)
    rows = [(i * 7 % 300, f"Text {i} Ärger" * rng.randrange(4), rng.choice(["en", None]), rng.choice(["a", "b", "Z", "é", None, "b"]), i)
            for i in range(180)]
    rows += [rows[3], rows[3], (None, "No Number", "en", "a", 1), (None, None, None, None, None), (5, "", "", "", 0), (10**12, "x" * 200_000, "en", "lone", 1)]
    assert run(spark, rows, arity=arity) == brute(rows, arity)


def test_one_source_and_one_row(spark):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(17)]
    assert run(spark, rows) == brute(rows)
    one = [(3, "A", "en", None, 1)]
    assert run(spark, one) == brute(one)
    assert run(spark, []) == []


def test_tampering_is_found_where_letters_change(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(60)]
    for doc_id, *_, verified in run(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 5 != 0 or doc_id % 2 == 0)


def test_hot_source_of_equal_rows_and_clashing_columns(spark):
    df = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
        F.lit("hot").alias("source"), F.lit(4).cast("long").alias("n_chars"), F.lit(1).alias("tree"), F.lit(2).alias("rank"),
        F.lit(3).alias("digest"), F.lit(4).alias("_at"), F.lit(5).alias("path"))
    got = sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    query = con.execute(merkle.SQL)
    names = [d[0] for d in query.description]
    expected = sorted(query.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in op13_merkle(spark, sf).collect()) == expected
