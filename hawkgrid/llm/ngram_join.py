"""Documents linked by the Jaccard similarity of their word n-grams: a blocked sparse matrix product.

The incidence matrix has a row per distinct set of n-grams and a column per n-gram; its product with itself holds all
overlaps. Only entries that can reach the threshold are computed:

1. *Columns.* One pass counts n-grams in ``2^24`` counters of all documents. By these counts, rare first, every row is
   put in one common order. With a similarity of at least t, two rows share one of the first ``n - ceil(t n) + 1`` of
   each, so only those entries of the matrix are kept. N-grams that many documents share come last and
   rarely among them. The counters only choose the order: any order gives the same links.
2. *Column blocks.* Entries are dealt by ranges of n-gram hashes. In a column with up to ``WIDE`` rows, each pair adds
   one to its overlap; sums over all blocks discard pairs below the bound that their sizes give. What is left is
   compared in full.
3. *Wide columns* (large groups of near copies) would give all pairs of a group. Their rows are put into blocks of rows
   instead, in two orders, and each block is multiplied with itself, column chunk by column chunk. A product returns
   links that span its connected parts, not all pairs. Groups of near copies are mostly one component then.
4. *Mixed columns* are the wide ones that still hold several components. Their rows are put into blocks again, those of
   large components apart and the others by size, and pairs of blocks with a mixed column in common are multiplied, but
   not two of one component, nor two whose sizes are too different.

Equal sets are one row from the start, so exact copies never meet each other. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches, components, shuffle_partitions, utf8
from hawkgrid.session import durable

N_WORDS, THRESHOLD = 5, 0.75
# With few counters for the n-grams there are, shared ones vanish among the chance sums of others and come early.
COUNTER_BITS, SEGMENTS, COUNTED = 24, 64, 1 << 15
WIDE, ROW_BLOCK, ENTRIES, COLUMN_CHUNK = 24, 1000, 500_000, 2048
# Of hashes in a row block. Spark holds a few pairs of blocks at a time.
BLOCK_BYTES = 4 << 20
# Odd multipliers of a mixing step, one per word of an n-gram.
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SHIFT = np.uint64(29)


def shingles(text: bytes, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text.

    Words lie between ASCII white space, with A-Z lower-cased; a text of fewer words is one shingle, one without
    words none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(words) - n + 1
    mixed = np.zeros(size, np.uint64)
    for k in range(n):
        mixed = (mixed ^ hashes[k:k + size]) * _MIX[k % len(_MIX)]
        mixed ^= mixed >> _SHIFT
    return np.unique(mixed)


def row_id(hashes: np.ndarray) -> int | None:
    """Number of a set: equal for equal sets; None for the empty set."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big") - 2**63 if len(hashes) else None


def needed(n: int, threshold: float) -> int:
    """Least overlap of a set of ``n`` with any set at the threshold: ceil(threshold n), in whole hundredths."""
    return -(-n * round(threshold * 100) // 100)


def _slices(parts: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that only the texts of a piece are copied at once."""
    for part in parts:
        for low in range(0, part.num_rows, size):
            yield part.slice(low, size)


# Sizes and counters ------------------------------------------------------------------------------------------------

_SIZES = "doc_id long, n long, row long, segment int, counts binary"
_SIZES_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("row", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])


def _measure(n_words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint16)

        def counters():
            for k, some in enumerate(np.split(counts, SEGMENTS)):
                yield None, None, None, k, pa.compress(some.astype("<u2").tobytes(), codec="zstd", asbytes=True)
            counts.fill(0)

        def rows():
            texts = 0
            for part in _slices(parts):
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    hashes = shingles(text or b"", n_words)
                    at = (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                    np.add.at(counts, at, 1)
                    yield doc_id, len(hashes), row_id(hashes), None, None
                    texts += 1
                    if texts % COUNTED == 0:  # before a counter can overflow
                        yield from counters()
            if counts.any():
                yield from counters()

        yield from batches(_SIZES_ARROW, rows())

    return run


def _counters(measured: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, 65,535 at most: 32 MB, whatever the input."""
    size = (1 << COUNTER_BITS) // SEGMENTS

    def add(parts):
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = np.frombuffer(pa.decompress(raw, 2 * size, codec="zstd", asbytes=True), "<u2")
                if k in sums:
                    sums[k] += found
                else:
                    sums[k] = found.astype(np.uint64)
        for k, found in sums.items():
            least = np.minimum(found, 0xFFFF).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([least.tobytes()], pa.binary())], names=["k", "sums"])

    held = measured.where("segment is not null").select("segment", "counts")
    out = np.zeros((SEGMENTS, size), np.uint16)
    for row in held.repartitionById(SEGMENTS, "segment").mapInArrow(add, "k int, sums binary").collect():
        out[row["k"]] = np.frombuffer(row["sums"], "<u2")
    return out.reshape(-1)


# Column blocks -----------------------------------------------------------------------------------------------------

def first_columns(hashes: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The n-grams of a set that must meet: the first ones by (counter, hash)."""
    at = (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    order = np.argsort(counts[at], kind="stable")  # the hashes are sorted
    return hashes[order[:len(hashes) - needed(len(hashes), threshold) + 1]]


def _entries(n_words: int, threshold: float, shared, n_blocks: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        size = 0

        def flush():
            columns, ids = np.concatenate(held), np.concatenate(rows)
            block = (columns >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)
            order = np.argsort(block, kind="stable")
            columns, ids, block = columns[order], ids[order], block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            which = block[np.r_[0, cuts]].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array([x.tobytes() for x in np.split(columns, cuts)], pa.binary()),
                 pa.array([x.tobytes() for x in np.split(ids, cuts)], pa.binary())], names=["block", "columns", "rows"])

        for part in _slices(parts):
            for text in utf8(part.column(0)):
                hashes = shingles(text or b"", n_words)
                row = row_id(hashes)
                if row is None or row in seen:
                    continue
                seen.add(row)
                first = first_columns(hashes, counts, threshold)
                held.append(first)
                rows.append(np.full(len(first), row, np.int64))
                size += len(first)
                if size >= ENTRIES:
                    yield flush()
                    held, rows, size = [], [], 0
                    seen.clear()
        if size:
            yield flush()

    return run


_MET = pa.schema([("wide", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])


def _multiply(widest: int):
    """Of one task's column blocks: pairs with their overlaps, and the rows of columns with more than ``widest``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, rows = [], []
        for part in parts:
            columns += [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
            rows += [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
        if not columns:
            return
        column, row = np.concatenate(columns), np.concatenate(rows)
        del columns, rows
        order = np.lexsort((row, column))
        column, row = column[order], row[order]
        new = np.r_[True, (column[1:] != column[:-1]) | (row[1:] != row[:-1])]  # copies from other tasks
        column, row = column[new], row[new]
        starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        sizes = np.diff(np.r_[starts, len(column)])
        left, right = [], []
        for m in range(2, widest + 1):
            group = row[starts[sizes == m][:, None] + np.arange(m)]
            a, b = np.triu_indices(m, 1)
            left.append(group[:, a].ravel())
            right.append(group[:, b].ravel())
        pairs, overlap = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0, return_counts=True)
        for low in range(0, len(pairs), 50_000):
            some = pairs[low:low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), pa.int64()), pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(overlap[low:low + 50_000])], schema=_MET)
        wide = np.repeat(sizes > widest, sizes)
        at, who = column[wide].view(np.int64), row[wide]
        for low in range(0, len(at), 50_000):
            some = pa.array(at[low:low + 50_000])
            yield pa.RecordBatch.from_arrays(
                [some, pa.array(who[low:low + 50_000]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], schema=_MET)

    return run


# Full comparisons --------------------------------------------------------------------------------------------------

def similar(overlap, n, m, threshold: float):
    """Whether 100 * intersection >= 100 * threshold * union, in whole numbers."""
    return 100 * overlap >= round(threshold * 100) * (n + m - overlap)


def _compare(threshold: float):
    def run(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([one, two]), kind="stable")
                keep.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(one), len(two), threshold)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    return run


def _spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep together what a boolean matrix of links keeps together: at most one per row and column."""
    out, free_rows, free_columns = [], np.ones(len(left), bool), np.ones(len(right), bool)
    for start in np.flatnonzero(link.any(1)):
        if not free_rows[start]:
            continue
        free_rows[start] = False
        rows = np.array([start])
        while len(rows):
            columns = np.flatnonzero(link[rows].any(0) & free_columns)
            free_columns[columns] = False
            out += [(int(left[start]), int(right[c])) for c in columns]
            rows = np.flatnonzero(link[:, columns].any(1) & free_rows) if len(columns) else columns
            free_rows[rows] = False
            out += [(int(left[start]), int(left[r])) for r in rows]
    return out


def _unpack_rows(raw: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.uint64)


def block_product(one: tuple, two: tuple, threshold: float) -> np.ndarray:
    """Boolean matrix of the links between two row blocks (ids, sizes, hashes row after row), or of one with itself."""
    (_, n, x), (_, m, y) = one, two
    if one is two:
        shared, held = np.unique(x, return_counts=True)
        shared = shared[held > 1]
    else:
        shared = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    overlap = np.zeros((len(n), len(m)), np.float32)

    def chunked(sizes, hashes):
        at = np.searchsorted(shared, hashes)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == hashes[ok]
        row = np.repeat(np.arange(len(sizes)), sizes)[ok]
        order = np.argsort(at[ok], kind="stable")
        return row[order], at[ok][order]

    (row_x, col_x), (row_y, col_y) = chunked(n, x), chunked(m, y)
    for low in range(0, len(shared), COLUMN_CHUNK):
        width = min(COLUMN_CHUNK, len(shared) - low)
        sides = []
        for rows, columns, height in ((row_x, col_x, len(n)), (row_y, col_y, len(m))):
            a, b = np.searchsorted(columns, [low, low + width])
            own, at = np.unique(rows[a:b], return_inverse=True)
            dense = np.zeros((len(own), width), np.float32)
            dense[at, columns[a:b] - low] = 1
            sides.append((own, dense))
        (r, p), (c, q) = sides
        overlap[np.ix_(r, c)] += p @ q.T
    link = np.empty(overlap.shape, bool)
    for low in range(0, len(n), 256):  # whole numbers take twice the room
        some = slice(low, low + 256)
        link[some] = similar(overlap[some].astype(np.int64), n[some, None], m[None, :], threshold)
    if one is two:
        np.fill_diagonal(link, True)
    return link


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BLOCK = "place long, big long, share double, ids binary, sizes binary, hashes binary, columns array<long>"


def _edges(one: tuple, two: tuple, threshold: float) -> Iterator[pa.RecordBatch]:
    link = block_product(one, two, threshold)
    yield from batches(_EDGES, iter([(a, b) for a, b in _spanning(link, one[0], two[0]) if a != b]))


def _cut(parts: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int, key: int | None = None) -> Iterator[list[tuple]]:
    """Rows (row, set, ...) as they come, in lists of at most so many rows and about so many bytes, with one value at ``key``."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        for row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True):
            if held and (len(held) >= most_rows or size >= most_bytes or key is not None and row[key] != held[-1][key]):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield held


def _packed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sets = [np.frombuffer(row[1], np.uint64) for row in held]
    return np.array([row[0] for row in held], np.int64), np.array([len(s) for s in sets], np.int64), np.concatenate(sets)


def _within(threshold: float, most_rows: int, most_bytes: int):
    """Links within blocks of rows that come one after another."""
    def run(parts):
        for held in _cut(parts, most_rows, most_bytes):
            block = _packed(held)
            yield from _edges(block, block, threshold)

    return run


def _row_blocks(most_rows: int, most_bytes: int):
    """Rows (row, set, columns, big) in blocks of one ``big``. ``place`` orders the blocks, ``share`` is the part of a full one."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for held in _cut(parts, most_rows, most_bytes, 3):
            ids, sizes, hashes = _packed(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int64()), pa.array([held[0][3]], pa.int64()),
                 pa.array([max(len(held) / most_rows, hashes.nbytes / most_bytes)], pa.float64()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, hashes)),
                 pa.array([sorted({c for row in held for c in row[2]})], pa.list_(pa.int64()))],
                names=["place", "big", "share", "ids", "sizes", "hashes", "columns"])
            place += 1

    return run


def _filled(blocks: DataFrame) -> DataFrame:
    """Neighbouring blocks that are not full, put together: (block, big, low, high, ids, sizes, hashes, columns).

    ``low`` and ``high`` are the smallest and the largest size of a row.

    Otherwise there would be a block, and its products with others, for every partition.
    """
    # One short row per block.
    before = F.sum("share").over(Window.partitionBy("big").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    group = blocks.select("place", "big", F.floor(F.coalesce(before, F.lit(0.0))).alias("k")).select(
        "place", F.min("place").over(Window.partitionBy("big", "k")).alias("block"))

    def merge(parts):
        held: dict[int, list] = {}
        for part in parts:
            for block, *rest in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                held.setdefault(block, []).append(rest)
        for block, found in held.items():
            found.sort(key=lambda x: x[0])
            sizes = np.concatenate([np.frombuffer(x[3], np.int64) for x in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([found[0][1]], pa.int64()), pa.array([sizes.min()]), pa.array([sizes.max()]),
                 *(pa.array([b"".join(x[k] for x in found)], pa.binary()) for k in (2, 3, 4)),
                 pa.array([sorted({c for x in found for c in x[5]})], pa.list_(pa.int64()))],
                names=["block", "big", "low", "high", "ids", "sizes", "hashes", "columns"])

    n = shuffle_partitions(blocks.sparkSession)
    return blocks.join(group, "place").select("block", "place", "big", "ids", "sizes", "hashes", "columns").repartition(
        n, "block").mapInArrow(merge, "block long, big long, low long, high long, ids binary, sizes binary, hashes binary, columns array<long>")


def _product(threshold: float):
    def run(parts):
        for part in parts:
            for k in range(part.num_rows):
                values = [part.column(c)[k].as_py() for c in range(6)]
                one = _unpack_rows(values[:3])
                two = one if values[0] == values[3] else _unpack_rows(values[3:])
                yield from _edges(one, two, threshold)

    return run


def _meeting(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (block, other) of blocks with a column in common, but not those of one large component or of too different sizes."""
    hundredths = round(threshold * 100)
    columns = blocks.select("block", "big", "low", "high", F.explode("columns").alias("c"))
    others = columns.select(F.col("block").alias("other"), F.col("big").alias("big2"), F.col("low").alias("low2"), F.col("high").alias("high2"), "c")
    return columns.join(others, "c").where(
        f"block <= other and not coalesce(big = big2, false) and 100 * high >= {hundredths} * low2 and 100 * high2 >= {hundredths} * low"
    ).select("block", "other").distinct()


def _components(known: DataFrame, wide: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components (node, component) of the ``known`` links and those among rows that share a wide column."""
    spark = wide.sparkSession
    if wide.isEmpty():
        return components(known, "a", "b")
    held = wide.select(F.col("a").alias("row"), "wide")
    rows = durable(sets.where("wide").select("row", "set").join(held.groupBy("row").agg(F.min("wide").alias("least"), F.max("wide").alias("most")), "row"))

    def n_blocks(of: DataFrame) -> int:
        found = of.agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("size")).first()
        return max(1, -(-found["n"] // ROW_BLOCK), -(-(found["size"] or 0) // BLOCK_BYTES))

    n, near = n_blocks(rows), known
    # Rows of a group are neighbours in both orders, but not the same ones.
    for at, order in ((F.col("least"), F.col("row")), (F.col("most"), F.xxhash64("row"))):
        near = near.unionByName(rows.repartitionByRange(n, at, order).sortWithinPartitions(at, order).select("row", "set").mapInArrow(
            _within(threshold, ROW_BLOCK, BLOCK_BYTES), "a long, b long"))
    parts = durable(components(near, "a", "b"))
    held = held.join(parts, F.col("row") == F.col("node"), "left").select("row", "wide", F.coalesce("component", "row").alias("part"))
    mixed = held.groupBy("wide").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("wide")
    own = durable(held.join(mixed, "wide").groupBy("row").agg(F.collect_set("wide").alias("columns"), F.first("part").alias("part")))
    if own.isEmpty():
        return parts
    # Few: each has as many rows as a block.
    big = own.groupBy("part").count().where(F.col("count") >= ROW_BLOCK).select("part", F.col("part").alias("big"))
    rest = durable(rows.select("row", "set").join(own.join(F.broadcast(big), "part", "left"), "row").select(
        "row", "set", "columns", "big", F.floor(F.log(1 / threshold, F.length("set"))).alias("_size"), F.array_min("columns").alias("_at")))
    blocks = durable(_filled(durable(
        rest.repartitionByRange(n_blocks(rest), "big", "_size", "_at", "row").sortWithinPartitions("big", "_size", "_at", "row")
        .select("row", "set", "columns", "big").mapInArrow(_row_blocks(ROW_BLOCK, BLOCK_BYTES), _BLOCK))))
    other = blocks.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("ids", "sizes", "hashes")])
    pairs = _meeting(blocks, threshold).join(blocks.select("block", "ids", "sizes", "hashes"), "block").join(other, "other")
    links = pairs.select("ids", "sizes", "hashes", "ids2", "sizes2", "hashes2").repartition(
        shuffle_partitions(spark)).mapInArrow(_product(threshold), "a long, b long")
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")


_SETS = pa.schema([("row", pa.int64()), ("wide", pa.bool_()), ("set", pa.binary())])


def _full_sets(docs: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(row, wide, set) of the wanted rows, from the text of one document of each (row, wide, doc_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id").select("row", "wide", "text")

    def run(parts):
        def rows():
            for part in _slices(parts):
                for row, wide, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                    hashes = shingles(text or b"", n_words)
                    if row_id(hashes) == row:  # repeated ids may have other texts
                        yield row, wide, hashes.tobytes()

        yield from batches(_SETS, rows(), 1000)

    return texts.mapInArrow(run, "row long, wide boolean, set binary").dropDuplicates(["row"])


def jaccard_components(docs: DataFrame, n_words: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    Rows link when the Jaccard similarity of their n-gram sets is at least ``threshold`` (whole hundredths);
    ``component_id`` is the smallest doc_id reachable. A null text, or one without words, links with nothing and has its own id.
    Rows with the same doc_id are one document. A row without an id shares the component of numbered copies of it,
    else null, and links nothing further. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = durable(texts.mapInArrow(_measure(n_words), _SIZES))
    shared = spark.sparkContext.broadcast(_counters(measured))
    sizes = measured.where("segment is null").select("doc_id", "n", "row")
    rows = durable(sizes.where("row is not null and doc_id is not null").groupBy("row").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    # Entries a block holds in memory, not a limit of what is joined: more input gives more blocks.
    total = rows.agg(F.sum(F.floor(F.col("n") * (1 - threshold)) + 1)).first()[0] or 0
    n_blocks = max(shuffle_partitions(spark), int(total // (2 * ENTRIES)) + 1)
    numbered = texts.where("doc_id is not null").select("text")
    met = durable(
        numbered.mapInArrow(_entries(n_words, threshold, shared, n_blocks), "block int, columns binary, rows binary")
        .repartitionById(n_blocks, "block").mapInArrow(_multiply(WIDE), "wide long, a long, b long, overlap long"))
    hundredths = round(threshold * 100)
    n, m = F.col("n"), F.col("m")
    least = F.ceil(hundredths * (n + m) / (100 + hundredths))
    # Common n-grams outside of both first parts lie behind the one that ends first.
    rest = F.greatest(F.ceil(n * hundredths / 100) - 1, F.ceil(m * hundredths / 100) - 1)
    pairs = durable(
        met.where("wide is null").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
        .join(rows.select(F.col("row").alias("a"), "n"), "a").join(rows.select(F.col("row").alias("b"), F.col("n").alias("m")), "b")
        .where((100 * F.least(n, m) >= hundredths * F.greatest(n, m)) & (F.col("overlap") + rest >= least)).select("a", "b"))
    wide = met.where("wide is not null").select("wide", "a")
    # The sets of wide rows are few among all: marked, so that only they move again.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row"), F.lit(False).alias("wide")).unionByName(
        wide.select(F.col("a").alias("row"), F.lit(True).alias("wide"))).groupBy("row").agg(F.max("wide").alias("wide"))
    sets = durable(_full_sets(docs, wanted.join(rows.select("row", "doc_id"), "row"), n_words))
    narrow = (
        pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        .mapInArrow(_compare(threshold), "a long, b long"))
    # Several texts under one number are one document.
    numbers = sizes.where("row is not null and doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    links = narrow.unionByName(numbers.where("a <> b").select("a", "b")).unionByName(
        sizes.where("row is not null and doc_id is not null").join(numbers.where("a <> b"), "doc_id").select("a", F.col("row").alias("b")))
    parts = _components(links, wide, sets, threshold)
    joined = rows.join(parts, rows["row"] == parts["node"], "left").select("row", "doc_id", F.coalesce("component", "row").alias("part"))
    least_id = joined.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_row = joined.join(least_id, "part").select("row", "component_id")
    return sizes.join(of_row, "row", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The same rows by comparing all candidates of a label, or of an n-gram, with each other.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
h AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
k AS (SELECT gram, row_number() OVER () AS k FROM h GROUP BY gram HAVING count(*) > 1),
g AS (SELECT h.doc_id, h.n, k.k AS gram FROM h JOIN k USING (gram)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.reached = l.a)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id) AS m USING (doc_id)
"""
