"""Two tokenizers' tokens of a corpus aligned by byte offsets, with corpus-wide counts of linked id pairs.

Equal texts meet in a shuffle by full text and are tokenised once; a text's pairs count as often as it occurs.

1. Each task aligns its texts. Neither tokenizer joins a space with the character before it (unless that is white space
   itself), so a text falls into units that begin with a space, and each distinct unit is tokenised and cut into
   groups once per worker.
2. Texts leave as blocks of a few megabytes: one row with the block's distinct id pairs, the documents that hold each
   of them, and per text its measures and its pairs as places in the block's list. Pairs are thus added up
   before they are shuffled.
3. Pair counts are summed over blocks with map-side combine, and each A id gets its highest count (bounded by
   the vocabulary).
4. Every block receives the counts of its own pairs and turns them into measures of its texts, and these are joined to
   the documents by the text's digest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkgrid.llm.common import utf8
from hawkgrid.session import durable

BLOCK_BYTES = 16 << 20
SLAB_BYTES = 2 << 20
_MAX_UNITS = 500_000
# Units with more pairs of tokens than this keep their pairs with counts.
_NARROW = 4096
_SPACE = "▁"
#: White space as the tokenizers' patterns see it (fixed values: the Unicode property).
_WHITE = r"\t-\r \x85\xa0  -     　"
# A unit starts at a space that follows no white space; the first one at the start of the text.
_UNITS = re.compile(rf"(?<=[^{_WHITE}])(?= )")
_ODD = re.compile(rf"^ |[{_WHITE}] ")
#: The pattern of byte-level vocabularies (fixed value), for the engine below.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Byte-level tokens of the tokenizers library; special tokens' strings in a text are plain text.

    Where ids follow the order of merges, short units are encoded by the tiktoken library from the same
    file's vocabulary: it merges the lowest rank first, as the merge list does, and is much faster on single words.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        kind, model = raw.get("pre_tokenizer") or {}, raw["model"]
        # Units are safe for the plain byte-level pattern only.
        self.units = (kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
                      and raw.get("normalizer") is None)
        back = byte_alphabet()
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        made = [model["vocab"].get(m, -1) for m in merges]
        self.fast = None
        if self.units and made == list(range(256, 256 + len(made))) and not model.get("ignore_merges"):
            ranks = {self.bytes[i]: i for i in range(256 + len(made))}
            self.fast = tiktoken.Encoding("byte level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, which already starts with its space."""
        if self.fast is not None and self.units:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """Pieces of the sentencepiece library, which puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes = [
            bytes((int(t[3:5], 16),)) if p.is_byte(i) else t.replace(_SPACE, " ").encode() for i, t in enumerate(pieces)]
        # Units are safe if no piece has the mark behind another character and spaces are kept as they are.
        self.space = [] if p.is_unknown(p.piece_to_id(_SPACE)) else [p.piece_to_id(_SPACE)]
        self.units = bool(self.space) and not any(_SPACE in t.lstrip(_SPACE) for t in pieces) and (
            p.decode(p.encode("  a  b ")) == "  a  b ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.processor.encode([t[1:] for t in texts], num_threads=1)
        # The library puts no space before an empty text.
        return [ids or self.space for ids in found]


class Aligner:
    """Aligns units of texts and keeps what it found, column by column, by the unit's place."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.width = len(self.b.bytes)
        self.units = self.a.units and self.b.units
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.top = max(len(self.a.bytes), self.width)
        # Decimal ids with what follows them: another of the same side, the other side, another group, nothing.
        self.words = [f"{i}{end}".encode() for end in (",", "|", ";", "") for i in range(self.top)]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: n_a, n_b, n_groups, n_links (-1: bytes differ), first and number of its codes.
        self.facts = np.zeros((0, 6), np.int64)
        self.met = np.zeros(0, np.int64)
        #: Pair codes of all links of narrow units, one after the other; wide units have (codes, links) aside.
        self.codes = np.zeros(0, np.int64)
        self.wide: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(self, text: str) -> list[str]:
        """Units without their leading space."""
        if not self.units:
            return [text]
        if _ODD.search(text):
            return [u[1:] for u in _UNITS.split(" " + text)]
        return text.split(" ")

    def places(self, units: list[list[str]]) -> np.ndarray:
        """The place of every unit of the texts, in order; unknown ones are learned first."""
        if len(self.groups) > _MAX_UNITS:
            self._shrink()
        new = list(set(chain.from_iterable(units)).difference(self.place))
        for low in range(0, len(new), 50_000):
            self._learn(new[low:low + 50_000])
        out = np.fromiter(map(self.place.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        self.met += np.bincount(out, minlength=len(self.met))
        return out

    def _shrink(self) -> None:
        """Keep units met more than once since they came or were last kept; none if that is not enough."""
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > _MAX_UNITS or self.wide:
            self._clear()
            return
        facts, codes, groups = self.facts[keep], self.codes, self.groups
        place = np.full(len(groups), -1)
        place[keep] = np.arange(len(keep))
        self.place = {u: int(place[k]) for u, k in self.place.items() if place[k] >= 0}
        self.groups = [groups[k] for k in keep.tolist()]
        first, many = facts[:, 4].copy(), facts[:, 5]
        facts[:, 4] = np.cumsum(many) - many
        self.codes = codes[_spread(first, many)]
        self.facts, self.met = facts, np.zeros(len(keep), np.int64)

    def _learn(self, units: list[str]) -> None:
        spaced = [" " + u for u in units]
        a_lists, b_lists = self.a.encode(spaced), self.b.encode(spaced)
        same = self._same(a_lists, b_lists, spaced)
        base = len(self.groups)
        self.place.update(zip(units, range(base, base + len(units)), strict=True))
        narrow = [k for k, ok in enumerate(same) if ok and len(a_lists[k]) * len(b_lists[k]) <= _NARROW]
        facts = np.zeros((len(units), 6), np.int64)
        facts[:, 3] = -1
        groups = [b""] * len(units)
        if narrow:
            found, texts, codes = self._align([a_lists[k] for k in narrow], [b_lists[k] for k in narrow])
            found[:, 4] += len(self.codes)
            facts[narrow] = found
            for k, text in zip(narrow, texts, strict=True):
                groups[k] = text
            self.codes = np.concatenate([self.codes, codes])
        for k in sorted(set(np.flatnonzero(same).tolist()).difference(narrow)):
            found, texts, pairs = self._align([a_lists[k]], [b_lists[k]], wide=True)
            facts[k], groups[k] = found[0], texts[0]
            self.wide[base + k] = pairs
        self.groups += groups
        self.facts = np.concatenate([self.facts, facts])
        self.met = np.append(self.met, np.zeros(len(units), np.int64))

    def _same(self, a_lists, b_lists, units: list[str]) -> list[bool]:
        """Whether both token lists give back the unit's bytes."""
        a_of, b_of = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        raw = "".join(units).encode()
        size_a = [sum(map(len, map(a_of, x))) for x in a_lists] if len(units) == 1 else None
        if size_a is None and all(a_lists) and b"".join(map(a_of, chain.from_iterable(a_lists))) == raw == b"".join(
                map(b_of, chain.from_iterable(b_lists))):
            # The whole is the same; the cuts between units are, too, if lengths agree.
            sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
            if all(np.array_equal(np.add.reduceat(size[np.fromiter(chain.from_iterable(x), np.int64)], _starts(x)), sizes)
                   for x, size in ((a_lists, self.size_a), (b_lists, self.size_b))):
                return [True] * len(units)
        return [bool(x) and b"".join(map(a_of, x)) == (raw := u.encode()) and b"".join(map(b_of, y)) == raw
                for x, y, u in zip(a_lists, b_lists, units, strict=True)]

    def _align(self, a_lists: list[list[int]], b_lists: list[list[int]], wide: bool = False):
        """Facts, groups and codes of many units at once, as if they were one text: all tokens end where a unit ends."""
        len_a, len_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_lists, len_a), (b_lists, len_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a_ids]), np.cumsum(self.size_b[b_ids])
        cuts = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        last_a, last_b = np.cumsum(len_a) - 1, np.cumsum(len_b) - 1
        n_groups = np.diff(group_a[last_a] + 1, prepend=0)
        links = np.add.reduceat(n_a * n_b, np.cumsum(n_groups) - n_groups)
        # Decimal ids, A before B in each group, with what follows each of them.
        after_a = np.zeros(len(a_ids), np.int64)
        after_a[before_a + n_a - 1] = 1
        after_b = np.zeros(len(b_ids), np.int64)
        after_b[before_b + n_b - 1] = 2
        after_b[last_b] = 3
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + before_b[group_a]] = after_a * self.top + a_ids
        order[np.arange(len(b_ids)) + (before_a + n_a)[group_b]] = after_b * self.top + b_ids
        words, ends = list(map(self.words.__getitem__, order.tolist())), np.cumsum(len_a + len_b).tolist()
        texts = [b"".join(words[low:high]) for low, high in zip([0, *ends[:-1]], ends, strict=True)]
        facts = np.stack([len_a, len_b, n_groups, links, np.cumsum(links) - links, links], axis=1)
        if wide:
            facts[:, 4:] = 0
            return facts, texts, self._distinct_pairs(group_a, a_ids, group_b, b_ids, len(cuts))
        many = n_b[group_a]
        return facts, texts, np.repeat(a_ids, many) * self.width + b_ids[_spread(before_b[group_a], many)]

    def _distinct_pairs(self, group_a, a_ids, group_b, b_ids, n_groups) -> tuple[np.ndarray, np.ndarray]:
        """Pair codes in order and their links, from the distinct ids on either side of each group."""
        def distinct(group, ids, size):
            keys, n = np.unique(group * size + ids, return_counts=True)
            return keys // size, keys % size, n

        ga, ia, na = distinct(group_a, a_ids, len(self.a.bytes))
        gb, ib, nb = distinct(group_b, b_ids, self.width)
        first_b = np.searchsorted(gb, np.arange(n_groups + 1))
        many = np.diff(first_b)[ga]
        total, parts, low = np.cumsum(many), [], 0
        # Each A id against the distinct B ids of its group, some millions at a time.
        while low < len(many):
            done = total[low - 1] if low else 0
            high = max(int(np.searchsorted(total, done + 4_000_000, "right")), low + 1)
            m = many[low:high]
            row, b = np.repeat(np.arange(low, high), m), _spread(first_b[ga[low:high]], m)
            parts.append(_sum_equal(ia[row] * self.width + ib[b], na[row] * nb[b]))
            low = high
        if len(parts) == 1:
            return parts[0]
        return _sum_equal(np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]))


def _starts(lists: list[list]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.cumsum(sizes) - sizes


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many[k]`` numbers from ``first[k]`` on, one run after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _sum_equal(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their ``n``."""
    found, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, place, n)
    return found, out


def _count_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK = pa.schema([
    ("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("holds", pa.list_(pa.int64())), ("digests", pa.binary()),
    ("groups", pa.binary()), ("measures", pa.binary()), ("entries", pa.binary()), ("places", pa.binary()), ("links", pa.binary())])
_BLOCK_DDL = ("block long, pairs array<long>, holds array<long>, digests binary, groups binary, measures binary, entries binary, "
              "places binary, links binary")


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Block:
    """Aligned texts of a few megabytes; pairs are kept once per text."""

    def __init__(self):
        self.size, self.n = 0, 0
        self.digests, self.groups, self.copies, self.measures = [], [], [], []
        self.entries, self.codes, self.links = [], [], []

    def add(self, al: Aligner, texts: list[bytes], copies: list[int]) -> None:
        """One slab of texts; those whose bytes differ are left out."""
        self.size += sum(map(len, texts))
        units = [al.split(t.decode()) for t in texts]
        ids = al.places(units)
        sizes = np.array([len(us) for us in units], np.int64)
        starts = np.cumsum(sizes) - sizes
        good = np.minimum.reduceat(al.facts[ids, 3], starts) >= 0
        if not good.all():
            ids = ids[np.repeat(good, sizes)]
            sizes = sizes[good]
            starts = np.cumsum(sizes) - sizes
        n = len(sizes)
        if not n:
            return
        names, at = list(map(al.groups.__getitem__, ids.tolist())), starts.tolist()
        self.groups += [hashlib.sha256(b";".join(names[low:high])).digest() for low, high in zip(at, [*at[1:], len(ids)], strict=True)]
        self.digests += [hashlib.sha256(t).digest() for t, ok in zip(texts, good.tolist(), strict=True) if ok]
        self.copies += [c for c, ok in zip(copies, good.tolist(), strict=True) if ok]
        facts = al.facts[ids]
        self.measures.append(np.add.reduceat(facts[:, :4], starts))
        # Pairs of each text from the pairs of its units; a key is (text, pair).
        size = len(al.a.bytes) * al.width
        text = np.repeat(np.arange(n), sizes)
        many = facts[:, 5]
        key, links = _count_equal(np.repeat(text, many) * size + al.codes[_spread(facts[:, 4], many)])
        wide = [k for k in set(ids.tolist()) if k in al.wide] if al.wide else []
        if wide:
            keys, counts = [key], [links]
            for k in wide:
                codes, m = al.wide[k]
                for t in text[ids == k].tolist():
                    keys.append(t * size + codes)
                    counts.append(m)
            key, links = _sum_equal(np.concatenate(keys), np.concatenate(counts))
        self.entries.append(np.bincount(key // size, minlength=n))
        self.codes.append(key % size)
        self.links.append(links)
        self.n += n

    def row(self, number: int) -> pa.RecordBatch:
        entries, codes = np.concatenate(self.entries), np.concatenate(self.codes)
        pairs, places = np.unique(codes, return_inverse=True)
        holds = np.zeros(len(pairs), np.int64)
        np.add.at(holds, places, np.repeat(np.array(self.copies, np.int64), entries))
        # Within a text places ascend: gaps are small numbers.
        gaps = np.diff(places, prepend=0)
        first = (np.cumsum(entries) - entries)[entries > 0]
        gaps[first] = places[first]
        values = [
            [number], [pairs], [holds], [b"".join(self.digests)], [b"".join(self.groups)], [_pack(np.concatenate(self.measures).astype("<i8"))],
            [_pack(entries.astype("<i8"))], [_pack(gaps.astype("<u4"))], [_pack(np.concatenate(self.links).astype("<i8"))]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def align_blocks(texts: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned texts from distinct texts (text, copies)."""

    def run(parts):
        al, block, number = aligner(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
        for part in parts:
            raw, copies = utf8(part.column(0)), part.column(1).to_pylist()
            low = size = 0
            for high, text in enumerate(raw, 1):
                size += len(text)
                if size >= SLAB_BYTES or high == len(raw):
                    block.add(al, raw[low:high], copies[low:high])
                    low, size = high, 0
                    if block.size >= block_bytes:
                        if block.n:
                            yield block.row(number)
                        block, number = _Block(), number + 1
        if block.n:
            yield block.row(number)

    return texts.select("text", "copies").mapInArrow(run, _BLOCK_DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count: the documents corpus-wide that hold the id pair linked (copies of a text count each)."""
    return blocks.select(F.explode(F.arrays_zip("pairs", "holds")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.holds").alias("count"))


_OUT = pa.schema([("digest", pa.binary()), *[(m, pa.int64()) for m in _MEASURES], ("n_best", pa.int64()), ("count_sum", pa.int64()),
                  ("groups_sha256", pa.string())])


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k in range(part.num_rows):
            row = {name: part.column(name)[k] for name in part.schema.names}
            counts = row["counts"].values.to_numpy(zero_copy_only=False)
            best = row["best"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            entries, gaps, links = (_unpack(row[c].as_py(), kind) for c, kind in (("entries", "<i8"), ("places", "<u4"), ("links", "<i8")))
            starts = np.cumsum(entries) - entries
            running = np.cumsum(gaps.astype(np.int64))
            places = running - np.repeat(running[starts] - gaps[starts], entries)
            measures = _unpack(row["measures"].as_py(), "<i8").reshape(-1, 4)
            digests, groups = row["digests"].as_py(), row["groups"].as_py()
            size = range(0, len(digests), 32)
            yield pa.RecordBatch.from_arrays([
                pa.array([digests[i:i + 32] for i in size], pa.binary()), *[pa.array(measures[:, m]) for m in range(4)],
                pa.array(np.add.reduceat(best[places] * links, starts)), pa.array(np.add.reduceat(counts[places] * links, starts)),
                pa.array([groups[i:i + 32].hex() for i in size], pa.string())], schema=_OUT)


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary, B a model of pieces; paths that every executor has. Both read a space and
    the whole text. Byte offsets where tokens of both end cut the tokens into groups; every A-B pair of occurrences in a group is a link;
    a pair's count is the number of documents that hold it linked. Texts that are null, empty, or that one of the
    two does not give back byte by byte have zeros and an empty ``groups_sha256``. Rows with the same text, and repeated rows,
    count once each and have the same measures. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    blocks = durable(align_blocks(texts, a_path, b_path, block_bytes))
    counts = durable(pair_counts(blocks))
    width = _piece_count(b_path)
    by_a = F.expr(f"pair div {width}")
    # One row per id of A at most.
    top = counts.groupBy(by_a.alias("a")).agg(F.max("count").alias("top"))
    scored = counts.withColumn("a", by_a).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = (
        blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(scored, "pair")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "count", "best"))).alias("x"))
        .select("block", F.col("x.count").alias("counts"), F.col("x.best").alias("best")))
    measured = blocks.drop("pairs", "holds").join(answers, "block").mapInArrow(
        _measure, "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    numbers = [*_MEASURES, "n_best", "count_sum"]
    return rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).join(measured, "digest", "left").select(
        "doc_id", *[F.coalesce(F.col(m), F.lit(0).cast("long")).alias(m) for m in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
