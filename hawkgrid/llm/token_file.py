"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, one after the other:

* frames: ordinary zstandard frames, each with the ids (little-endian unsigned 32-bit) of one or
  more whole documents, at least ``FRAME_IDS`` ids but for the last one;
* a skippable frame with the document table, compressed: number, whether the number is null, frame,
  first id within the frame and count of ids of each document, column after column;
* a skippable frame with the seek table in the layout of the seekable format: compressed
  size, content size and checksum (low 32 bits of xxh64 of the content) of each frame before it, then
  the count of frames, the descriptor and the closing magic number.

A reader takes the footer, then the two tables, then only the frames with the documents asked for,
and checks each content against its checksum. Any zstandard tool can decompress the whole file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.llm.common import batches, shuffle_partitions
from hawkgrid.llm.memo import Memo
from hawkgrid.session import durable, shared_folder

FRAME_IDS = 1 << 16
END_ID = 2
# Fixed values of the zstandard formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKED = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_MAX_WORDS = 400_000
_BATCH_BYTES = 8 << 20
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
# A capital before a character beyond the Latin letters, which may be a combining mark.
_COMBINED = r"[A-Z][^\x00-\x{24F}]"
_COMBINED_RE = re.compile("[A-Z][^\x00-ɏ]")
# Letters below this one have no combining marks among them.
_LATIN_END = "ɐ"
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on.
_ALPHABET = dict(enumerate(
    [chr(b) if b in _PRINTED else chr(256 + b - sum(p < b for p in _PRINTED)) for b in range(256)]))


#: The pre-tokenizer's pattern (fixed value) that never joins across white space and drops it.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer (its parsed file) gives a text's words the same ids alone as in the text.

    True if its pattern drops white space, its normalisation works on single words, and its added tokens are matched as
    they stand.
    """
    normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normalizer.get("normalizers", [normalizer])
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ")
            for x in steps)
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORD_PATTERN}
        and first.get("behavior") == "Removed" and first.get("invert") is True
        and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())))


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library, without added special tokens.

    Where ``cuts_at_white_space`` holds, a batch of texts is cut at ASCII white space, and only its distinct words are looked up; each is
    encoded once by the library and kept (bounded; rare words go first). ASCII capitals share a word's entry where the
    tokenizer lower-cases. Texts with special tokens are cut at these, too. Other tokenizers, and stretches in which lower-casing would
    make a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.by_word = cuts_at_white_space(json.load(file))
        self.memo = Memo(_MAX_WORDS)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = {t.content: i for i, t in added.items() if t.content}
        self.at_mark = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        upper, lower = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Ab cD", "ab cd"))
        self.fold = upper == lower

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        return [ids[low:high].tobytes() for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after the other, and where each text begins and the last one ends."""
        # A copy: kernels of this library version misread the offsets of sliced texts.
        column = pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")
        if not self.by_word:
            found = self._whole(column.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), _ends([len(x) // 4 for x in found])
        folded = pc.ascii_lower(column) if self.fold else column
        odd = np.zeros(len(column), bool)
        for mark in self.marks:
            odd |= pc.match_substring(folded, mark).to_numpy(zero_copy_only=False)
        if self.fold:
            odd |= pc.match_substring_regex(column, _COMBINED).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(odd).tolist()
        if apart:
            folded = folded.filter(pa.array(~odd))
        lists = pc.ascii_split_whitespace(folded)
        words = lists.flatten().dictionary_encode()
        entries = self.memo.lookup([words.dictionary.to_pylist()], self._learn)[0]
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        starts, flat, at = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), "<u4"), words.indices.to_numpy()
        many = sizes[at]
        after = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(starts[at] - after[:-1], many) + np.arange(after[-1])]
        ends = after[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if not apart:
            return ids, ends
        others = {k: np.frombuffer(self._with_marks(column[k].as_py()), "<u4") for k in apart}
        place = np.cumsum(~odd) - 1
        parts = [others[k] if k in others else ids[ends[at]:ends[at + 1]] for k, at in enumerate(place.tolist())]
        return np.concatenate(parts), _ends([len(x) for x in parts])

    def _with_marks(self, text: str) -> bytes:
        out = []
        for part in self.at_mark.split(text):
            if part in self.marks:
                out.append(struct.pack("<I", self.marks[part]))
                continue
            # A-Z lower-cased, unless a mark may combine with a capital: there are letters that only one case has composed.
            folded = part.encode().lower().decode() if self.fold and not re.search(_COMBINED_RE, part) else part
            if any(mark in folded for mark in self.marks):
                out += self._whole([part])
            elif part:
                out += self.memo.lookup([[w.decode() for w in folded.encode().split()]], self._learn)[0]
        return b"".join(out)

    def _whole(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words. A full stop or comma behind a letter or digit is a piece of its own."""
        current, need, stems = self.memo.current, {}, []
        for w in words:
            stem = w[:-1] if len(w) > 1 and w[-1] in ".," and w[-2].isascii() and w[-2].isalnum() else w
            stems.append(stem)
            if stem not in current:
                need[stem] = b""
        self._encode_words(need)
        stops = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,"}
        held = [current[s] if s in current else need[s] for s in stems]
        return [h if s is w else h + stops[w[-1]] for h, s, w in zip(held, stems, words, strict=True)]

    def _encode_words(self, known: dict[str, bytes], block: int = 20_000) -> None:
        # A word of small Latin letters is one piece of the pattern and normal already: the library's model alone gives its ids.
        model, others = self.tokenizer.model, []
        for w in known:
            if w.isalpha() and w.islower() and max(w) < _LATIN_END and w == w.lower():
                ids = [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_ALPHABET))]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
            elif w:
                others.append(w)
        for low in range(0, len(others), block):
            part = others[low:low + block]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *[len(t) + 1 for t in part[:-1]]])
            begins = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.ids))
            cuts = [*(4 * np.searchsorted(begins, starts)).tolist(), 4 * len(coded.ids)]
            raw = np.array(coded.ids, "<u4").tobytes()
            known.update((w, raw[a:b]) for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))


def _ends(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slabs(part: pa.RecordBatch, column: int, size: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), part.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            yield part.slice(low, high - low)


class FrameWriter:
    """Writes documents one by one; holds at most one frame and the document table."""

    def __init__(self, out, level: int = 1):
        self.out, self.level = out, level
        self.held, self.held_ids, self.entries, self.docs, self.n_ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id or 0, doc_id is None, len(self.entries), self.held_ids, n))
        self.held.append(ids)
        self.held_ids += n
        self.n_ids += n
        if self.held_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            content = b"".join(self.held)
            packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(content)
            self.out.write(packed)
            self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.held, self.held_ids = [], 0

    def close(self) -> None:
        self._flush()
        columns = list(zip(*self.docs, strict=True)) or [()] * 5
        table = struct.pack("<Q", len(self.docs)) + b"".join(
            np.array(c, kind).tobytes() for c, kind in zip(columns, ("<i8", "u1", "<u4", "<u8", "<u8"), strict=True))
        table = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(table)
        index = struct.pack("<II", SKIPPABLE_INDEX, len(table)) + table
        self.out.write(index)
        self.entries.append((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("not a token file")
        self.entries = np.frombuffer(self._at(size - 9 - n * _ENTRY.itemsize, n * _ENTRY.itemsize), _ENTRY)
        ends = np.cumsum(self.entries["packed"].astype(np.int64))
        self.begins = ends - self.entries["packed"]
        raw = self._at(int(self.begins[-1]) + 8, int(self.entries["packed"][-1]) - 8)
        table = zstandard.ZstdDecompressor().decompress(raw)
        (count,) = struct.unpack_from("<Q", table)
        self.columns, at = [], 8
        for kind in ("<i8", "u1", "<u4", "<u8", "<u8"):
            self.columns.append(np.frombuffer(table, kind, count, at))
            at += count * np.dtype(kind).itemsize

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.begins[k]), int(self.entries["packed"][k])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(number, ids before it in this file, ids) of all documents, or of those wanted."""
        before, now, content = 0, -1, b""
        for doc_id, missing, frame, first, n in zip(*(c.tolist() for c in self.columns), strict=True):
            doc = None if missing else doc_id
            if wanted is None or doc in wanted:
                if frame != now and n:
                    now, content = frame, self.frame(frame)
                yield doc, before, content[4 * first:4 * (first + n)] if n else b""
            before += n


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, encoder: Callable = word_encoder,
) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order, one file per range of documents.

    Returns the manifest (shard, path, n_docs, n_ids); a reader opens only files that it names, so a
    repeated task attempt leaves at most an unused file. ``folder`` must be shared by all executors;
    by default it lies in ``spark.checkpoint.dir``. A null text counts as empty and gets the end id
    alone; null ids come last; equal ids are ordered by text. Other columns are ignored; an empty
    table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    end = np.array([end_id], "<u4").tobytes()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, out, path, files = TaskContext.get().partitionId(), None, None, "", None
        done = False
        try:
            for part in parts:
                if not part.num_rows:
                    continue
                if writer is None:
                    path = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.zst"
                    files, local = _open(path)
                    files.create_dir(local.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(local, compression=None)
                    writer, coder = FrameWriter(out), encoder(tokenizer)
                for some in slabs(part, 1):
                    ids, ends = coder.encode_column(some.column(1))
                    for doc_id, low, high in zip(some.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        writer.add(doc_id, ids[low:high].tobytes() + end)
            if writer is not None:
                writer.close()
                done = True
        finally:
            if out is not None:
                out.close()
            if out is not None and not done:
                files.delete_file(local)
        if writer is not None:
            yield from batches(_MANIFEST, iter([(shard, path, len(writer.docs), writer.n_ids)]))

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text"))
    return durable(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"))


def read_token_files(manifest: DataFrame, wanted: set[int] | None = None, ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    One task per file; only frames with wanted documents are decompressed, and each is checked.
    """
    # One row per file, so the running total over files is a small window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def rows(parts):
        for part in parts:
            for path, start in zip(part.column("path").to_pylist(), part.column("start").to_pylist(), strict=True):
                store, local = _open(path)
                with store.open_input_file(local) as source:
                    for doc_id, before_it, code in FrameReader(source).documents(wanted):
                        row = (doc_id, start + before_it, len(code) // 4, zlib.crc32(code))
                        yield row + ((np.frombuffer(code, "<i4"),) if ids else ())

    return files.repartitionById(shuffle_partitions(manifest.sparkSession), "shard").mapInArrow(
        lambda parts: batches(schema, rows(parts), 20_000 if not ids else 500),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
