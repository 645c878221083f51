"""A topic on a shared folder: an ordered log of immutable segments, as a Spark data source for batches and streams.

``spark.read.format("segment_topic")`` and ``readStream`` give (key, value, t_us); ``write`` and ``writeStream`` append rows with these
columns. Layout below the folder of option ``path``:

* ``segments/*.parquet``: rows, written by tasks;
* ``log/<number>.json``: one entry per committed write, with the names of its segments, its newest time and, for streams,
  the writer and its batch. Entries are the topic's offsets.

A segment counts from the moment its entry is there, so failed tasks and aborted writes leave nothing that is read. A stream that
repeats a batch after a restart finds the entry of its ``writer`` and batch and adds nothing. Any number of readers may follow;
at any time one writer may commit. A batch read and each micro-batch have one task per segment; nothing goes through the driver but
the log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition,
    WriterCommitMessage)

SCHEMA = "key string, value string, t_us long"
_ARROW = pa.schema([("key", pa.string()), ("value", pa.string()), ("t_us", pa.int64())])
_START = -1


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class TopicLog:
    """The ordered entries of a topic."""

    def __init__(self, path: str):
        self.files, root = _store(path.rstrip("/"))
        self.log, self.segments = f"{root}/log", f"{root}/segments"

    def numbers(self) -> list[int]:
        found = self.files.get_file_info(pafs.FileSelector(self.log, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and f.size)

    def entry(self, number: int) -> dict:
        with self.files.open_input_stream(f"{self.log}/{number:020d}.json") as file:
            return json.loads(file.read())

    def names(self, after: int = _START, upto: int | None = None) -> list[str]:
        """Segments of the entries after one and up to another."""
        wanted = [n for n in self.numbers() if n > after and (upto is None or n <= upto)]
        return [name for n in wanted for name in self.entry(n)["segments"]]

    def append(self, entry: dict) -> None:
        numbers = self.numbers()
        if entry["batch"] is not None and any(
                (e["writer"], e["batch"]) == (entry["writer"], entry["batch"]) for e in map(self.entry, reversed(numbers))):
            self.drop(entry["segments"])
            return
        self.files.create_dir(self.log, recursive=True)
        number = numbers[-1] + 1 if numbers else 0
        draft = f"{self.log}/draft-{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as file:
            file.write(json.dumps(entry).encode())
        # The entry appears whole.
        self.files.move(draft, f"{self.log}/{number:020d}.json")

    def drop(self, segments: list[str]) -> None:
        for name in segments:
            self.files.delete_file(f"{self.segments}/{name}")

    def write_segment(self, parts: Iterator[pa.RecordBatch]) -> Segment:
        """One segment with the rows of a task, batch by batch; none without rows."""
        name, writer, newest = f"{uuid.uuid4().hex}.parquet", None, None
        for part in parts:
            rows = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)).cast(f.type) for f in _ARROW], schema=_ARROW)
            if not rows.num_rows:
                continue
            if writer is None:
                self.files.create_dir(self.segments, recursive=True)
                writer = pq.ParquetWriter(f"{self.segments}/{name}", _ARROW, filesystem=self.files, compression="zstd")
            writer.write_batch(rows)
            newest = max((t for t in (newest, pc.max(rows.column(2)).as_py()) if t is not None), default=None)
        if writer is None:
            return Segment(None, None)
        writer.close()
        return Segment(name, newest)

    def read_segment(self, name: str) -> Iterator[pa.RecordBatch]:
        yield from pq.ParquetFile(f"{self.segments}/{name}", filesystem=self.files).iter_batches(10_000)

    def expire(self, before_us: int) -> int:
        """Remove entries whose rows are all older; returns how many. The newest entry stays, so that numbers go on."""
        gone = 0
        for number in self.numbers()[:-1]:
            entry = self.entry(number)
            if entry["newest"] is not None and entry["newest"] >= before_us:
                continue
            # The entry goes first: a segment without one is not read.
            self.files.delete_file(f"{self.log}/{number:020d}.json")
            self.drop(entry["segments"])
            gone += 1
        return gone


@dataclass
class Segment(WriterCommitMessage):
    name: str | None
    newest: int | None


@dataclass
class _SegmentPart(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_SegmentPart(n) for n in TopicLog(self.path).names()]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        # A topic without entries has one partition without a segment.
        if partition is not None:
            yield from TopicLog(self.path).read_segment(partition.name)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"entry": _START}

    def latestOffset(self) -> dict:
        numbers = TopicLog(self.path).numbers()
        return {"entry": numbers[-1] if numbers else _START}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_SegmentPart(n) for n in TopicLog(self.path).names(start["entry"], end["entry"])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from TopicLog(self.path).read_segment(partition.name)


def _commit(path: str, messages: list[Segment | None], writer: str, batch: int | None) -> None:
    done = [m for m in messages if m is not None and m.name is not None]
    TopicLog(path).append({
        "segments": [m.name for m in done], "newest": max((m.newest for m in done if m.newest is not None), default=None),
        "writer": writer, "batch": batch})


def _abort(path: str, messages: list[Segment | None]) -> None:
    TopicLog(path).drop([m.name for m in messages if m is not None and m.name is not None])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        return TopicLog(self.path).write_segment(iterator)

    def commit(self, messages) -> None:
        _commit(self.path, messages, "batch", None)

    def abort(self, messages) -> None:
        _abort(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        return TopicLog(self.path).write_segment(iterator)

    def commit(self, messages, batchId: int) -> None:
        _commit(self.path, messages, self.writer, batchId)

    def abort(self, messages, batchId: int) -> None:
        _abort(self.path, messages)


class SegmentTopic(DataSource):
    """Options: ``path``, a folder that all executors share; ``writer``, the name of a writing stream (its batches count once)."""

    @classmethod
    def name(cls) -> str:
        return "segment_topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"])

    def streamWriter(self, schema, overwrite: bool):
        return _StreamWriter(self.options["path"], self.options.get("writer", "stream"))


def read_topic(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """key, value, t_us of a topic: all of it, or as a stream from its first entry on."""
    spark.dataSource.register(SegmentTopic)
    return (spark.readStream if stream else spark.read).format("segment_topic").option("path", path).load()


def write_topic(rows: DataFrame, path: str) -> None:
    """Append rows (key, value, t_us) as one entry."""
    rows.sparkSession.dataSource.register(SegmentTopic)
    rows.select("key", "value", "t_us").write.format("segment_topic").option("path", path).mode("append").save()


def start_topic_sink(rows: DataFrame, path: str, checkpoint: str, writer: str, every: str | None = None):
    """Append a stream of rows (key, value, t_us); each batch is one entry, once."""
    rows.sparkSession.dataSource.register(SegmentTopic)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        rows.select("key", "value", "t_us").writeStream.format("segment_topic").option("path", path).option("writer", writer)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start())
