"""EDF recordings: data records are dealt to tasks in blocks, and Python decodes 16-bit samples to physical values.

``read_edf`` reads folders, ``spark.read.format("edf")`` too (after ``register``), with options that narrow what is read, and
``read_edf_ranges`` reads the stretches that a table names.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, channel string, channel_no int, sample_index long, t double, value double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_UNITS = {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3, "v": 1.0}

#: Files above this many bytes are read by ranges, in blocks of data records of about so many bytes.
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20

#: Ranges that can hold a sample.
HOLDS = "start <= stop and stop >= 0 and start < double('infinity')"

Header = tuple[int, int, float, list[dict]]


def header(raw: memoryview) -> Header:
    """(header bytes, data records, seconds a record, signals) of a recording."""
    text = lambda a, n: bytes(raw[a : a + n]).decode("latin-1").strip()
    size, records, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    signals: list[dict] = [{} for _ in range(n)]
    at = 256
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        for s in signals:
            s[name] = text(at, width)
            at += width
    return size, records, seconds, signals


def record_bytes(head: Header) -> int:
    return 2 * sum(int(s["samples"]) for s in head[3])


def blocks(head: Header, length: int, start: float, stop: float, block_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive data records that touch the time range, about block_bytes each or one record.

    Only records that a file of this length holds in full count, so one that was cut short gives what it has.
    """
    size, records, seconds, _ = head
    width = record_bytes(head)
    held = max(0, length - size) // width if width else 0
    records = held if records < 0 else min(records, held)
    first = min(records, max(0, int(start // seconds))) if seconds > 0 else 0
    end = min(records, int(stop // seconds) + 1) if seconds > 0 and stop != float("inf") else records
    step = max(1, block_bytes // width) if width else 1
    for at in range(first, end, step):
        yield at, min(end, at + step)


def decode(head: Header, raw: memoryview, first: int, start: float = 0.0, stop: float = float("inf"), channels: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A batch without file_path for each signal of the data records in raw, the first of which has that number.

    Samples lie from start to stop included, values are in volts. Annotation signals are passed over, and where
    ``channels`` are given all signals with other labels.
    """
    _, _, seconds, signals = head
    counts = [int(s["samples"]) for s in signals]
    data = np.frombuffer(raw, "<i2").reshape(-1, sum(counts))
    offset = 0
    for no, (s, n) in enumerate(zip(signals, counts)):
        own = data[:, offset : offset + n].ravel()
        offset += n
        if s["label"].upper().startswith("EDF ANNOTATIONS") or not n or (channels is not None and s["label"] not in channels):
            continue
        low, high, d_low, d_high = (float(s[k]) for k in ("low", "high", "digital_low", "digital_high"))
        gain = (high - low) / (d_high - d_low) if d_high != d_low else 1.0
        index = np.arange(len(own), dtype=np.int64) + first * n
        t = index * (seconds / n)
        keep = (t >= start) & (t <= stop)
        index, t, own = index[keep], t[keep], own[keep]
        values = ((own - d_low) * gain + low) * _UNITS.get(s["unit"].lower(), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([s["label"]] * len(t), pa.string()), pa.array(np.full(len(t), no, np.int32)), pa.array(index), pa.array(t), pa.array(values)], names=NAMES[1:])


def opened(path: str) -> pa.NativeFile:
    """A file by its URI in any store that pyarrow opens."""
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inside)


def _header_of(file: pa.NativeFile) -> Header:
    size = int(file.read_at(8, 184).decode("latin-1"))
    return header(memoryview(file.read_at(size, 0)))


def _named(name: str, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in found:
        yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), *b.columns], names=NAMES)


def _records(file: pa.NativeFile, head: Header, first: int, end: int) -> memoryview:
    return memoryview(file.read_at((end - first) * record_bytes(head), head[0] + first * record_bytes(head)))


def read_edf(
    spark: SparkSession, path: str, start: float = 0.0, stop: float = float("inf"), split_bytes: int = SPLIT_BYTES, block_bytes: int = BLOCK_BYTES, partitions: int | None = None
) -> DataFrame:
    """Long form of all EDF files below ``path``; give a time range to decode only its data records.

    Files up to ``split_bytes`` come whole through Spark's binaryFile, so from any store that Spark reads. Larger ones are
    listed without their content, and their blocks are dealt over ``partitions`` tasks (spark.sql.shuffle.partitions
    where it is None) that read byte ranges; their store must be one that pyarrow opens. No task holds more than one
    block decoded. Files without records or signals give no rows.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = memoryview(b.column(1)[i].as_buffer())
                head = header(raw)
                for first, end in blocks(head, len(raw), start, stop, block_bytes):
                    part = raw[head[0] + first * record_bytes(head) : head[0] + end * record_bytes(head)]
                    yield from _named(b.column(0)[i].as_py(), decode(head, part, first, start, stop))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(name) as file:
                    own = list(blocks(_header_of(file), length, start, stop, block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array([f for f, _ in own], pa.int64()), pa.array([e for _, e in own], pa.int64())], names=["path", "first", "end"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, end in zip(*(c.to_pylist() for c in b.columns)):
                with opened(name) as file:
                    head = _header_of(file)
                    raw = _records(file, head, first, end)
                yield from _named(name, decode(head, raw, first, start, stop))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.edf").load(path)
    small = files.where(F.col("length") <= split_bytes).select("path", "content").mapInArrow(whole, SCHEMA)
    large = files.where(F.col("length") > split_bytes).select("path", "length").mapInArrow(listed, "path string, first long, end long")
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return small.unionByName(large.repartition(tasks, "path", "first").mapInArrow(ranges, SCHEMA))


def read_edf_ranges(spark: SparkSession, ranges: DataFrame, block_bytes: int = BLOCK_BYTES, partitions: int | None = None) -> DataFrame:
    """(range_start, range_stop, file_path, channel, ...): the samples of each row (file_path, start, stop) of ``ranges``, both ends included.

    A task opens a file, reads its header and the data records that its stretch touches, and nothing else, so ten
    seconds of a long recording cost ten seconds. Rows of ``ranges`` are dealt over tasks by their stretch, and long ones
    by blocks. Each row is answered by itself, so stretches may overlap and repeat; rows with a null are passed over.
    file_path stays as it was given, so that results join back. Stores must be ones that pyarrow opens.
    """
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                with opened(name) as file:
                    own = list(blocks(_header_of(file), file.size(), max(0.0, start), stop, block_bytes))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([start] * n, pa.float64()), pa.array([stop] * n, pa.float64()), pa.array([f for f, _ in own], pa.int64()), pa.array([e for _, e in own], pa.int64())],
                    names=["path", "start", "stop", "first", "end"],
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop, first, end in zip(*(c.to_pylist() for c in b.columns)):
                with opened(name) as file:
                    head = _header_of(file)
                    raw = _records(file, head, first, end)
                for found in _named(name, decode(head, raw, first, start, stop)):
                    ends = [pa.array(np.full(found.num_rows, x)) for x in (start, stop)]
                    yield pa.RecordBatch.from_arrays([*ends, *found.columns], names=["range_start", "range_stop", *NAMES])

    asked = ranges.select("file_path", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")).dropna().where(HOLDS)
    dealt = asked.repartition(tasks, "file_path", "start", "stop").mapInArrow(listed, "path string, start double, stop double, first long, end long")
    return dealt.repartition(tasks, "path", "first", "start").mapInArrow(read, f"range_start double, range_stop double, {SCHEMA}")


class Share(InputPartition):
    """Byte ranges (path, length, from, to) of files; a data record belongs to the range in which its first byte lies."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        super().__init__(0)
        self.parts = parts


class EdfReader(DataSourceReader):
    """Files are listed and cut by bytes while planning; headers and records are read in the tasks.

    What is read is narrowed by options. Spark can hand filters to a Python reader, but keeps what they left of it with
    the loaded DataFrame, so that the next query on that DataFrame lost rows (Spark 4.1.2); so no filter is taken.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.split_bytes = int(options.get("splitBytes", 128 << 20))
        self.block_bytes = int(options.get("blockBytes", BLOCK_BYTES))
        self.start, self.stop = float(options.get("start", 0.0)), float(options.get("stop", "inf"))
        names = options.get("channels")
        self.channels = None if names is None else frozenset(n.strip() for n in names.split(","))

    def partitions(self) -> list[Share]:
        store, inside = fs.FileSystem.from_uri(quote(self.path, safe=":/@"))
        if store.get_file_info(inside).type == fs.FileType.File:
            found = [store.get_file_info(inside)]
        else:
            found = [i for i in store.get_file_info(fs.FileSelector(inside, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".edf")]
        if not self.path.endswith(inside):
            raise ValueError(f"a path without options is needed, not {self.path}")
        prefix = self.path[: len(self.path) - len(inside)]
        shares, own, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            for at in range(0, i.size, self.split_bytes):
                part = min(self.split_bytes, i.size - at)
                if own and size + part > self.split_bytes:
                    shares.append(Share(own))
                    own, size = [], 0
                own.append((prefix + i.path, i.size, at, at + part))
                size += part
        return [*shares, Share(own)] if own else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not self.start <= self.stop or self.stop < 0 or self.start == float("inf"):
            return
        for path, length, low, high in partition.parts:
            with opened(path) as file:
                head = _header_of(file)
                width = record_bytes(head)
                if not width:
                    continue
                mine = [max(0, -((head[0] - x) // width)) if x < length else None for x in (low, high)]
                for first, end in blocks(head, length, max(0.0, self.start), self.stop, self.block_bytes):
                    first = max(first, mine[0])
                    end = end if mine[1] is None else min(end, mine[1])
                    if first < end:
                        yield from _named(path, decode(head, _records(file, head, first, end), first, self.start, self.stop, self.channels))


class EdfSource(DataSource):
    """``spark.read.format("edf").load(path)``: the rows of ``read_edf``, from a store that pyarrow opens.

    Options: channels, labels as the files have them with commas between; start and stop, seconds, both included;
    splitBytes, the bytes of files a task takes (128 MB); blockBytes, the bytes decoded at a time (4 MB). Of a time
    range only the data records that it touches are read.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format "edf" known to the session."""
    spark.dataSource.register(EdfSource)
