"""Tracer files as a data source of Spark, in batches and streams: format("trace").

Reading plans byte ranges of whole records, so that one file is read by many tasks, each a few thousand records at a time. Filters on file, task
and thread choose files by their names before anything is opened; filters on time and type are applied to records before they become rows, and with the
option ordered=true (records of a file ascend in time, as tracers write them) a range is searched for the first and last record that
time allows, so that the others are never read. A schema of fewer columns decodes only these.

Writing is in two phases: tasks write pieces beside the data, under names that only the commit makes visible; a task that failed or ran
twice leaves nothing behind. A file may span tasks: its pieces are named FILE.pBATCH-PART and read back as one file, with running seq.

Options: path; rangeBytes (16 MB, what one task reads of a file), batchRecords (65536), ordered (false). Paths are those of Arrow's file
systems (local, hdfs, s3, gcs ...). Filters reach the source where the session has spark.sql.python.filterPushdown.enabled, which register() sets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.sources.traces import RECORD

SCHEMA = "file string, task int, thread int, seq long, time long, type int, value decimal(20), param decimal(20), target int, size int, tag int, comm int, aux long, hwc array<long>, hwc_set int"
SIZE = RECORD.itemsize
PIECE = re.compile(r"(.+)\.p(\d+)-(\d+)$")
PLACE = re.compile(r"(\d{6})(\d{6})\.\w+$")  # digits of process and thread, from 0

BY_NAME = ("file", "task", "thread")
COMPARED = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "known"}


@dataclass(frozen=True)
class Bound:
    """A filter that the source applies."""

    column: str
    how: str
    value: object = None

    def holds(self, x):
        """Of a value or an array of them."""
        if self.how == "known":
            return x is not None
        if x is None:
            return False
        if self.how == "in":
            return np.isin(x, list(self.value)) if isinstance(x, np.ndarray) else x in self.value
        return {"==": x == self.value, ">": x > self.value, ">=": x >= self.value, "<": x < self.value, "<=": x <= self.value}[self.how] if self.how == "==" else {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[self.how](x, self.value)


@dataclass(frozen=True)
class Piece:
    """A data file: records `first` and on of the tracer file that it is a piece of."""

    path: str
    file: str
    bytes: int
    first: int

    @property
    def task(self) -> int | None:
        return int(m[1]) + 1 if (m := PLACE.search(self.file)) else None

    @property
    def thread(self) -> int | None:
        return int(m[2]) + 1 if (m := PLACE.search(self.file)) else None


@dataclass
class Range(InputPartition):
    """Records from `start` up to `end` of a piece."""

    piece: Piece
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def pieces(path: str) -> list[Piece]:
    """The data files in a folder, or a file alone; those of one tracer file in the order of their batches and parts."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    named = []
    for f in found:
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
            m = PIECE.match(f.base_name)
            named.append((m[1] if m else f.base_name, (int(m[2]), int(m[3])) if m else (-1, -1), f))
    out, at_record = [], {}
    for file, _, f in sorted(named, key=lambda x: x[:2]):
        out.append(Piece(f.path, file, f.size, at_record.get(file, 0)))
        at_record[file] = at_record.get(file, 0) + f.size // SIZE
    return out


class Records:
    """How ranges of records become batches of rows."""

    def __init__(self, path: str, options: dict, schema: StructType, bounds: list[Bound]):
        self.path, self.schema, self.bounds = path, schema, bounds
        options = {k.lower(): v for k, v in options.items()}
        self.range_records = max(1, int(options.get("rangebytes", 16 << 20)) // SIZE)
        self.batch_records = max(1, int(options.get("batchrecords", 65_536)))
        self.ordered = str(options.get("ordered", "false")).lower() == "true"

    def wanted(self, piece: Piece) -> bool:
        return all(b.holds(getattr(piece, b.column)) for b in self.bounds if b.column in BY_NAME)

    def ranges(self, piece: Piece, start: int = 0, end: int | None = None) -> Iterator[Range]:
        end = piece.bytes // SIZE if end is None else end
        for at in range(start, end, self.range_records):
            yield Range(piece, at, min(end, at + self.range_records))

    def narrowed(self, data, start: int, end: int) -> tuple[int, int]:
        """The part of ordered records whose time may hold, found by bisection."""

        def first(holds) -> int:
            low, high = start, end
            while low < high:
                mid = (low + high) // 2
                if holds(int(np.frombuffer(data.read_at(8, mid * SIZE + 32), "<u8")[0])):
                    high = mid
                else:
                    low = mid + 1
            return low

        for b in self.bounds:
            if b.column == "time" and start < end:
                if b.how in (">", ">=", "=="):
                    start = first(lambda t, b=b: t > b.value if b.how == ">" else t >= b.value)
                if b.how in ("<", "<=", "==") and start < end:
                    end = first(lambda t, b=b: t >= b.value if b.how == "<" else t > b.value)
        return start, end

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        kinds = to_arrow_schema(self.schema)
        with store.open_input_file(part.piece.path) as data:
            start, end = self.narrowed(data, part.start, part.end) if self.ordered else (part.start, part.end)
            for at in range(start, end, self.batch_records):
                n = min(end, at + self.batch_records) - at
                raw = data.read_at(n * SIZE, at * SIZE)
                r, seq = np.frombuffer(raw, RECORD), np.arange(at, at + n) + part.piece.first
                ints, aux = np.ndarray((n, 4), "<i4", raw, 0, (SIZE, 4)), np.ndarray(n, "<i8", raw, 16, (SIZE,))
                columns = {"seq": seq, "time": r["time"].astype(np.int64), "type": r["type"], "value": r["value"], "param": r["p0"], "target": ints[:, 0], "size": ints[:, 1], "tag": ints[:, 2], "comm": ints[:, 3], "aux": aux, "hwc_set": r["hwc_set"]}
                keep = np.ones(n, bool)
                for b in self.bounds:
                    if b.column in columns and b.how != "known":
                        keep &= b.holds(columns[b.column])
                some = int(keep.sum())

                def column(f: pa.Field) -> pa.Array:
                    if f.name in BY_NAME:
                        return pa.array([getattr(part.piece, f.name)] * some, f.type)
                    if f.name == "hwc":
                        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(r["hwc"][keep]).ravel()), 8).cast(f.type)
                    return pa.array(np.ascontiguousarray(columns[f.name][keep])).cast(f.type)

                if some:
                    yield pa.RecordBatch.from_arrays([column(f) for f in kinds], schema=kinds)


class TraceReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: StructType):
        self.path, self.options, self.schema, self.bounds = path, options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in COMPARED and name in (*BY_NAME, "time", "type", "seq"):
                self.bounds.append(Bound(name, COMPARED[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def records(self) -> Records:
        return Records(self.path, self.options, self.schema, self.bounds)

    def partitions(self) -> list[Range]:
        own = self.records()
        found = pieces(self.path)
        for p in found:
            if p.bytes % SIZE:
                raise ValueError(f"{p.path}: {p.bytes} bytes are no whole number of {SIZE}-byte records")
        return [r for p in found if own.wanted(p) for r in own.ranges(p)] or [Range(Piece("", "", 0, 0), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.records().read(partition) if partition.end else iter(())


class TraceStreamReader(DataSourceStreamReader):
    """Files that come and grow; the offset is how many bytes of each have been read, whole records only."""

    def __init__(self, path: str, options: dict, schema: StructType):
        self.path, self.own = path, Records(path, options, schema, [])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p.path: p.bytes - p.bytes % SIZE for p in pieces(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known = {p.path: p for p in pieces(self.path)}
        return [r for path, to in end.items() if to > start.get(path, 0) for r in self.own.ranges(known[path], start.get(path, 0) // SIZE, to // SIZE)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.own.read(partition)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (tracer file, staged path), in order; part: the task's place."""

    part: int = 0
    files: list[tuple[str, str]] = field(default_factory=list)


class Pieces:
    """How tasks stage pieces and the driver makes them visible."""

    def __init__(self, path: str, staging: str):
        self.path, self.staging = path, staging

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, at = opened(self.path)
        folder = f"{at}/{self.staging}/{context.taskAttemptId()}"
        out, stream, now = Written(context.partitionId(), []), None, None
        try:
            for b in batches:
                files = b.column(b.schema.get_field_index("file")).to_pylist()
                records = encoded(b)
                start = 0
                for i in range(1, len(files) + 1):
                    if i == len(files) or files[i] != files[start]:
                        if files[start] != now:
                            if stream:
                                stream.close()
                            now = files[start]
                            if now is None or "/" in now or now in (f for f, _ in out.files):
                                raise ValueError(f"rows must be in order of file names: {now!r}")
                            store.create_dir(folder)
                            out.files.append((now, f"{folder}/{len(out.files)}"))
                            stream = store.open_output_stream(out.files[-1][1])
                        stream.write(records[start:i].tobytes())
                        start = i
        finally:
            if stream:
                stream.close()
        return out

    def publish(self, messages: list[Written | None], batch: int | None) -> None:
        """Renames staged pieces; batch: None for the plain name of a file in one piece, where nothing has it."""
        store, at = opened(self.path)
        of: dict[str, list[tuple[int, str]]] = {}
        for m in messages:
            for file, staged in m.files if m else ():
                of.setdefault(file, []).append((m.part, staged))
        there = pieces(self.path)
        latest = {p.file: max(int(m[2]) if (m := PIECE.match(p.path.rsplit("/", 1)[-1])) else -1, -1) for p in there}
        for file, found in of.items():
            number = batch if batch is not None else latest.get(file, -1) + 1
            plain = batch is None and len(found) == 1 and file not in latest
            for part, staged in found:
                store.move(staged, f"{at}/{file}" if plain else f"{at}/{file}.p{number:05d}-{part:05d}")
        self.clear()

    def clear(self) -> None:
        store, at = opened(self.path)
        if store.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.staging}")


def encoded(batch: pa.RecordBatch) -> np.ndarray:
    """Records of rows (file, time, type, value; param or target, size, tag, comm and aux; hwc, hwc_set)."""
    out = np.zeros(batch.num_rows, RECORD)
    names = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}

    def numbers(name: str, kind: pa.DataType) -> np.ndarray:
        return np.asarray(pc.fill_null(names[name].cast(kind), pa.scalar(0, kind)))

    for to, column, kind in (("value", "value", pa.uint64()), ("time", "time", pa.int64()), ("type", "type", pa.int32()), ("hwc_set", "hwc_set", pa.int32())):
        if column in names:
            out[to] = numbers(column, kind)
    if "param" in names:
        out["p0"] = numbers("param", pa.uint64())
    raw = out.view(np.uint8).reshape(len(out), SIZE)
    for i, column in enumerate(("target", "size", "tag", "comm")):
        if column in names and ("param" not in names or i > 1):
            raw[:, 4 * i : 4 * i + 4] = numbers(column, pa.int32()).astype("<i4").view(np.uint8).reshape(-1, 4)
    if "aux" in names:
        raw[:, 16:24] = numbers("aux", pa.int64()).astype("<i8").view(np.uint8).reshape(-1, 8)
    if "hwc" in names:
        for i, counters in enumerate(names["hwc"].to_pylist()):
            for j, v in enumerate((counters or [])[:8]):
                out["hwc"][i, j] = v or 0
    return out


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.pieces = Pieces(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.pieces.write(iterator)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            store, _ = opened(self.path)
            for p in pieces(self.path):
                store.delete_file(p.path)
        self.pieces.publish(messages, None)

    def abort(self, messages: list) -> None:
        self.pieces.clear()


class TraceStreamWriter(DataSourceStreamArrowWriter):
    """A batch that is committed again gives the same names, so its pieces are there once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.pieces.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.pieces.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.pieces.clear()


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(self.options["path"], dict(self.options), schema)

    def streamReader(self, schema: StructType) -> TraceStreamReader:
        return TraceStreamReader(self.options["path"], dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TraceStreamWriter:
        return TraceStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes format("trace") known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def write_records(events: DataFrame, path: str, mode: str = "append") -> None:
    """Events (file, seq, time, type, value, param ...) as tracer files, each in order of seq; a large file spans tasks."""
    register(events.sparkSession)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.repartitionByRange(parts, "file", "seq").sortWithinPartitions("file", "seq")
    rows.write.format("trace").mode(mode).save(path)


def read_records(spark: SparkSession, path: str, columns: str | None = None, **options: str) -> DataFrame:
    """Tracer files' events; columns: a schema of fewer columns than SCHEMA."""
    register(spark)
    reader = spark.read.format("trace").options(**options)
    return (reader.schema(columns) if columns else reader).load(path)
