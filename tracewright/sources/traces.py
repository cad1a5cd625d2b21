"""Trace files: the binary event records of tracers, manifests, symbols, and the text formats of merged traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record: a union of parameters, value, time, 8 counters, type and counter set. Fixed values of the format.
RECORD = np.dtype({"names": ["p0", "p1", "value", "time", "hwc", "type", "hwc_set"], "formats": ["<u8", "<u8", "<u8", "<u8", ("<i8", 8), "<i4", "<i4"], "offsets": [0, 8, 24, 32, 40, 104, 108], "itemsize": 112})
EVENTS = "file string, seq long, time long, type int, value decimal(20), param decimal(20), target int, size int, tag int, comm int, aux long, hwc array<long>, hwc_set int"


def read_binary(spark: SparkSession, path: str, piece: int = 65_536) -> DataFrame:
    """Events of tracer files (EVENTS). A file whose size isn't a whole number of records is an error.

    The parameter union is read both ways: as one number, and as a message's target, size, tag, communicator and aux (from byte 16).
    Files are read whole by Spark's binaryFile and decoded piece by piece."""

    return decode_binary(spark.read.format("binaryFile").load(path).select("path", "content"), piece)


def encode_binary(events: DataFrame) -> DataFrame:
    """S7's counterpart: (path, content), a file's records of events (file, seq, time, type, value, param), in order of seq."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        out = np.zeros(len(rows), RECORD)
        for name, column in (("p0", "param"), ("value", "value"), ("time", "time"), ("type", "type")):
            out[name] = rows[column].to_numpy()
        return pd.DataFrame({"path": [key[0]], "content": [out.tobytes()]})

    return events.groupBy("file").applyInPandas(group, "path string, content binary")


def decode_binary(files: DataFrame, piece: int = 65_536) -> DataFrame:
    """Events (EVENTS) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for b in batches:
            for path, content in b[["path", "content"]].itertuples(index=False):
                if len(content) % RECORD.itemsize:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole number of {RECORD.itemsize}-byte records")
                for at in range(0, len(content) // RECORD.itemsize, piece):
                    raw = content[at * RECORD.itemsize : (at + piece) * RECORD.itemsize]
                    r = np.frombuffer(raw, RECORD)
                    ints = np.ndarray((len(r), 4), "<i4", raw, 0, (RECORD.itemsize, 4))
                    aux = np.ndarray(len(r), "<i8", raw, 16, (RECORD.itemsize,))
                    yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "seq": np.arange(at, at + len(r)), "time": r["time"].astype(np.int64), "type": r["type"], "value": [Decimal(int(x)) for x in r["value"]], "param": [Decimal(int(x)) for x in r["p0"]], "target": ints[:, 0], "size": ints[:, 1], "tag": ints[:, 2], "comm": ints[:, 3], "aux": aux, "hwc": list(r["hwc"]), "hwc_set": r["hwc_set"]})

    return files.select("path", "content").mapInPandas(run, EVENTS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, ptask, task, thread) of lines `FILE on NODE named NAME`; names end in digits of process and thread."""
    rows = spark.read.text(path)
    file = F.regexp_extract("value", r"^(\S+)", 1)
    digits = F.regexp_extract("value", r"(\d{6})(\d{6})\.\w+(?:\s|$)", 0)
    return rows.where("trim(value) <> '' and not startswith(value, '--')").select(file.alias("file"), F.regexp_extract("value", r"\son\s+(\S+)", 1).alias("node"), F.lit(1).alias("ptask"), (F.regexp_extract(digits, r"^(\d{6})", 1).try_cast("int") + 1).alias("task"), (F.regexp_extract(digits, r"^\d{6}(\d{6})", 1).try_cast("int") + 1).alias("thread"))


def read_spawns(spark: SparkSession, path: str) -> DataFrame:
    """(app, task, comm, target_app) of lines with these four numbers."""
    parts = F.split(F.trim("value"), r"[\s:]+")
    rows = spark.read.text(path).where("value rlike '^\\\\s*[0-9]+[\\\\s:]+[0-9]+[\\\\s:]+[0-9]+[\\\\s:]+[0-9]+'")
    return rows.select(*[F.get(parts, F.lit(i)).cast("int").alias(c) for i, c in enumerate(("app", "task", "comm", "target_app"))])


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, text) of symbol lines: a letter, an id or address, a quoted text."""
    rows = spark.read.text(path)
    pattern = r'^(\w)\s+(\S+)\s+"([^"]*)"'
    return rows.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("kind"), F.regexp_extract("value", pattern, 2).alias("id"), F.regexp_extract("value", pattern, 3).alias("text"))


def union_buffers(*buffers: DataFrame) -> DataFrame:
    """Trace, sample and online buffers as one, in time order by a range sort."""
    out = buffers[0]
    for b in buffers[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.orderBy("time")


def record_lines(records: DataFrame) -> DataFrame:
    """(time, rtype, value): the text line of each state (1), event (2, with pairs) or message (3) record."""
    place = ["cpu", "ptask", "task", "thread"]
    text = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    pairs = F.array_join(F.flatten(F.transform("pairs", lambda x: F.array(x["type"].cast("string"), x["value"].cast("string")))), ":")
    line = F.when(F.col("rtype") == 1, F.concat_ws(":", F.lit("1"), text(*place, "time", "end_time", "value"))).when(F.col("rtype") == 2, F.concat_ws(":", F.lit("2"), text(*place, "time"), pairs))
    line = line.otherwise(F.concat_ws(":", F.lit("3"), text(*place, "time", "end_time", "cpu_r", "ptask_r", "task_r", "thread_r", "log_r", "phy_r", "event", "value")))
    return records.select("time", "rtype", line.alias("value"))


def trace_header(magic: str, duration: int, nodes: list[int], tasks: list[list[tuple[int, int]]], date: str) -> str:
    """The first line: the format's magic word, date, length in ns, processors of each node, and the (threads, node) of each application's tasks."""
    apps = ":".join(f"{len(a)}({','.join(f'{t}:{n}' for t, n in a)})" for a in tasks)
    return f"#{magic} ({date}):{duration}_ns:{len(nodes)}({','.join(map(str, nodes))}):{len(tasks)}:{apps}"


def write_trace(records: DataFrame, path: str, gzip: bool = False) -> None:
    """Record lines in O2's order over range-partitioned files (their names in order); the header is a line of its own file's making."""
    lines = record_lines(records)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = lines.repartitionByRange(n, "time", F.desc("rtype")).sortWithinPartitions("time", F.desc("rtype")).select("value")
    out.write.option("compression", "gzip" if gzip else "none").text(path)


def labels_used(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(type, label) of the types that occur."""
    used = records.where("rtype = 2").select(F.explode("pairs").alias("p")).select(F.col("p.type").alias("type")).distinct()
    return used.join(labels, "type", "left").select("type", F.coalesce("label", F.concat(F.lit("Unknown type "), F.col("type").cast("string"))).alias("label"))


def row_names(objects: DataFrame) -> DataFrame:
    """(level, ord, value): names of processors, tasks and threads, each once."""
    cpu = objects.select(F.lit("CPU").alias("level"), F.col("cpu").cast("long").alias("ord"), F.concat_ws(".", F.col("cpu").cast("string"), "node").alias("value"))
    task = objects.select(F.lit("TASK"), (F.col("ptask") * 1_000_000 + F.col("task")).cast("long"), F.concat_ws(".", F.concat(F.lit("TASK "), F.col("ptask").cast("string")), F.col("task").cast("string")))
    thread = objects.select(F.lit("THREAD"), ((F.col("ptask") * 1_000_000 + F.col("task")) * 1000 + F.col("thread")).cast("long"), F.concat_ws(".", F.concat(F.lit("THREAD "), F.col("ptask").cast("string")), F.col("task").cast("string"), F.col("thread").cast("string")))
    return cpu.union(task).union(thread).distinct()


def simulator_lines(events: DataFrame) -> DataFrame:
    """(file_idx, seq, value): computation bursts, sends, receives, collective calls and point events of each task for a simulator."""
    text = F.when(F.col("kind") == "burst", F.format_string("1:%d:%d:%.9f", "task", "thread", F.col("dur") / 1e9))
    text = text.when(F.col("kind") == "send", F.format_string("2:%d:%d:%d:%d:%d:%d", "task", "thread", "partner", "size", "tag", "comm"))
    text = text.when(F.col("kind") == "recv", F.format_string("3:%d:%d:%d:%d:%d:%d", "task", "thread", "partner", "size", "tag", "comm"))
    text = text.when(F.col("kind") == "global", F.format_string("10:%d:%d:%d:%d:%d", "task", "thread", "type", "comm", "size"))
    return events.select("file_idx", "seq", text.otherwise(F.format_string("20:%d:%d:%d:%d", "task", "thread", "type", "value")).alias("value"))


def simulator_order(lines: DataFrame) -> DataFrame:
    """O3: simulator lines with their place: file by file, in each file's own order; no merge by time."""
    from tracewright.operators.trace import global_rank

    return global_rank(lines, ["file_idx", "seq"], "place")


def dump(events: DataFrame, with_time: bool = True) -> DataFrame:
    """(file, seq, value): a line for each event."""
    what = F.concat_ws(" ", F.concat(F.lit("EV: "), F.col("type").cast("string")), F.concat(F.lit("VAL: "), F.col("value").cast("string")), F.concat(F.lit("PARAM: "), F.col("param").cast("string")))
    return events.select("file", "seq", F.concat_ws(" ", F.concat(F.lit("TIME: "), F.col("time").cast("string")), what).alias("value") if with_time else what.alias("value"))
