"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tracewright", **options: str) -> SparkSession:
    """A session with the settings that the operators count on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where that is unset, one of this machine."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    if context.applicationId not in _MARKED:  # the application's own folder in it goes when the driver ends
        _MARKED.add(context.applicationId)
        own = spark._jvm.org.apache.hadoop.fs.Path(context._jsc.sc().getCheckpointDir().get())
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)  # only what is there can be marked
    store.deleteOnExit(where)
    return f"{folder}/data"


_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def checkpointed(df: DataFrame, parts: int | None = None, instead_of: Sequence[DataFrame] = ()) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder, in `parts` files at most, read again under a plan of its own.

    Lost executors don't take it along, and its size in the planner is that of its files: DataFrame.checkpoint keeps the estimate of the plan
    that made the rows, which self-joins multiply round after round. The tables of `instead_of`, frames of this function that nothing reads any
    more, are deleted."""
    path = scratch(df.sparkSession, "table")
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    for old in instead_of:
        if gone := _STORED.pop(old, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(gone)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    return out


def broadcast_within(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has `most` rows at most; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
