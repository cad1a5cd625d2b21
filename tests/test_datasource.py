import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import datasource
from tracewright.sources.datasource import Bound, Piece, Range, Records, pieces, read_records, write_records
from tracewright.sources.traces import RECORD


def of_task(task, thread=0):
    return f"X.{task - 1:06d}{thread:06d}.mpit"


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(3000).select(F.format_string("X.%06d%06d.mpit", F.col("id") % 3, F.lit(0)).alias("file"), F.expr("id div 3").alias("seq"), (F.expr("id div 3") * 10).alias("time"), (F.col("id") % 7).cast("int").alias("type"), (F.col("id") * 5).cast("decimal(20)").alias("value"), F.col("id").cast("decimal(20)").alias("param"), F.when(F.col("id") % 2 == 0, F.array(F.col("id"), -F.col("id"))).alias("hwc"), F.lit(4).alias("hwc_set"))
    return r.cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("traces") / "t")
    write_records(rows, path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, rows, folder):
    back = read_records(spark, folder)
    want = rows.select("file", "seq", "time", "type", "value", "param")
    assert back.count() == 3000 and back.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(back.select(want.columns)).isEmpty()
    assert [tuple(r) for r in back.where("task = 1").select("task", "thread", "hwc", "hwc_set").orderBy("seq").limit(2).collect()] == [(1, 1, [0] * 8, 4), (1, 1, [0] * 8, 4)]
    assert back.where("param = 4").first().hwc == [4, -4, *[0] * 6]
    assert not [f for f in os.listdir(folder) if f.startswith("_staging")]


def test_filters_reach_the_source(spark, folder):
    some = read_records(spark, folder).where("task = 2 and time >= 500 and time < 600 and type in (1, 3)")
    assert some.count() == len([i for i in range(3000) if i % 3 == 1 and 50 <= i // 3 < 60 and i % 7 in (1, 3)])
    assert "PushedFilters" in plan(some) and "GreaterThanOrEqual" in plan(some).replace(" ", "") or "time" in plan(some)
    r = datasource.TraceReader(folder, {"path": folder}, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(r.pushFilters([EqualTo(("task",), 2), GreaterThan(("time",), 5), StringContains(("file",), "X"), EqualTo(("value",), 3)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    assert {p.piece.task for p in r.partitions()} == {2}


def test_ordered_ranges_are_searched(folder):
    def read(*bounds):
        own = Records(folder, {"ordered": "true", "batchRecords": "16"}, datasource.TraceSource({}).schema() and _schema(), list(bounds))
        piece = Piece(pieces(folder)[0].path, "X.000000000000.mpit", pieces(folder)[0].bytes, 0)
        with open(piece.path, "rb") as f:
            import pyarrow as pa

            return own.narrowed(pa.PythonFile(f), 0, piece.bytes // RECORD.itemsize)

    n = pieces(folder)[0].bytes // RECORD.itemsize
    assert read(Bound("time", ">=", 95)) == (10, n) and read(Bound("time", ">", 90)) == (10, n)
    assert read(Bound("time", "==", 90)) == (9, 10) and read(Bound("time", "<", 90)) == (0, 9)
    assert read(Bound("time", "<=", 90), Bound("time", ">", 20)) == (3, 10)
    assert read(Bound("time", ">", 10**9))[0] == n and read(Bound("time", "<", 0)) == (0, 0)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(datasource.SCHEMA)


def test_ordered_and_unordered_agree(spark, folder):
    for where in ("time > 100 and time <= 4000", "time = 330", "time < 0", "time >= 9990"):
        a = read_records(spark, folder).where(where).select("file", "seq")
        b = read_records(spark, folder, ordered="true", rangeBytes="2240", batchRecords="7").where(where).select("file", "seq")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_fewer_columns(spark, folder):
    few = read_records(spark, folder, "task int, type int").groupBy("task").agg(F.sum("type").alias("n"))
    assert {r.task: r.n for r in few.collect()} == {t + 1: sum(i % 7 for i in range(t, 3000, 3)) for t in range(3)}


def test_large_file_is_read_in_ranges_and_written_in_pieces(spark, tmp_path):
    path = str(tmp_path / "one")
    one = spark.range(20_000).select(F.lit(of_task(1)).alias("file"), F.col("id").alias("seq"), F.col("id").alias("time"), F.lit(1).alias("type"), F.col("id").cast("decimal(20)").alias("value"), F.lit(0).cast("decimal(20)").alias("param"))
    write_records(one, path)
    assert len(pieces(path)) > 1 and {p.file for p in pieces(path)} == {of_task(1)}  # its pieces were written by several tasks
    back = read_records(spark, path, rangeBytes=str(112 * 1000), batchRecords="100")
    assert back.rdd.getNumPartitions() >= 20
    assert back.where("seq = value").count() == 20_000 and back.agg(F.max("seq")).first()[0] == 19_999
    own = Records(path, {"batchRecords": "100"}, _schema(), [])
    assert max(b.num_rows for b in own.read(Range(pieces(path)[0], 0, 500))) == 100


def test_append_overwrite_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    e = lambda n, at: spark.range(n).select(F.lit(of_task(1)).alias("file"), (F.col("id") + at).alias("seq"), F.col("id").alias("time"), F.lit(1).alias("type"), F.lit(0).cast("decimal(20)").alias("value"), F.lit(0).cast("decimal(20)").alias("param")).coalesce(1)
    write_records(e(5, 0), path)
    write_records(e(7, 5), path)
    assert read_records(spark, path).agg(F.max("seq"), F.count("*")).first()[:] == (11, 12)
    write_records(e(3, 0), path, "overwrite")
    assert read_records(spark, path).count() == 3
    bad = e(4, 0).withColumn("file", F.when(F.col("time") == 2, "a/b").otherwise(F.col("file")))
    with pytest.raises(Exception, match="order of file names"):
        write_records(bad, path)
    assert read_records(spark, path).count() == 3 and all(f.startswith((of_task(1), ".")) for f in os.listdir(path))


def test_broken_and_missing_files(spark, tmp_path):
    (tmp_path / of_task(1)).write_bytes(b"x" * 113)
    with pytest.raises(Exception, match="whole number"):
        read_records(spark, str(tmp_path)).count()
    assert read_records(spark, str(tmp_path / "none")).count() == 0


def records(n, first=0):
    r = np.zeros(n, RECORD)
    r["time"] = r["value"] = np.arange(first, first + n)
    return r.tobytes()


def test_stream_follows_growing_files_and_restarts(spark, tmp_path):
    path, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    path.mkdir()
    datasource.register(spark)

    def run():
        stream = spark.readStream.format("trace").schema("file string, task int, seq long, time long").load(str(path))
        stream.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("task", "seq", "time").collect()))

    (path / of_task(1)).write_bytes(records(10) + b"part of a record")
    assert run() == [(1, i, i) for i in range(10)]
    (path / of_task(1)).write_bytes(records(15))
    (path / of_task(2)).write_bytes(records(4, 100))
    assert run() == [(1, i, i) for i in range(15)] + [(2, i, 100 + i) for i in range(4)]
    assert run() == [(1, i, i) for i in range(15)] + [(2, i, 100 + i) for i in range(4)]


def test_stream_into_trace_files(spark, rows, tmp_path):
    source, path = str(tmp_path / "rows"), str(tmp_path / "traces")
    rows.select("file", "seq", "time", "type", "value", "param").coalesce(1).sortWithinPartitions("file", "seq").write.parquet(source)
    datasource.register(spark)
    stream = spark.readStream.schema("file string, seq long, time long, type int, value decimal(20), param decimal(20)").parquet(source)
    stream.writeStream.format("trace").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    back = read_records(spark, path)
    assert back.count() == 3000 and back.agg(F.sum("value")).first()[0] == sum(5 * i for i in range(3000))
