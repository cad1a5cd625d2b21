"""Streams whose state outlives a restart, against the same analysis of the whole as a batch."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.streaming import signals, state

pytest.importorskip("google.protobuf")


def turns(spark, tmp_path, batches, schema, make):
    """The rows of a stream that gets these batches, each after a restart from the checkpoint."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_ring_buffer_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), t, t, rng.random() < 0.15) for t in range(120)]
    schema = "task string, time long, seq long, flush boolean"
    got = turns(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], schema, lambda s: state.stream_ring(s, "task", 4))
    want = state.ring(spark.createDataFrame(rows, schema), "task", 4)
    brute, held = [], {"a": [], "b": []}
    for task, _, seq, flush in rows:
        if flush:
            brute += [(task, seq, i, s) for i, s in enumerate(held[task])]
            held[task] = []
        else:
            held[task] = [*held[task], seq][-4:]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(brute)


def test_keys_of_a_bucket_share_a_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([*range(30), None]), t, t, rng.random() < 0.2) for t in range(400)]
    schema = "task long, time long, seq long, flush boolean"
    got = turns(spark, tmp_path, [rows[:150], rows[150:151], rows[151:]], schema, lambda s: state.stream_ring(s, "task", 3, buckets=4))
    want = state.ring(spark.createDataFrame(rows, schema), "task", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_phases_are_closed_by_timers_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    at = sorted(rng.sample(range(1, 30_000), 40))
    late = [(k, t) for t in at for k in ("x", "y") if rng.random() < 0.5]
    for i in range(0, len(late) - 1, 3):  # some come after newer ones, within the bound
        late[i], late[i + 1] = late[i + 1], late[i]
    batches = [late[:25], late[25:30], late[30:], [("x", 60_000), ("y", 60_000)]]
    schema = "task string, ts timestamp"
    stamped = [spark.createDataFrame(b, "task string, ms long").select("task", F.timestamp_millis("ms").alias("ts")).collect() for b in batches]
    got = turns(spark, tmp_path, stamped, schema, lambda s: state.stream_phases(s, "task", 0, 45_000, 1_500, "10 seconds"))
    hits = spark.createDataFrame([r for b in batches for r in b], "task string, time long")
    want = signals.phase_schedule(hits, "task", 0, 45_000, 1_500)
    told = sorted(map(tuple, got.collect()))
    assert told == sorted(tuple(r) for r in want.where("t1 <= 50000").collect()) and len(told) > 20


def test_sessions_with_late_rows_over_restarts(spark, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "task string, s long").select("task", F.timestamp_seconds("s").alias("ts")).collect()
    batches = [[("a", 0), ("a", 30), ("b", 10)], [("a", 85), ("a", 60)], [("b", 20), ("a", 400)], [("a", 5000), ("b", 5000)]]
    schema = "task string, ts timestamp"
    got = turns(spark, tmp_path, [at(b) for b in batches], schema, lambda s: state.sessions(s, ["task"], "40 seconds", "2 minutes"))
    batch = state.sessions(spark.createDataFrame([r for b in batches for r in at(b)], schema), ["task"], "40 seconds")
    want = sorted(tuple(r) for r in batch.collect() if r.ended <= 4_880_000_000)
    # b's row at 20 s came when the newest was 85 s, within two minutes, so it extends the session at 10 s
    assert sorted(map(tuple, got.collect())) == want and ("b", 10_000_000, 60_000_000, 2) in want and ("a", 0, 125_000_000, 4) in want
