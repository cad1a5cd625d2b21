"""Online analysis whose state outlives a restart: processors of transformWithState, in RocksDB state stores under the query's checkpoint.

use_state_store() sets the session's state store; a query that is started again from its checkpoint goes on where it stopped."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class RingBuffer(StatefulProcessor):
    """The newest `most` events of each of a bucket's keys; a flush gives out its key's, oldest first, and forgets them. A bucket's events are one state."""

    def __init__(self, key: str, kind: str, most: int):
        self.key, self.kind, self.most = key, kind, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", f"keys array<{self.kind}>, times array<long>, seqs array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict = {}
        if self.newest.exists():  # what is held comes before the batch
            for own, *event in zip(*self.newest.get(), strict=True):
                held.setdefault(own, []).append(event)
        out = []
        new = pd.concat(list(rows)).sort_values(["time", "seq"])
        for own, time, seq, flush in zip(*(new[c].tolist() for c in (self.key, "time", "seq", "flush")), strict=True):
            if flush:
                out += [(own, seq, place, s) for place, (_, s) in enumerate(held.pop(own, ()))]
            else:
                newest = held.setdefault(own, [])
                newest.append((time, seq))
                del newest[: -self.most]
        if held:
            self.newest.update(tuple(map(list, zip(*((own, *event) for own, newest in held.items() for event in newest), strict=True))))
        elif self.newest.exists():
            self.newest.clear()
        yield pd.DataFrame(out, columns=[self.key, "flush_seq", "place", "seq"])

    def close(self) -> None:
        pass


#: How many states the keys of a stream of rings are dealt over; a checkpoint holds for one number.
BUCKETS = 512


def stream_ring(events: DataFrame, key: str, most: int, buckets: int = BUCKETS) -> DataFrame:
    """T9 on a stream of events (key, time, seq, flush): (key, flush_seq, place, seq), the newest events at each flush, since the one before. Events of one
    micro-batch are taken by time and seq, batches as they come; a task holds the rows of a batch and the state of one bucket of keys, as a call and a state for
    each key cost far more than its rows. Events without a key belong to none."""
    use_state_store(events.sparkSession)
    kind = kind_of(events, key)
    rows = events.where(F.col(key).isNotNull()).select(F.pmod(F.hash(key), F.lit(buckets)).alias("_bucket"), key, "time", "seq", "flush")
    return rows.groupBy("_bucket").transformWithStateInPandas(RingBuffer(key, kind, most), f"{key} {kind}, flush_seq long, place long, seq long", "Append", "None")


def ring(events: DataFrame, key: str, most: int) -> DataFrame:
    """T9 on a batch."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("time", "seq")
    part = F.coalesce(F.sum(F.col("flush").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.select(key, "time", "seq", "flush").withColumn("_part", part)
    flushes = rows.where("flush").select(key, "_part", F.col("seq").alias("flush_seq"))
    newest = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.desc("time"), F.desc("seq")))
    kept = rows.where("not flush").withColumn("_back", newest).where(F.col("_back") <= most)
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.desc("_back"))) - 1
    return kept.withColumn("place", place.cast("long")).join(flushes, [key, "_part"]).select(key, "flush_seq", "place", "seq")


class PhaseClock(StatefulProcessor):
    """A key's analyses, one after the other; an interval is closed by a timer when the watermark has passed its end, so all its hits are in."""

    def __init__(self, key: str, first: float, until: float, frequency: float):
        self.key, self.first, self.until, self.frequency = key, first, until, frequency

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "t double, frequency double, k long")
        self.hits = handle.getListState("hits", "time long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            self.clock.update((self.first, self.frequency, 0))
            self.handle.registerTimer(math.ceil(self.first + self.frequency))
        t, _, _ = self.clock.get()
        for b in rows:
            if t < self.until and (own := [(int(x),) for x in b["time"] if x > t]):
                self.hits.appendList(own)
        yield pd.DataFrame({self.key: pd.Series([], dtype="object")}).reindex(columns=[self.key, "k", "t0", "t1", "found"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        t, f, k = self.clock.get()
        times = sorted(x for (x,) in self.hits.get()) if self.hits.exists() else []
        out = []
        while t < self.until and t + f <= now:
            found = any(t < x <= t + f for x in times)
            out.append((key[0], k, t, t + f, found))
            t, f, k = t + f, f if found else 1.5 * f, k + 1
        self.clock.update((t, f, k))
        if left := [(x,) for x in times if x > t and t < self.until]:
            self.hits.put(left)
        elif self.hits.exists():
            self.hits.clear()
        if t < self.until:
            self.handle.registerTimer(math.ceil(t + f))
        yield pd.DataFrame(out, columns=[self.key, "k", "t0", "t1", "found"])

    def close(self) -> None:
        pass


def stream_phases(hits: DataFrame, key: str, first: float, until: float, frequency: float, late: str = "10 seconds") -> DataFrame:
    """T1 on a stream of hits (key, ts): signals.phase_schedule's rows (times in ms), each as soon as the watermark has passed its end. A hit that is later than
    `late` behind the newest counts if its interval is still open."""
    use_state_store(hits.sparkSession)
    rows = hits.withWatermark("ts", late).select(key, "ts", F.unix_millis("ts").alias("time"))
    return rows.groupBy(key).transformWithStateInPandas(PhaseClock(key, float(first), float(until), float(frequency)), f"{key} {kind_of(hits, key)}, k long, t0 double, t1 double, found boolean", "Append", "EventTime")


def sessions(events: DataFrame, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(keys, began, ended, n) of runs of events (keys, ts) with no longer gap between them; on a stream, late events extend and join sessions until the
    watermark has passed their end."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.unix_micros("session_window.start").alias("began"), F.unix_micros("session_window.end").alias("ended"), "n")
