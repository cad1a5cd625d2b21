"""Relational core of trace merging. A trace is a DataFrame of events (task, thread, time, seq, type, value ...);
every operator takes column names, so any table with an order in each task can be one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.exprs import floor_div
from tracewright.operators.matching import ANY_TAG, match_wildcard  # noqa: F401
from tracewright.operators.stacks import stacked_types, state_intervals  # noqa: F401
from tracewright.session import broadcast_within, checkpointed

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


# order ------------------------------------------------------------------------------------------------------------


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """df with its place (from 1) in a total order, without sending all rows to one task: rows are range-partitioned,
    ranked within their range, and the ranges' counts added up. Equal order keys share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    base = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(*RUNNING)) - F.col("_n")).alias("_base"))
    ranked = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return ranked.join(F.broadcast(base), "_range").withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_range", "_base", "_own")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the sum of `value` up to and with each row of its key in this order, without sending a key's rows to one task: rows are
    range-partitioned, summed within their range, and the sums of the key's earlier ranges added. Rows with equal order are told apart at will."""
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", *keys).agg(F.sum(value).alias("_s"))  # a row for each range and each key in it
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", *keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = ranged.withColumn("_own", F.sum(value).over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(*RUNNING)))
    return own.join(base, ["_range", *keys]).withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_base", "_own")


def merge_order(events: DataFrame, time: str = "time", lane: str = "lane", file: str = "file_idx", seq: str = "seq") -> DataFrame:
    """O1: k-way merge of event files by synchronised time; the second lane loses ties, then the lower file wins."""
    return global_rank(events, [time, lane, file, seq])


def record_order(records: DataFrame) -> DataFrame:
    """O2: by time; at equal times the larger record type comes first, then the lower file."""
    return global_rank(records, ["time", F.desc("rtype"), "file_idx", "seq"])


def first_n(events: DataFrame, n: int, file: str = "file_idx", seq: str = "seq") -> DataFrame:
    """The first n events of each file."""
    return events.withColumn("_k", F.row_number().over(over([file], [seq]))).where(F.col("_k") <= n).drop("_k")


# clocks -----------------------------------------------------------------------------------------------------------


def sync_points(events: DataFrame, task: str, time: str, init: Column, preferred: Column, fallback: Column) -> DataFrame:
    """(task, init, sync): the first init; the first preferred event, else the first fallback one, else the init."""
    return events.groupBy(task).agg(F.min(F.when(init, F.col(time))).alias("init"), F.coalesce(F.min(F.when(preferred, F.col(time))), F.min(F.when(fallback, F.col(time))), F.min(time)).alias("sync"))


def latencies(tasks: DataFrame, mode: str = "task", app: Sequence[str] = (), most_apps: int = 1_000_000) -> DataFrame:
    """Tasks (init, sync, node) with the latency that aligns their clocks; mode task, node or none.

    Syncs move to the latest one (of a node: its latest), and the earliest aligned init becomes 0. Only maxima and minima
    of each app are shared."""
    key = list(app)
    if mode == "none":
        raw = tasks.withColumn("_raw", F.lit(0).cast("long"))
    else:
        unit = tasks if mode == "task" else tasks.join(tasks.groupBy(*key, "node").agg(F.max("sync").alias("_unit")), [*key, "node"])
        unit = unit.withColumn("_unit", F.col("sync")) if mode == "task" else unit
        most = tasks.groupBy(*key).agg(F.max("sync").alias("_most"))
        raw = (unit.join(broadcast_within(most, most_apps), key) if key else unit.crossJoin(F.broadcast(most))).withColumn("_raw", F.col("_most") - F.col("_unit")).drop("_most", "_unit")  # one row without apps
    least = raw.groupBy(*key).agg(F.min(F.col("init") + F.col("_raw")).alias("_least"))
    both = raw.join(broadcast_within(least, most_apps), key) if key else raw.crossJoin(F.broadcast(least))
    return both.withColumn("latency", F.col("_raw") - F.col("_least")).drop("_raw", "_least")


def synchronise(events: DataFrame, tasks: DataFrame, on: Sequence[str], time: str = "time") -> DataFrame:
    """Events at time + latency."""
    return events.join(tasks.select(*on, "latency"), list(on)).withColumn(time, F.col(time) + F.col("latency")).drop("latency")


def desynchronise(events: DataFrame, tasks: DataFrame, on: Sequence[str], time: str = "time") -> DataFrame:
    return events.join(tasks.select(*on, "latency"), list(on)).withColumn(time, F.col(time) - F.col("latency")).drop("latency")


# states -----------------------------------------------------------------------------------------------------------


def next_event_intervals(events: DataFrame, keys: Sequence[str], time: str, seq: str, state: str) -> DataFrame:
    """W1 for flat traces: each event's state lasts to the next event of its thread; empty intervals go (F2)."""
    w = over(keys, [time, seq])
    return events.select(*keys, F.col(time).alias("t0"), F.lead(time).over(w).alias("t1"), F.col(state).alias("state")).where("t0 < t1")


def join_states(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring intervals of one state become one."""
    w = over(keys, ["t0"])
    marked = intervals.withColumn("_new", F.when(F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag("t1").over(w).eqNullSafe(F.col("t0")), 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(*RUNNING))).groupBy(*keys, "_run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("state").alias("state")).drop("_run")


#: States by number.
STATES = ("Idle", "Running", "Not created", "Waiting a message", "Blocking Send", "Synchronization", "Test/Probe", "Scheduling and Fork/Join", "Wait/WaitAll", "Blocked", "Immediate Send", "Immediate Receive", "I/O", "Group Communication", "Tracing Disabled", "Others", "Send Receive", "Memory transfer", "Profiling", "On-line analysis", "Remote memory access", "Atomic memory operation", "Memory ordering operation", "Distributed locking", "Overhead", "One-sided op", "Startup latency", "Waiting links", "Data copy", "RTT")
RUNNING_STATE, PROFILING = 1, 18


def threads(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a thread next to each other and in order, for a replay that holds one thread's state at a time."""
    return events.repartition(*keys).sortWithinPartitions(*keys, *order)


# pairs, counters, groups ------------------------------------------------------------------------------------------


def begin_of(events: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Column, value: str, name: str) -> DataFrame:
    """The value of the latest begin event of the thread, at or before each event."""
    return events.withColumn(name, F.last(F.when(begin, F.col(value)), ignorenulls=True).over(over(keys, order).rowsBetween(*RUNNING)))


def counter_epochs(events: DataFrame, keys: Sequence[str], order: Sequence[str], change: Column) -> DataFrame:
    """Events with the number of counter-set changes so far."""
    return events.withColumn("epoch", F.sum(F.when(change, 1).otherwise(0)).over(over(keys, order).rowsBetween(*RUNNING)))


def counter_deltas(readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """What a counter has gained since its last reading; readings that fall are dropped. Put the counter and the epoch into keys."""
    return readings.withColumn("prev", F.lag(value).over(over(keys, order))).where(F.col(value) >= F.col("prev")).withColumn("delta", F.col(value) - F.col("prev"))


def multi_events(events: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 1024) -> DataFrame:
    """Neighbouring events with equal keys (place and time) as one line of at most `most` (type, value) pairs, in order."""
    numbered = events.withColumn("_k", F.row_number().over(over(keys, order))).withColumn("line", ((F.col("_k") - 1) / most).cast("long"))
    return numbered.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("_k", "type", "value"))).alias("p")).select(*keys, "line", F.transform("p", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("pairs"))


def mode_segments(events: DataFrame, keys: Sequence[str], order: Sequence[str], mode: Column) -> DataFrame:
    """The number of mode changes so far, and the latest mode."""
    w = over(keys, order).rowsBetween(*RUNNING)
    return events.withColumn("segment", F.sum(F.when(mode.isNotNull(), 1).otherwise(0)).over(w)).withColumn("mode", F.last(mode, ignorenulls=True).over(w))


# messages ---------------------------------------------------------------------------------------------------------


def fifo_ordinals(side: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return side.withColumn("ordinal", F.row_number().over(over(key, order)))


def match_messages(sends: DataFrame, receives: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """J1 without wildcards (and J3): the n-th send of a key meets its n-th receive. Both sides keep their columns, with s_ and r_ before them."""
    key = list(key)
    s, r = fifo_ordinals(sends, key, order), fifo_ordinals(receives, key, order)
    s = s.select(*key, "ordinal", *[F.col(c).alias(f"s_{c}") for c in sends.columns if c not in key])
    r = r.select(*key, "ordinal", *[F.col(c).alias(f"r_{c}") for c in receives.columns if c not in key])
    return s.join(r, [*key, "ordinal"])


def unmatched_sends(sends: DataFrame, receives: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sends that no receive meets."""
    return fifo_ordinals(sends, key, order).join(fifo_ordinals(receives, key, order).select(*key, "ordinal"), [*key, "ordinal"], "left_anti")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """The nearest right row at or before (backward) or at or after (forward) each left row, by key.

    One union and one window over the keys instead of an inequality join; `values` of the right row are added, null where
    there is none. strict leaves out equal times. Of right rows at one time the largest (backward) or smallest values count."""
    keys = list(keys)
    back = direction == "backward"
    taken = F.struct(F.col(time).alias("_t"), *values)
    right = right.groupBy(*keys, time).agg((F.max if back else F.min)(F.struct(*values)).alias("_v")).select(*keys, time, "_v.*").select(*keys, time, taken.alias("_r"), F.lit(None).alias("_l"), F.lit(0).alias("_side"))
    left = left.select(*keys, time, F.lit(None).cast(right.schema["_r"].dataType).alias("_r"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(1).alias("_side"))
    both = right.withColumn("_l", F.lit(None).cast(left.schema["_l"].dataType)).unionByName(left)
    right_first = not strict
    side = F.col("_side") if right_first else -F.col("_side")
    order = [F.col(time), side] if back else [F.col(time).desc(), side]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*RUNNING)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def sendrecv_sides(calls: DataFrame) -> DataFrame:
    """A combined call (to, from, send_tag, recv_tag ...) as its send and its receive."""
    sides = F.array(F.struct(F.lit("send").alias("kind"), F.col("to").alias("partner"), F.col("send_tag").alias("tag")), F.struct(F.lit("recv").alias("kind"), F.col("from").alias("partner"), F.col("recv_tag").alias("tag")))
    return calls.select("*", F.explode(sides).alias("_s")).select(*[c for c in calls.columns if c not in ("to", "from", "send_tag", "recv_tag")], "_s.*")


def collective_sides(calls: DataFrame) -> DataFrame:
    """A collective call (send_size, recv_size, comm, root) as typed values."""
    sides = [F.struct(F.lit(n).alias("what"), F.col(n).cast("long").alias("value")) for n in ("send_size", "recv_size", "comm", "root")]
    return calls.select(*[c for c in calls.columns if c not in ("send_size", "recv_size", "comm", "root")], F.explode(F.array(*sides)).alias("_s")).select("*", "_s.*").drop("_s")


def target_app(messages: DataFrame, links: DataFrame, on: Sequence[str] = ("app", "task", "comm")) -> DataFrame:
    """The application that a communicator leads to; its own where there is no link."""
    return messages.join(links.select(*on, "target_app"), list(on), "left").withColumn("target_app", F.coalesce("target_app", "app"))


def dependencies(deps: DataFrame, ends: DataFrame, starts: DataFrame, on: str = "task_id") -> DataFrame:
    """A zero-size message from the end of the task before to the event of the task after, tagged with the dependency."""
    e = ends.select(F.col(on).alias("pred"), F.col("time").alias("t_send"))
    s = starts.select(F.col(on).alias("succ"), F.col("time").alias("t_recv"))
    return deps.join(e, "pred").join(s, "succ").where("t_recv >= t_send").select("pred", "succ", "t_send", "t_recv", F.lit(0).alias("size"), "tag")


def task_mask(records: DataFrame, enabled: DataFrame, sender: str, receiver: str | None = None) -> DataFrame:
    """events whose task is enabled; with receiver, messages of which either side is."""
    on = enabled.select(F.col(sender if sender in enabled.columns else enabled.columns[0]).alias("_t")).distinct().withColumn("_on", F.lit(True))
    out = records.join(on.withColumnRenamed("_on", "_s"), F.col(sender) == F.col("_t"), "left").drop("_t")
    if receiver is None:
        return out.where("_s").drop("_s")
    out = out.join(on.withColumnRenamed("_on", "_r"), F.col(receiver) == F.col("_t"), "left").drop("_t")
    return out.where("coalesce(_s, false) or coalesce(_r, false)").drop("_s", "_r")


def dispatch(events: DataFrame, ranges: Sequence[tuple[int, int, str]], type_: str = "type") -> DataFrame:
    """the handler of the first registered range that has the type; null for none."""
    handler = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(ranges)):
        handler = F.when(F.col(type_).between(lo, hi), name).otherwise(handler)
    return events.withColumn("handler", handler)


# intervals --------------------------------------------------------------------------------------------------------


def lifetimes(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lo, hi, alloc_seq, free_seq) from alloc and free events (seq, kind, address, size); hi is inclusive at lo + size."""
    after = Window.partitionBy(*keys, "address").orderBy("seq")
    marked = events.withColumn("free_seq", F.lead("seq").over(after))
    return marked.where("kind = 'alloc'").select(*keys, F.col("address").alias("lo"), (F.col("address") + F.col("size")).alias("hi"), F.col("seq").alias("alloc_seq"), "free_seq")


def range_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Points with all intervals lo <= point <= hi (whole numbers). Columns other than keys must differ.

    An interval belongs to the class of the first length width, 2 width, 4 width ... that it fits, and is entered in the two cells of
    that length at most that it touches; a point looks into its cell of every class that occurs (64 at most). So a long interval costs no more
    rows than a short one. Choose width near the usual length."""
    keys = list(keys)
    length = F.greatest(F.col(hi) - F.col(lo), F.lit(0)) / width
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log2(length))).cast("int")
    size = F.expr(f"shiftleft({width}L, _level)")
    held = intervals.withColumn("_level", level).where(F.col(lo) <= F.col(hi))
    levels = sorted(r["_level"] for r in held.select("_level").distinct().collect())  # 64 at most
    entered = held.withColumn("_cell", F.explode(F.sequence(floor_div(F.col(lo).cast("long"), size), floor_div(F.col(hi).cast("long"), size))))
    probe = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    left = probe.withColumn("_cell", floor_div(F.col(point).cast("long"), size))
    return left.join(entered, [*keys, "_level", "_cell"]).where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_cell", "_level")


def live_region(accesses: DataFrame, regions: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The first region (by alloc_seq) that holds an access's address and lives at its seq."""
    hit = range_join(accesses, regions, "address", "lo", "hi", width, keys).where("seq > alloc_seq and (free_seq is null or seq < free_seq)")
    return hit.groupBy(*accesses.columns).agg(F.min(F.struct("alloc_seq", "lo", "hi")).alias("_r")).select(*accesses.columns, "_r.*")


# bursts and phases ------------------------------------------------------------------------------------------------


def bursts(events: DataFrame, keys: Sequence[str], begin: Column, end: Column) -> DataFrame:
    """(keys, ts, dur) of each end event that directly follows a begin event."""
    w = over(keys, ["time", "seq"])
    marked = events.withColumn("_b", F.lag(F.when(begin, F.col("time"))).over(w))
    return marked.where(end & F.col("_b").isNotNull()).select(*keys, F.col("_b").alias("ts"), (F.col("time") - F.col("_b")).alias("dur"))


def merge_short(bursts_: DataFrame, keys: Sequence[str], least: int, sums: Sequence[str] = ("dur",)) -> DataFrame:
    """Bursts of at least `least` stay; the statistics of shorter ones are added to the kept one before (leading ones: island 0)."""
    w = over(keys, ["ts"]).rowsBetween(*RUNNING)
    island = bursts_.withColumn("island", F.sum(F.when(F.col("dur") >= least, 1).otherwise(0)).over(w))
    return island.groupBy(*keys, "island").agg(F.min("ts").alias("ts"), F.count("*").alias("merged"), *[F.sum(c).alias(c) for c in sums])


def share_threshold(bursts_: DataFrame, percent: float, keys: Sequence[str] = ()) -> DataFrame:
    """The duration from which on bursts make up `percent` of the time: of ascending durations the first whose running sum is
    above total * (100 - percent) / 100; null for percent <= 0 or no bursts.

    Durations are summed by value first, and the running sums are taken over ranges of durations."""
    keys = list(keys)
    by = bursts_.groupBy(*keys, "dur").agg(F.sum("dur").alias("_s"))
    run = running_total(by, ["dur"], "_s", "_run", keys)
    whole = by.groupBy(*keys).agg(F.sum("_s").alias("_all"))
    both = run.join(whole, keys) if keys else run.crossJoin(F.broadcast(whole))  # one row
    passes = (F.col("_run") * 100 > F.col("_all") * (100 - percent)) & F.lit(percent > 0)
    return both.groupBy(*keys).agg(F.min(F.when(passes, F.col("dur"))).alias("threshold"))


def phase_stats(events: DataFrame, keys: Sequence[str], kinds: dict[str, Column], size: str, elapsed: str) -> DataFrame:
    """A4: counts, bytes and time of each class of calls in each phase."""
    out = []
    for name, which in kinds.items():
        out += [F.count(F.when(which, 1)).alias(f"{name}_count"), F.sum(F.when(which, F.col(size)).otherwise(0)).alias(f"{name}_bytes"), F.sum(F.when(which, F.col(elapsed)).otherwise(0)).alias(f"{name}_time")]
    return events.groupBy(*keys).agg(*out)


def counter_sums(readings: DataFrame, keys: Sequence[str], common: bool = False) -> DataFrame:
    """A5: sums of counters (a map by id) in each phase; common keeps those that every reading has."""
    each = readings.select(*keys, F.explode("counters").alias("counter", "n"))
    sums = each.groupBy(*keys, "counter").agg(F.sum("n").alias("n"), F.count("*").alias("_k"))
    if not common:
        return sums.drop("_k")
    return sums.join(readings.groupBy(*keys).agg(F.count("*").alias("_all")), list(keys)).where("_k = _all").drop("_k", "_all")


def chop(bursts_: DataFrame, running: DataFrame, keys: Sequence[str], ongoing: str = "keep") -> DataFrame:
    """A time moved to the start of the latest running interval (keep) or to the end of the one before (discard)."""
    right = running.select(*keys, F.col("t0" if ongoing == "keep" else "t1").alias("time"), F.col("t0" if ongoing == "keep" else "t1").alias("chopped"))
    return asof(bursts_, right, keys, "time", ["chopped"])


def zones(events: DataFrame, order: Sequence[str], change: Column, keys: Sequence[str]) -> DataFrame:
    """The number of zone changes so far, a further key of matching."""
    return events.withColumn("zone", F.sum(F.when(change, 1).otherwise(0)).over(over(keys, order).rowsBetween(*RUNNING)))


def after_first_global(events: DataFrame, keys: Sequence[str], is_global: Column) -> DataFrame:
    """A circular buffer keeps what follows the first global operation."""
    first = events.groupBy(*keys).agg(F.min(F.when(is_global, F.col("seq"))).alias("_g"))
    return events.join(first, list(keys)).where("seq >= _g").drop("_g")


def drop_states(intervals: DataFrame, excluded: Sequence, column: str = "state") -> DataFrame:
    """intervals without those of excluded states; an unknown state stays."""
    return intervals.where(~F.coalesce(F.col(column).isin(list(excluded)), F.lit(False)))


def long_bursts(bursts_: DataFrame, least: int, dur: str = "dur") -> DataFrame:
    """Bursts longer than least."""
    return bursts_.where(F.col(dur) > least)


def event_counts(events: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """How many events each combination of the keys has; added up where they are before they are shuffled."""
    return events.groupBy(*keys).agg(F.count("*").alias(name))


def sizes(records: DataFrame, keys: Sequence[str], payload: str, name: str = "bytes") -> DataFrame:
    """Bytes of the payloads of each key; a null one has none."""
    return records.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias(name))


def running_max(events: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The largest value (such as the number of a virtual thread) of each thread so far."""
    return events.withColumn(name, F.max(value).over(over(keys, order).rowsBetween(*RUNNING)))


def reduced(events: DataFrame, keys: Sequence[str], most: dict[str, Column] = {}, sums: dict[str, Column] = {}, any_: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Maxima, sums and disjunctions of what workers have, partly on each and then over all."""
    out = [F.max(c).alias(n) for n, c in most.items()] + [F.sum(c).alias(n) for n, c in sums.items()] + [F.bool_or(c).alias(n) for n, c in any_.items()]
    return events.groupBy(*keys).agg(*out)


# dictionaries -----------------------------------------------------------------------------------------------------


def dictionary(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """(column, id): distinct values numbered from 1 in their order, over ranges."""
    return global_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)


def communicators(lists: DataFrame, members: str, first: str) -> DataFrame:
    """(members, comm_id): equal ordered member lists are one communicator, numbered by the first that has it."""
    return global_rank(lists.groupBy(members).agg(F.min(first).alias("first")), ["first"], "comm_id").drop("first")


def binding_channel(channels: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of parallel channels the most binding: fewest tokens over gcd(production, consumption), the earlier at ties."""
    from tracewright.functions.exprs import gcd

    norm = channels.withColumn("norm_tokens", floor_div(F.col("tokens"), gcd(F.col("production"), F.col("consumption"))))
    return norm.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("norm_tokens", *order))).where("_k = 1").drop("_k")


def distinct_first(df: DataFrame, keys: Sequence[str], owner: str, seq: str) -> DataFrame:
    """Distinct keys with the owner that came first."""
    return df.groupBy(*keys).agg(F.min_by(owner, seq).alias(owner))



def address_ids(addresses: DataFrame, columns: Sequence[str] = ("file", "line", "address")) -> DataFrame:
    """Addresses numbered by file, line and address from 2; ids 0 and 1 are those of unresolved and not found ones."""
    return global_rank(addresses.select(*columns).distinct(), list(columns), "id").withColumn("id", F.col("id") + 1)


def bounded_intervals(events: DataFrame, keys: Sequence[str], time: str, seq: str, state: str, first: str, end: int) -> DataFrame:
    """Like next_event_intervals, with an initial state from time 0 and the last state closed at the end."""
    w = over(keys, [time, seq])
    start = events.groupBy(*keys).agg(F.min(time).alias("t1")).select(*keys, F.lit(0).cast("long").alias("t0"), "t1", F.lit(first).alias("state"))
    rest = events.select(*keys, F.col(time).alias("t0"), F.coalesce(F.lead(time).over(w), F.lit(end)).alias("t1"), F.col(state).alias("state"))
    return start.unionByName(rest).where("t0 < t1")


def skip(events: DataFrame, types: Sequence, column: str = "type") -> DataFrame:
    """events of types whose handler swallows them go."""
    return events.where(~F.col(column).isin(list(types)))


def encode(events: DataFrame, labels: DataFrame, on: str = "type", most_broadcast: int = 100_000) -> DataFrame:
    """Types translated by a dictionary (on, grouped); null where it has none. A dictionary of up to most_broadcast rows is
    broadcast, a larger one joined by shuffle."""
    return events.join(broadcast_within(labels, most_broadcast), on, "left")


def label_dictionaries(events: DataFrame, families: dict[str, Column], label: str, type_: str = "type", value: str = "value") -> DataFrame:
    """(family, type, value, label): for each family of events (a condition) its types and values as they occur, each with the first
    label by order; a value without a label is named by itself."""
    family = F.lit(None).cast("string")
    for name, which in reversed(list(families.items())):
        family = F.when(which, name).otherwise(family)
    used = events.withColumn("family", family).where("family is not null")
    return used.groupBy("family", F.col(type_).alias("type"), F.col(value).alias("value")).agg(F.coalesce(F.min(label), F.first(F.col(value).cast("string"))).alias("label"))
