"""Stacks of threads that are longer than a task: W1, W4, W5 and W9 in ranges.

Events are dealt out in ranges of (thread, time, seq), so a thread that holds all events is as many tasks as any other table. What a range does to the
stack that it finds is, whatever that is, a list of conditional pops and then a pile of pushes; of these summaries one follows from the other. So
threads that span ranges take three passes: each range is reduced to its summary; a thread's summaries are put together in order, which tells the
stack that each range finds (as deep as it looks); each range is then replayed from there. A thread within one range is replayed at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import checkpointed

IDLE, NOT_TRACING, NOT_CREATED = 0, 14, 2  # fixed values: states
FIRST = -(1 << 63)  # the time of what comes before a range's events

#: What a range does to the stack that it finds: (how, state, times). POP_IF: once what isn't traced has gone; POP_ALSO: without that.
CLEAR, POP_IF, POP_ALSO, POP_UNTIL, EMPTY, POP = range(6)


class Stack:
    """A stack of which only the pushes since `bottom` are known; what reaches below is noted in `below`, in order, if that isn't the ground."""

    def __init__(self, found: Sequence[int] = (), grounded: bool = True):
        self.items, self.grounded, self.below = list(found), grounded, []

    def note(self, how: int, state: int = 0) -> None:
        if self.grounded:
            return
        if self.below and self.below[-1][:2] == [how, state] and how != POP_UNTIL:
            self.below[-1][2] += how != CLEAR  # an untraced state is only ever on top, so clearing twice is clearing once
        elif not (self.below and self.below[-1][:2] == [how, state]):
            self.below.append([how, state, 1])

    def top(self) -> int:
        return self.items[-1] if self.items else IDLE

    def clear_untraced(self) -> None:
        if not self.items:
            self.note(CLEAR)
        elif self.items[-1] == NOT_TRACING:
            self.items.pop()

    def apply(self, action: str, state: int) -> None:
        """A pop takes the top only if it is the popped state; not-tracing goes at any next push or pop; a change of the tracing mode leaves its state alone."""
        if action == "push":
            self.clear_untraced()
            self.items.append(state)
        elif action == "pop":
            if not self.items:
                self.note(POP_IF, state)
            else:
                self.clear_untraced()
                if not self.items:
                    self.note(POP_ALSO, state)
                elif self.items[-1] == state:
                    self.items.pop()
        elif action == "pop_until":
            while self.items and self.items[-1] != state:
                self.items.pop()
            if not self.items:
                self.note(POP_UNTIL, state)
        elif action == "reset":
            self.items, self.below, self.grounded = [state], self.below if self.grounded else [[EMPTY, 0, 1]], True
        else:
            raise ValueError(action)

    def value(self, value: int) -> None:
        """Above 0 pushes, 0 pops."""
        if value > 0:
            self.items.append(value)
        elif self.items:
            self.items.pop()
        else:
            self.note(POP)

    def follow(self, below: Sequence[Sequence[int]], pushes: Sequence[int]) -> int:
        """Does what a range does; how many items it has taken."""
        least = len(self.items)
        before = least
        for how, state, times in below:
            if how == EMPTY:
                self.items.clear()
            elif how == POP:
                del self.items[max(0, len(self.items) - times) :]
            elif how == CLEAR:
                self.clear_untraced()
            elif how == POP_UNTIL:
                while self.items and self.items[-1] != state:
                    self.items.pop()
            else:
                while times:
                    if how == POP_IF:
                        self.clear_untraced()
                    if not self.items or self.items[-1] != state:
                        break  # nor will the others find it
                    self.items.pop()
                    times -= 1
            least = min(least, len(self.items))
        self.items += pushes
        return before - least


RANGE_BYTES = 32 << 20  # of a table for each range that it is dealt out in, by the planner's estimate


def ranges_for(df: DataFrame) -> int:
    """How many ranges: as many as the table's bytes call for, at least 8, but no more than the session's shuffle partitions."""
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(8, bytes_ // RANGE_BYTES))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left with right's other columns, where keys are equal or both null; right is broadcast: it has a row for each range at most."""
    named = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_of_{k}"])
    return left.join(F.broadcast(named), on, how).drop(*[f"_of_{k}" for k in keys])


def in_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a thread's range next to each other and in order, for a replay that holds one stack at a time."""
    return rows.repartition(*keys, "_range").sortWithinPartitions(*keys, "_range", "time", "seq")


def with_starts(events: DataFrame, keys: Sequence[str], values: Sequence[str], apply: Callable[[Stack, tuple], None], first: Sequence[int]) -> DataFrame:
    """events (keys, time, seq, values) with _range, _split (whether the thread spans ranges) and _found: null, but for a row at FIRST before
    each range but a thread's first one, which has the stack that the range finds."""
    keys, values = list(keys), list(values)
    events = events.select(*keys, "time", "seq", *values)
    rows = checkpointed(events.repartitionByRange(ranges_for(events), *keys, "time", "seq").withColumn("_range", F.spark_partition_id()))
    split = rows.groupBy(*keys).agg(F.min("_range").alias("_a"), F.max("_range").alias("_b")).where("_a < _b").select(*keys)  # fewer than ranges
    split = checkpointed(split, 1)
    rows = joined(rows, split.withColumn("_split", F.lit(True)), keys, "left").withColumn("_split", F.coalesce("_split", F.lit(False)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema)
    summary = f"{kinds}, _range int, below array<array<long>>, pushes array<long>"

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, None
        for b in batches:
            out = []
            for *own, found_in, values_ in zip(*[b[c] for c in [*keys, "_range"]], b[values].itertuples(index=False, name=None), strict=True):
                if (*own, found_in) != at:
                    if at:
                        out.append((*at, stack.below, stack.items))
                    at, stack = (*own, found_in), Stack(grounded=False)
                apply(stack, values_)
            yield pd.DataFrame(out, columns=[*keys, "_range", "below", "pushes"])
        if at:
            yield pd.DataFrame([(*at, stack.below, stack.items)], columns=[*keys, "_range", "below", "pushes"])

    def composed(key: tuple, summaries: pd.DataFrame) -> pd.DataFrame:
        stack, out = Stack(first), []
        for i, (at, below, pushes) in enumerate(summaries.sort_values("_range")[["_range", "below", "pushes"]].itertuples(index=False, name=None)):
            found = list(stack.items)
            taken = stack.follow([list(map(int, x)) for x in below], list(map(int, pushes)))
            if i:
                out.append((*key, at, found[max(0, len(found) - taken - 1) :]))
        return pd.DataFrame(out, columns=[*keys, "_range", "_found"])

    made = in_order(rows.where("_split"), keys).mapInPandas(reduced, summary)
    starts = made.groupBy(*keys).applyInPandas(composed, f"{kinds}, _range int, _found array<long>")
    blank = [F.lit(FIRST).cast(rows.schema["time"].dataType).alias("time"), F.lit(-1).cast(rows.schema["seq"].dataType).alias("seq"), *[F.lit(0 if rows.schema[v].dataType.typeName() != "string" else "").cast(rows.schema[v].dataType).alias(v) for v in values]]
    starts = starts.select(*keys, *blank, "_range", F.lit(True).alias("_split"), "_found")
    return rows.select(*keys, "time", "seq", *values, "_range", "_split", F.lit(None).cast("array<long>").alias("_found")).union(starts)


def state_intervals(events: DataFrame, keys: Sequence[str], end_time: int | None = None, drop: Sequence[int] = (IDLE,), split: bool = False) -> DataFrame:
    """(keys, t0, t1, state) of push, pop, pop_until and reset events (time, seq, action, state).

    Before the first event a thread is in state 2 (not created); the last interval ends at end_time, if given. Each task holds one stack; a thread
    of any length is as many tasks as its events call for."""
    keys = list(keys)
    rows = with_starts(events, keys, ["action", "state"], lambda stack, v: stack.apply(v[0], int(v[1])), [NOT_CREATED])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema)
    columns = [*keys, "_range", "edge", "first", "t0", "t1", "state"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack, since, state, spans, first = None, None, 0, NOT_CREATED, False, None

        def ended(out: list) -> None:
            if at is None:
                return
            if spans and since is not None:  # first: when the state that came in ended; none in a thread's first range
                out.append((*at, True, first, since, since, state))
            elif not spans and end_time is not None and since < end_time and state not in drop:
                out.append((*at, False, None, since, end_time, state))

        for b in batches:
            out: list = []
            for *own, time, action, s, found_in, spanning, found in b[[*keys, "time", "action", "state", "_range", "_split", "_found"]].itertuples(index=False, name=None):
                if (*own, found_in) != at:
                    ended(out)
                    at, spans, first = (*own, found_in), spanning, None
                    stack, since = (Stack([NOT_CREATED]), 0) if found is None else (Stack(list(map(int, found))), None)
                    state = stack.top()
                    if found is not None:
                        continue
                stack.apply(action, int(s))
                new = stack.top()
                if new != state or split:
                    if since is None:
                        first = int(time)
                    elif since < time and state not in drop:
                        out.append((*at, False, None, since, int(time), state))
                    since, state = int(time), new
            yield pd.DataFrame(out, columns=columns).astype({"first": "Int64"})
        out = []
        ended(out)
        yield pd.DataFrame(out, columns=columns).astype({"first": "Int64"})

    done = checkpointed(in_order(rows, keys).mapInPandas(run, f"{kinds}, _range int, edge boolean, first long, t0 long, t1 long, state int"))
    # a state that lasts over ranges: from the last change of an earlier range to the first one of a later
    w = Window.partitionBy(*keys).orderBy("_range")  # a row for each range of a thread
    edges = done.where("edge").select(*keys, F.col("t0").alias("last"), "state", F.lead("first").over(w).alias("until"))
    if end_time is not None:
        edges = edges.withColumn("until", F.coalesce("until", F.lit(end_time)))
    over = edges.where("last < until").select(*keys, F.col("last").alias("t0"), F.col("until").alias("t1"), "state")
    over = over.where(~F.col("state").isin(*drop)) if drop else over
    return done.where("not edge").select(*keys, "t0", "t1", "state").union(over)


def stacked_types(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, type, time, seq, top) with the value on top after each event: above 0 pushes, 0 pops, of a (thread, type) of its own."""
    keys = [*keys, "type"]
    rows = with_starts(events, keys, ["value"], lambda stack, v: stack.value(int(v[0])), [])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, None
        for b in batches:
            out = []
            for *own, time, seq, value, found_in, found in b[[*keys, "time", "seq", "value", "_range", "_found"]].itertuples(index=False, name=None):
                if (*own, found_in) != at:
                    at, stack = (*own, found_in), Stack([] if found is None else list(map(int, found)))
                    if found is not None:
                        continue
                stack.value(int(value))
                out.append((*own, int(time), int(seq), stack.top()))
            yield pd.DataFrame(out, columns=[*keys, "time", "seq", "top"])

    return in_order(rows, keys).mapInPandas(run, f"{kinds}, time long, seq long, top long")
