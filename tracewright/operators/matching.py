"""J1 with wildcards: send and receive ends of a key (sender, receiver, communicator), matched in order, receives of any tag among them.

A key within one range of events is replayed by itself. A key that spans ranges is many tasks:
* without receives of any tag, the n-th send of a tag meets its n-th receive; with no others, the n-th send of all the n-th receive. Places are
  counted by range and the ranges' numbers added up, so this is two joins by place;
* with both, but sends of one tag only, receives of other tags meet nothing, and the n-th send meets the n-th of the other receives;
* with both and sends of several tags, a match depends on all ends that are open by then. Ranges are replayed at once, each from the ends that the one before it left open
  when it was last replayed (none at first), and again while these differ. A range that starts right ends right, so in round k the first k ranges are
  final, and all are as soon as nothing changes: after two rounds or so where messages are mostly received soon, one after the other at worst."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.stacks import FIRST, in_order, joined, ranges_for
from tracewright.session import checkpointed

ANY_TAG = -1


class OpenEnds:
    """One side's queue of ends: the oldest of a tag, or of all, in constant time."""

    def __init__(self, left: Sequence[int] = ()):
        self.by_tag: dict = {}
        self.all: OrderedDict = OrderedDict()  # number: (seq, tag), oldest first
        self.number = 0
        for seq, tag in zip(left[::2], left[1::2], strict=True):
            self.add(seq, tag)

    def add(self, seq: int, tag) -> None:
        self.by_tag.setdefault(tag, deque()).append(self.number)
        self.all[self.number] = (seq, tag)
        self.number += 1

    def take(self, tags: Sequence | None) -> int | None:
        """The seq of the oldest end with one of the tags (None: with any), which leaves; None if there is none."""
        if tags is None:
            number = next(iter(self.all), None)
        else:
            number = min((self.by_tag[t][0] for t in tags if self.by_tag.get(t)), default=None)
        if number is None:
            return None
        seq, tag = self.all.pop(number)
        self.by_tag[tag].popleft()  # the oldest of all is its tag's oldest
        return seq

    def left(self) -> list[int]:
        return [x for end in self.all.values() for x in end]


class Matcher:
    """A key's open ends. Each end looks in the other side's queue for the first entry with its tag, a receive of any tag taking the oldest; else
    it queues."""

    def __init__(self, sends: Sequence[int] = (), receives: Sequence[int] = ()):
        self.sends, self.receives = OpenEnds(sends), OpenEnds(receives)

    def end(self, seq: int, kind: str, tag: int) -> tuple[int, int] | None:
        """The match (send, receive) that the end makes, if any."""
        if kind == "send":
            hit = self.receives.take((tag, ANY_TAG))
            own, match = self.sends, (seq, hit)
        else:
            hit = self.sends.take(None if tag == ANY_TAG else (tag,))
            own, match = self.receives, (hit, seq)
        if hit is None:
            own.add(seq, tag)
            return None
        return match


def match_wildcard(ends: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, send_seq, recv_seq) of ends (key, time, seq, kind, tag): kind is send or another word; tag ANY_TAG of a receive meets any."""
    key = list(key)
    ends = ends.select(*key, "time", "seq", "kind", "tag")
    rows = checkpointed(ends.repartitionByRange(ranges_for(ends), *key, "time", "seq").withColumn("_range", F.spark_partition_id()))
    any_ = (F.col("kind") != "send") & (F.col("tag") == ANY_TAG)
    own = (F.col("kind") != "send") & (F.col("tag") != ANY_TAG)
    sent = F.when(F.col("kind") == "send", F.col("tag"))
    spans = rows.groupBy(*key).agg(F.min("_range").alias("_a"), F.max("_range").alias("_b"), F.max(any_).alias("_any"), F.max(own).alias("_own"), F.min(sent).alias("_sent"), F.max(sent).alias("_most")).where("_a < _b")
    one = ~F.coalesce(F.col("_sent") < F.col("_most"), F.lit(False))
    how = F.when(~F.coalesce("_any", F.lit(False)), "tags").when(~F.coalesce("_own", F.lit(False)), "order").when(one, "one").otherwise("both")
    spans = checkpointed(spans.select(*key, how.alias("_how"), "_sent"), 1)  # fewer than ranges
    rows = joined(rows, spans, key, "left")
    found = replayed(rows.where("_how is null"), key)
    kinds = {r["_how"] for r in spans.select("_how").distinct().collect()}
    if "tags" in kinds:
        found = found.union(by_place(rows.where("_how = 'tags'"), key, [*key, "tag"]))
    if "order" in kinds:
        found = found.union(by_place(rows.where("_how = 'order'"), key, key))
    if "one" in kinds:
        found = found.union(by_place(rows.where((F.col("_how") == "one") & ((F.col("kind") == "send") | F.col("tag").isin(F.col("_sent"), ANY_TAG))), key, key))
    if "both" in kinds:
        found = found.union(in_rounds(rows.where("_how = 'both'").drop("_how", "_sent"), key))
    return found


def places(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with their place (from 1) among those of their keys, counted by range."""
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    base = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("time", "seq")))
    return own.join(base, [*keys, "_range"]).withColumn("_place", F.col("_base") + F.col("_own")).drop("_base", "_own")


def by_place(rows: DataFrame, key: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The n-th send of `keys` with its n-th receive."""
    sends = places(rows.where("kind = 'send'"), keys).select(*keys, "_place", F.col("seq").alias("send_seq"))
    receives = places(rows.where("kind <> 'send'"), keys).select(*keys, "_place", F.col("seq").alias("recv_seq"))
    return sends.join(receives, [*keys, "_place"]).select(*key, F.col("send_seq").cast("long").alias("send_seq"), F.col("recv_seq").cast("long").alias("recv_seq"))


def named(rows: DataFrame, key: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)


def replayed(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys within one range, each in order; only its open ends are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, matcher = None, Matcher()
        for b in batches:
            out = []
            for *own, seq, kind, tag in b[[*key, "seq", "kind", "tag"]].itertuples(index=False, name=None):
                if tuple(own) != at:
                    at, matcher = tuple(own), Matcher()
                if match := matcher.end(int(seq), kind, int(tag)):
                    out.append((*own, *match))
            yield pd.DataFrame(out, columns=[*key, "send_seq", "recv_seq"])

    return in_order(rows, key).mapInPandas(run, f"{named(rows, key)}, send_seq long, recv_seq long")


def in_rounds(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that span ranges and need all their open ends: ranges are replayed until each starts from what the one before has left."""
    rows = checkpointed(rows)
    kinds, columns = named(rows, key), [*key, "_range", "send_seq", "recv_seq", "sends", "receives"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, matcher = None, None

        def ended() -> list:
            return [(*at, None, None, matcher.sends.left(), matcher.receives.left())] if at else []

        for b in batches:
            out: list = []
            for *own, seq, kind, tag, sends, receives in b[[*key, "_range", "seq", "kind", "tag", "sends", "receives"]].itertuples(index=False, name=None):
                if tuple(own) != at:  # a range begins with what it starts from
                    out += ended()
                    at, matcher = tuple(own), Matcher(list(map(int, sends)), list(map(int, receives)))
                elif match := matcher.end(int(seq), kind, int(tag)):
                    out.append((*own, *match, None, None))
            yield pd.DataFrame(out, columns=columns).astype({"send_seq": "Int64", "recv_seq": "Int64"})
        yield pd.DataFrame(ended(), columns=columns).astype({"send_seq": "Int64", "recv_seq": "Int64"})

    place = [*key, "_range"]
    none = F.array().cast("array<long>")
    starts = checkpointed(rows.select(*place).distinct().select(*place, none.alias("sends"), none.alias("receives")))
    changed, matches, left = starts, None, None
    following = F.lead("_range").over(Window.partitionBy(*key).orderBy("_range"))  # a row for each range of a key
    order = checkpointed(starts.select(*place, following.alias("_next")))
    while True:
        again = changed.select(*place, F.lit(FIRST).alias("time"), F.lit(FIRST).alias("seq"), F.lit("").alias("kind"), F.lit(0).alias("tag"), "sends", "receives")
        own = rows.join(F.broadcast(changed.select(*place)), place, "left_semi").select(*place, "time", "seq", "kind", "tag", F.lit(None).cast("array<long>").alias("sends"), F.lit(None).cast("array<long>").alias("receives"))
        done = checkpointed(in_order(again.union(own), key).mapInPandas(run, f"{kinds}, _range int, send_seq long, recv_seq long, sends array<long>, receives array<long>"))
        new = done.where("sends is null").select(*place, "send_seq", "recv_seq")
        new_left = done.where("sends is not null").select(*place, "sends", "receives")
        if matches is None:
            matches, left = new, new_left
        else:  # what a range has told last counts
            matches = checkpointed(matches.join(F.broadcast(changed.select(*place)), place, "left_anti").union(new))
            left = checkpointed(left.join(F.broadcast(changed.select(*place)), place, "left_anti").union(new_left))
        found = left.join(order, place).where("_next is not null").select(*key, F.col("_next").alias("_range"), F.col("sends").alias("_s"), F.col("receives").alias("_r"))
        both = starts.join(found, place, "left").select(*place, "sends", "receives", F.coalesce("_s", none).alias("_s"), F.coalesce("_r", none).alias("_r"))
        both = checkpointed(both)
        changed = both.where("sends <> _s or receives <> _r").select(*place, F.col("_s").alias("sends"), F.col("_r").alias("receives"))
        if changed.isEmpty():
            return matches.select(*key, "send_seq", "recv_seq")
        starts = both.select(*place, F.col("_s").alias("sends"), F.col("_r").alias("receives"))
