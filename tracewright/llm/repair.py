"""Repair of conversations' structure by the cheapest edits, each distinct signature solved once.

Rows of a conversation that are equal are one unit with a number, so that repeats cost nothing. Units get their fault (blank, duplicate,
truncated) by aggregates, and are dealt out in ranges of (conversation, turn), so that a conversation of any length spans several tasks. A run of at
most BLOCK units is written as a signature: a letter for each unit's role (s, u, a, o: other), in upper case if truncated, and x and a
number for its repeats, or y and a number for a unit that must go. Distinct signatures are solved once, by memoised recursion over places and states: for
each state before and after, the least cost and the first audit in ASCII order of that cost. Insertions stand before a row, and only at the
end of the conversation after one; so two audits of one block are never one the beginning of the other, and blocks can be put together:
a pass over a conversation's blocks, of a few costs each, settles the states between them. The audits are joined back and replayed.

States: nothing yet, after system, after user, after assistant; audits give role initials (s?(ua)+)?.

Defined cases: null values of a row count as one space (conv_id and turn in the damage's key, role and text everywhere); rows with a
null conv_id are one conversation; rows with one turn follow each other by role and text; equal rows are next to each other, the first
of them is judged and the others are duplicates (blank ones are blank); roles that begin with no s, u or a can be rerolled or deleted
only; a conversation without rows after damage has zeros, an empty audit and the empty text's hash; an empty table gives an
empty result; other columns are ignored. The hash of a repaired conversation is one stream: its rows pass through one task in
order, a batch at a time, however many they are; audits are as long as the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import parts_for, stored, tidy, whole_texts

BLOCK = 256  # units of a signature
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a user or an assistant leads to
ENDS = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
FAR = 1 << 60  # the cost of what can't be

Way = tuple[int, str]


def token() -> Column:
    """The letters of a unit in its signature."""
    letter = F.when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    repeats = F.when(F.col("number") > 1, F.concat(F.lit("x"), (F.col("number") - 1).cast("string"))).otherwise(F.lit(""))
    return F.when(F.col("fault").isin("blank", "duplicate"), F.concat(F.lit("y"), F.col("number").cast("string"))).otherwise(F.concat(letter, repeats))


def solve(signature: str) -> list[list[Way | None]]:
    """For each state before and after the block: the least cost and, of that cost, the first audit; None where there is no way."""
    tokens = re.findall(r"[xy]\d+|[suaoSUAO]", signature)

    @cache
    def best(at: int, state: int) -> tuple[Way | None, ...]:
        if at == len(tokens):
            return tuple((0, "") if end == state else None for end in range(4))
        found: list[Way | None] = [None] * 4

        def offer(cost: int, letters: str, to: int) -> None:
            for end, way in enumerate(best(at + 1, to)):
                if way and (found[end] is None or (cost + way[0], letters + way[1]) < found[end]):
                    found[end] = (cost + way[0], letters + way[1])

        t, now = tokens[at], state
        for inserted in range(3):  # a third insertion leads where one does
            before, paid = "I" * inserted, INSERT * inserted
            if t[0] in "xy":
                offer(paid + DELETE * int(t[1:]), before + "D" * int(t[1:]), now)
            else:
                offer(paid + DELETE, before + "D", now)
                late = TRUNCATED if t.isupper() else 0
                offer(paid + REROLE + late, before + "R", NEXT[now])
                if t in "sS":
                    if now == NONE:
                        offer(paid + KEEP + late, before + "K", SYSTEM)
                elif t in "uUaA" and NEXT[now] == (USER if t in "uU" else ASSISTANT):
                    offer(paid + KEEP + late, before + "K", NEXT[now])
            now = NEXT[now]
        return tuple(found)

    for at in range(len(tokens) - 1, -1, -1):  # so that the recursion is never deep
        for state in range(4):
            best(at, state)
    return [list(best(0, state)) for state in range(4)]


def replay(signature: str, state: int, audit: str) -> list[tuple[str, str | None]]:
    """For each unit of the signature the lines that are inserted before it, and its role: None if it goes, empty if it stays as it is.
    Insertions after the last unit come last, as a unit that goes."""
    out, at = [], 0
    for letter, more, gone in [*re.findall(r"([suaoSUAO])(?:x(\d+))?|y(\d+)", signature), ("", "", "0")]:
        lines = []
        while audit[at : at + 1] == "I":
            state, at = NEXT[state], at + 1
            lines.append("user:\n" if state == USER else "assistant:\n")
        role = None
        if letter:
            if audit[at] == "K":
                state, role = SYSTEM if letter in "sS" else NEXT[state], ""
            elif audit[at] == "R":
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            at += 1
        at += int(gone or more or 0)
        out.append(("".join(lines), role))
    return out


def key_of() -> Column:
    """A conversation's id as text that is never null."""
    return F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, number): distinct rows after damage and how often each occurs."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    rows = conversations.select(key_of().alias("key"), "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    rows = rows.select("key", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(or_space("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("number"))
    return rows.groupBy("key", "turn", "role", "text").agg(F.sum("number").alias("number"))


def faults(units: DataFrame) -> DataFrame:
    """units with the role's initial and the fault of each unit's first row."""
    visible = r"[^\x20\x09-\x0D]"
    own = units.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # units of one role and text differ in their turn; the least turn (a null one before all) has them first
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = own.groupBy("key", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("several")).where("several > 1").drop("several")
    met = own.join(first, ["key", "role", "digest"], "left")
    seen = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(order)
    last = F.regexp_extract("text", rf"({visible})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(visible), "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    return met.select("key", "turn", "role", "number", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"), "text")


def placed(units: DataFrame) -> DataFrame:
    """units in a table, with `part` (a range of conversations and turns), `block` and `place` in the block, and `wrong`: how many neighbours
    up to each unit, in its part, are no legal pair."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = units.repartitionByRange(parts, F.col("key"), *order).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("key", "part").orderBy(*order)
    at, pair = F.row_number().over(w) - 1, F.concat(F.lag("initial").over(w), F.col("initial"))
    wrong = F.when(pair.isNull() | pair.isin("su", "ua", "au"), 0).otherwise(1) + F.col("number") - 1
    own = ranged.withColumns({"at": at, "wrong": wrong})
    return stored(own.withColumns({"block": F.expr(f"cast(at div {BLOCK} as int)"), "place": F.col("at") % BLOCK}), "units", parts_for(units))


def counts(units: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal)."""
    n, fault = F.col("number"), F.col("fault")
    each = {"blank": F.when(fault == "blank", n).otherwise(0), "duplicate": F.when(fault == "duplicate", n).when(fault == "blank", 0).otherwise(n - 1), "truncated": F.when(fault == "truncated", 1).otherwise(0)}
    ranges = units.groupBy("key", "part").agg(*[F.sum(v).alias(k) for k, v in each.items()], F.sum("wrong").alias("illegal"), F.min_by("initial", "at").alias("first"), F.max_by("initial", "at").alias("last"))
    pair = F.concat(F.lag("last").over(Window.partitionBy("key").orderBy("part")), F.col("first"))  # a row for each range of a conversation
    ranges = ranges.withColumn("illegal", F.col("illegal") + F.when(pair.isNull() | pair.isin("su", "ua", "au"), 0).otherwise(1))
    added = ranges.groupBy("key").agg(*[F.sum(c).cast("long").alias(c) for c in (*each, "illegal")])
    turns = units.select("key", "turn").distinct().groupBy("key").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count("turn").alias("turns"))
    gaps = F.expr("coalesce(try_cast(cast(most as decimal(20,0)) - least + 1 - turns as bigint), if(turns = 0, 0, null))")
    return added.join(turns.select("key", gaps.alias("gaps")), "key")


def signatures(units: DataFrame) -> DataFrame:
    """(key, part, block, signature): at most BLOCK units each."""
    letters = F.array_sort(F.collect_list(F.struct("place", token().alias("token"))))
    return units.groupBy("key", "part", "block").agg(F.array_join(F.transform(letters, lambda x: x["token"]), "").alias("signature"))


WAYS = "array<struct<cost: bigint, audit: string>>"


def solved(signed: DataFrame) -> DataFrame:
    """(signature, ways): each distinct signature once; ways by 4 * before + after, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ways = [[way and {"cost": way[0], "audit": way[1]} for row in solve(s) for way in row] for s in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ways, kind)], ["signature", "ways"])

    return signed.select("signature").distinct().mapInArrow(run, f"signature string, ways {WAYS}")


def along(blocks: DataFrame, name: str, over: Callable[[list[list[int]]], list[list[int]]]) -> DataFrame:
    """(key, part, block, `name`): over() gets a conversation's blocks' numbers (the column `told`), in order, and gives each block's."""
    lists = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "block", "told"))).alias("told"))  # a few numbers for BLOCK units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"part": x["part"], "block": x["block"], name: y} for x, y in zip(told, over([x["told"] for x in told]), strict=True)] for told in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int32()), (name, pa.list_(pa.int64()))])))], ["key", "found"])

    return lists.mapInArrow(run, f"key string, found array<struct<part: int, block: int, {name}: array<bigint>>>").select("key", F.explode("found").alias("x")).select("key", "x.*")


def costs_after(costs: list[list[int]]) -> list[list[int]]:
    """For each block and each state after it, the least cost of all that follows; with a 1 at the end for the last block."""
    out = [[*(ENDS[s][0] for s in range(4)), 1]]
    for block in reversed(costs[1:]):
        out.append([*(min(block[4 * s + e] + out[-1][e] for e in range(4)) for s in range(4)), 0])
    return out[::-1]


def states_before(moves: list[list[int]]) -> list[list[int]]:
    """The state before each block; moves: the state after it, by the state before."""
    out, state = [], NONE
    for move in moves:
        out.append([state])
        state = move[state]
    return out


def audits(signed: DataFrame) -> DataFrame:
    """(key, part, block, signature, state, audit, cost): how each block is repaired, from what state on; the last one ends the conversation."""
    known = stored(signed.join(solved(signed), "signature"), "ways", parts_for(signed))
    cost = F.transform("ways", lambda w: F.coalesce(w["cost"], F.lit(FAR)))
    after = along(known.select("key", "part", "block", cost.alias("told")), "after", costs_after)

    def move(s: int) -> Column:
        """(cost, audit, e): the cheapest way on from state s through the block, the first audit of these; the block's own cost beside it."""
        ends = F.array(*[F.when(F.get("ways", 4 * s + e).isNotNull(), F.struct((F.get("ways", 4 * s + e)["cost"] + F.get("after", e)).alias("all"), F.concat(F.get("ways", 4 * s + e)["audit"], F.when(F.get("after", 4) == 1, F.lit(ENDS[e][1])).otherwise(F.lit(""))).alias("audit"), F.lit(e).alias("e"), (F.get("ways", 4 * s + e)["cost"] + F.when(F.get("after", 4) == 1, F.lit(ENDS[e][0])).otherwise(F.lit(0))).alias("cost"))) for e in range(4)])
        return F.array_min(F.array_compact(ends))

    chosen = stored(known.join(after, ["key", "part", "block"]).select("key", "part", "block", "signature", F.array(*[move(s) for s in range(4)]).alias("moves")), "moves", parts_for(signed))
    before = along(chosen.select("key", "part", "block", F.transform("moves", lambda m: F.coalesce(m["e"], F.lit(0)).cast("long")).alias("told")), "state", states_before)
    own = chosen.join(before.select("key", "part", "block", F.get("state", 0).cast("int").alias("state")), ["key", "part", "block"]).withColumn("move", F.get("moves", F.col("state")))
    return own.select("key", "part", "block", "signature", "state", "move.audit", "move.cost")


def lines(units: DataFrame, found: DataFrame) -> DataFrame:
    """(key, part, block, place, line): the repaired conversations' lines, each with a line break at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256).to_pylist()
                done = [[{"place": place, "lead": lead, "said": said} for place, (lead, said) in enumerate(replay(r["signature"], r["state"], r["audit"])) if lead or said is not None] for r in rows]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 256) for c in range(3)), pa.array(done, pa.list_(pa.struct([("place", pa.int32()), ("lead", pa.string()), ("said", pa.string())])))], ["key", "part", "block", "edits"])

    edits = found.select("key", "part", "block", "signature", "state", "audit").mapInArrow(run, "key string, part int, block int, edits array<struct<place: int, lead: string, said: string>>")
    edits = edits.select("key", "part", "block", F.explode("edits").alias("e")).select("key", "part", "block", "e.*")
    both = edits.join(units.select("key", "part", "block", "place", "role", "text"), ["key", "part", "block", "place"], "left")
    own = F.when(F.col("said").isNotNull(), F.concat(F.when(F.col("said") == "", F.col("role")).otherwise(F.col("said")), F.lit(":"), F.col("text"), F.lit("\n"))).otherwise(F.lit(""))
    return both.select("key", "part", "block", "place", F.concat("lead", own).alias("line"))


def hashes(said: DataFrame) -> DataFrame:
    """(key, sha256) of each key's lines in order, without the last line break; a line's text is read once and not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, held = None, None, b""
        for b in batches:
            keys, digests = [], []
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        digest.update(held[:-1])
                        keys.append(key)
                        digests.append(digest.hexdigest())
                    key, digest, held = k, hashlib.sha256(), b""
                digest.update(held)
                held = line.encode()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "sha256"])
        if key is not None:
            digest.update(held[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "sha256"])

    rows = said.repartition("key").sortWithinPartitions("key", "part", "block", "place").select("key", "line")
    return whole_texts(rows).mapInArrow(tidy(run), "key string, sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation."""
    units = placed(faults(damage(conversations)))
    signed = stored(signatures(units), "signatures", parts_for(units))
    found = stored(audits(signed), "audits", parts_for(units))
    whole = found.groupBy("key").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    every = conversations.select("conv_id").distinct().withColumn("key", key_of())
    all_ = every.join(counts(units), "key", "left").join(whole, "key", "left").join(hashes(lines(units, found)), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    gaps = F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return all_.select("conv_id", gaps, *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))
