"""Best-fit packing planned over the histogram of piece lengths.

Documents are encoded once; a piece is known by its length, its task and its rank among that task's pieces of
its length. The histogram (at most `capacity` rows, whatever the input) goes to the driver, where best-fit
decreasing over counts gives runs of slots; pieces take slots by joining on their rank within their length,
which is the rank in the task plus the counts of the tasks before. Nothing else is gathered, and a length that
a third of all documents share is spread over all tasks.

Defined cases: a null text is empty, and an empty text is one piece with only the end id; equal doc_ids or rows
are separate documents, with equal digests; null doc_ids are kept; an empty table gives an empty result; other
columns are ignored; a very long text is encoded by itself and cut into as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import checkpointed, parts_for, slices, tidy, tokenizer_path, whole_text, whole_texts, word_bpe
from tracewright.llm.token_files import TOKENIZER


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = TOKENIZER, with_ids: bool = False, keep_words: int = 600_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, own_rank[, ids]): documents cut into pieces; only a first piece of
    a longer document may be shorter than capacity."""
    model = tokenizer_path(tokenizer)
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, bpe, ranks = TaskContext.get().partitionId(), word_bpe(model, keep_words), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i, j in slices(b, "text"):
                own, out = [], []
                for k, ids in enumerate(bpe.encode(b.column(1).slice(i, j - i).to_pylist()), i):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1 if n > capacity else n
                    at = 0
                    for p, to in enumerate(range(first, n + 1, capacity)):
                        own.append(k)
                        out.append((p, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), task, ranks[to - at], ids[4 * at : 4 * to]))
                        ranks[to - at] += 1
                        at = to
                names, kinds = ["piece", "start", "length", "ids_crc32", "part", "own_rank"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [b.column(0).take(pa.array(own, pa.int64())), *(pa.array([x[c] for x in out], t) for c, t in enumerate(kinds))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x[6], "<i4") for x in out], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, *["ids"] * with_ids])

    return whole_texts(rows).mapInArrow(tidy(run, tokenizes=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, own_rank long" + ", ids array<int>" * with_ids)


def best_fit(counts: dict[int, int], capacity: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: runs (length, first rank, number, first sequence, offset, per sequence).

    The piece of rank first + i goes to sequence seq + i // per, at offset + i % per * length. The number of runs
    depends on the capacity, not on the counts."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs of sequences (first, number)
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(free: int, seq: int, number: int) -> int:
            """Places pieces in as many of these sequences as are needed; how many that are."""
            nonlocal left, rank
            per = free // length
            used = min(number, -(-left // per))
            n = min(left, used * per)
            runs.append((length, rank, n, seq, capacity - free, per))
            if n // per:
                room[free - per * length].append((seq, n // per))
            if n % per:
                room[free - n % per * length].append((seq + n // per, 1))
            rank, left = rank + n, left - n
            return used

        for free in sorted(x for x in room if x >= length and room[x]):
            while left and room[free]:
                seq, number = room[free].pop()
                used = put(free, seq, number)
                if number > used:
                    room[free].append((seq + used, number - used))
        if left:
            made += put(capacity, made, -(-left // (capacity // length)))
    return runs


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = TOKENIZER, with_ids: bool = False, keep_words: int = 600_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document.

    keep_words: how many words' ids a worker remembers, twice; 600,000 take some 250 MB of it."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs.coalesce(parts_for(docs)), capacity, end_id, tokenizer, with_ids, keep_words))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    base = counts.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("base"))
    plan = spark.createDataFrame(best_fit(histogram, capacity), "length long, first long, n long, seq long, at long, per long")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own_rank"))
    slot = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(plan), "length").where((slot >= 0) & (slot < F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("seq + (rank - first) div per").alias("sequence_id"), F.expr("at + (rank - first) % per * length").alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, parts): the packed sequences themselves, of what pack(with_ids=True) gives; each holds capacity ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("parts"))
