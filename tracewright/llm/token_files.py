"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Texts are range-partitioned by doc_id and encoded where they land, so a file holds one range of ids in
ascending order and the text, not the larger token list, is shuffled. Each row carries its place among its file's tokens;
the few totals of the files give the place in the whole. Readers take stripes in parallel; a filter on doc_id
skips files and stripes by their statistics and row groups by Bloom filter.

Defined cases: a null text is empty and gives only the end id; a null doc_id comes first; equal doc_ids are
ordered by their texts' hashes, so that they can span files, equal rows each give a row; an empty table gives files without rows; other columns are ignored; a very
long text is encoded by itself, a row of its ids (four bytes each) in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import LEAST_PARTS, slices, tokenizer_path, whole_text, whole_texts, word_bpe

TOKENIZER = "byte_bpe_50k.json"
FILE_BYTES, MOST_FILES = 16 << 20, 100_000  # beyond 1.6 TB files grow with the input


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0, files: int | None = None, stripe_mb: int = 16, stride: int = 1000, fpp: float = 0.01) -> None:
    """Writes (doc_id, shard, place, n_tokens, ids) as ORC files, in ascending doc_id order over the files.

    files: how many ranges; by default one for FILE_BYTES of the input, at least LEAST_PARTS and at most MOST_FILES, whatever the session's setting."""
    model = tokenizer_path(tokenizer)
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, place, bpe = TaskContext.get().partitionId(), 0, word_bpe(model)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i, j in slices(b, "text"):
                part = b.slice(i, j - i)
                ids = [x + end for x in bpe.encode(part.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shard] * len(n), pa.int32()), pa.array(offsets[:-1] + place, pa.int64()), pa.array(n, pa.int64()), lists], ["doc_id", "shard", "place", "n_tokens", "ids"])
                place += int(n.sum())

    bytes_ = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = files or max(LEAST_PARTS, min(MOST_FILES, bytes_ // FILE_BYTES))
    tied = rows.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    writer = whole_texts(ordered).mapInArrow(encode, f"doc_id {kind}, shard int, place long, n_tokens long, ids array<int>").write
    for key, value in {"orc.compress": "ZSTD", "orc.stripe.size": stripe_mb << 20, "orc.create.index": "true", "orc.row.index.stride": stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": fpp}.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); with doc_ids only theirs, found by metadata. start counts all tokens before."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row for each file; the window runs over no more than that
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = np.asarray(lists.offsets).tolist()
            data = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
