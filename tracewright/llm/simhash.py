"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint makes all its variants within half the radius (1 + 64 + 2016 = 2081 for radius 4);
two fingerprints within the radius share a variant, and owners of one variant are within the radius of each
other. Rows of (variant, fingerprint) would be some 33 KB for each fingerprint, so the variants travel packed,
in two rounds:

1. each chunk of fingerprints sends its variants' mixed and shortened codes, sorted and Rice-coded (the low bits of
   a difference as they are, the others in unary), to the partition of their range; there the codes that occur
   twice are found (short codes may also meet by chance). A code has log2(fingerprints) bits more than a difference
   needs within a chunk, so it takes log2(number of chunks) + 8 bits about, and grows by a bit for twice the table;
2. only variants with such a code travel whole, with their fingerprint; equal variants give links to the
   smallest owner, which are verified by their differing bits.

No group is gathered by a key of the data: mixed codes are spread evenly, a variant has at most 2081 owners,
and links are stars. Texts that are equal share a fingerprint and take part once.

Defined cases: a null text is empty; a text without words has fingerprint 0 and is linked like any other;
fewer than `width` words: the whole sequence is the only shingle; rows with one doc_id are one document's rows
and share its component if their fingerprints do; null doc_ids are kept and are no component's smallest id
unless the component has no other (then component_id is null); an empty table gives an empty result;
columns other than doc_id and text are ignored; a very long text's shingles are hashed and counted in blocks,
so it takes some hundred bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import LEAST_PARTS, checkpointed, parts_for, tidy, whole_texts
from tracewright.operators.graph import components

CHUNK = 8192  # fingerprints whose codes one task holds at a time: 136 MB
BLOCK = 512  # fingerprints whose variants are made at a time
CODES = 6_000_000  # codes in a partition of the first round
PAIRS = 1_000_000  # (variant, fingerprint) in a partition of the second round


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text (UTF-8), as an unsigned integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    found, ones = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, hash, fp): the text's hash and the fingerprint of each row, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) if t else 0 for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole_texts(rows).mapInArrow(tidy(run), f"doc_id {kind}, hash long, fp long")


def masks(radius: int, bits: int = 64) -> np.ndarray:
    """All words of `bits` bits with at most `radius` ones."""
    from itertools import combinations

    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads neighbours evenly (the splitmix64 finaliser)."""
    x = x.copy()
    shifted = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=shifted)
        x ^= shifted
        x *= np.uint64(factor)
    return x


def pack(codes: np.ndarray) -> bytes:
    """Sorted unsigned codes as Rice-coded differences: k low bits each (whole bytes, then the odd bits), the rest in unary."""
    deltas = np.diff(codes, prepend=np.uint64(0))
    k = max(0, int(float(codes[-1]) * 0.69 / len(codes)).bit_length() - 1)
    head = bytes([k]) + len(codes).to_bytes(8, "little")
    low = deltas & np.uint64((1 << k) - 1)
    whole = np.ascontiguousarray(low.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, : k // 8].tobytes()
    odd = np.packbits(((low >> np.uint64(k // 8 * 8)).astype(np.uint8)[:, None] >> np.arange(k % 8, dtype=np.uint8)) & 1).tobytes()
    marks = np.cumsum((deltas >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(marks[-1]) + 1, bool)
    unary[marks] = True
    return head + whole + odd + np.packbits(unary).tobytes()


def unpack(data: bytes) -> np.ndarray:
    k, n = data[0], int.from_bytes(data[1:9], "little")
    at, odd = 9 + n * (k // 8), k % 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : k // 8] = np.frombuffer(data, np.uint8, n * (k // 8), 9).reshape(n, k // 8)
    to = at + -(-n * odd // 8)
    if odd:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, to - at, at), count=n * odd).reshape(n, odd)
        wide[:, k // 8] = (bits << np.arange(odd, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    marks = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, to)))[:n]
    high = np.diff(marks, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum(wide.view("<u8").ravel() + (high << np.uint64(k)), dtype=np.uint64)


def ball_links(fps: DataFrame, radius: int = 4, files: int | None = None) -> DataFrame:
    """(a, b): links among the distinct longs of fps (fp) that differ in at most `radius` bits, as stars around the
    smallest (unsigned) owner of each shared variant. Their components are those of all links. files: of intermediate tables at most."""
    flips = masks((radius + 1) // 2)
    per = len(flips)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, at = [], 0

        def row(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + at], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["chunk", "n", "fps"])

        for b in batches:
            held.append(np.asarray(b.column(0)))
            while sum(map(len, held)) >= CHUNK:
                x = np.concatenate(held)
                yield row(x[:CHUNK])
                held, at = [x[CHUNK:]], at + 1
        if sum(map(len, held)):
            yield row(np.concatenate(held))

    made = checkpointed((fps.coalesce(files) if files else fps).select("fp").mapInArrow(chunks, "chunk long, n long, fps binary"))
    n, number = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(number, 10_000))  # a chunk of 64 KB makes 136 MB of variants, so its bytes say little of its work
    parts = max(1, -(-n * per // CODES))
    width = min(64, max(1, n * per * 64).bit_length())  # bits of a code: 1 in 64 meets another by chance at most
    cut = np.uint64(64 - width)

    def variants(own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The mixed variants of some fingerprints at a time, after the place of the first of these."""
        for i in range(0, len(own), BLOCK):
            yield i, mix((own[i : i + BLOCK, None] ^ flips[None, :]).ravel())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [(p << width) // parts for p in range(parts + 1)]
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, "<u8")
                codes = np.empty(len(own) * per, np.uint64)
                for i, found in variants(own):
                    np.right_shift(found, cut, out=codes[i * per : i * per + len(found)])
                codes.sort()
                at = np.searchsorted(codes, np.array(first[1:-1], np.uint64)).tolist()
                for p, (i, j) in enumerate(zip([0, *at], [*at, len(codes)], strict=True)):
                    if j > i:
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([chunk], pa.int64()), pa.array([pack(codes[i:j] - np.uint64(first[p]))], pa.binary())], ["part", "chunk", "codes"])

    def twice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = (int(key[0]) << width) // parts
        all_codes = np.concatenate([unpack(x) for x in rows["codes"]])
        all_codes.sort()
        met = np.unique(all_codes[1:][all_codes[1:] == all_codes[:-1]])
        del all_codes
        out = []
        for chunk, sent in zip(rows["chunk"], rows["codes"] if len(met) else [], strict=bool(len(met))):
            codes = unpack(sent)
            at = np.minimum(np.searchsorted(codes, met), len(codes) - 1)
            own = met[codes[at] == met]
            if len(own):
                out.append((chunk, len(own), pack(own), base))
        return pd.DataFrame(out, columns=["chunk", "n", "met", "base"])

    # explicit numbers of partitions: rows are few and heavy, so neither the session's number nor their bytes say how many tasks they need
    coded = made.select("chunk", "fps").repartition(tasks).mapInArrow(tidy(send), "part long, chunk long, codes binary").repartition(min(parts, 100_000), "part")
    met = checkpointed(coded.groupBy("part").applyInPandas(twice, "chunk long, n long, met binary, base decimal(20,0)"), parts)
    pairs = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spread = max(1, -(-int(pairs) // PAIRS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array([(p << 64) // spread for p in range(1, spread)], np.uint64)
        for b in batches:
            for data, sent in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wanted = np.concatenate([unpack(x["met"]) + np.uint64(int(x["base"])) for x in sent])
                wanted.sort()
                seen = np.zeros(1 << 22, bool)  # by the codes' last bits: most variants need no search
                seen[wanted & np.uint64(len(seen) - 1)] = True
                own, keys, owners = np.frombuffer(data, "<u8"), [], []
                for i, codes in variants(own):
                    short = codes >> cut
                    hit = np.flatnonzero(seen[short & np.uint64(len(seen) - 1)])
                    short = short[hit]
                    hit = hit[wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short]
                    keys.append(codes[hit])
                    owners.append(own[i + hit // per])
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(keys)
                keys, owners = keys[order], owners[order]
                at = np.searchsorted(keys, first).tolist()
                for p, (i, j) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)):
                    if j > i:
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([keys[i:j].tobytes()], pa.binary()), pa.array([owners[i:j].tobytes()], pa.binary())], ["part", "variants", "owners"])

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in rows["variants"]])
        owners = np.concatenate([np.frombuffer(x, "<u8") for x in rows["owners"]])
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        least = np.repeat(owners[starts], np.diff(np.append(starts, len(keys))))
        near = (owners != least) & (np.bitwise_count(owners ^ least) <= radius)
        found = np.unique(np.stack([least[near], owners[near]], axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})

    spread_tasks = 4 * tasks  # dealt by hash, several of as many chunks as tasks would meet in one
    sent = met.repartition(spread_tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("met", "base")).alias("sent"))
    hits = made.repartition(spread_tasks, "chunk").join(sent, "chunk").select("fps", "sent").mapInArrow(tidy(whole), "part long, variants binary, owners binary")
    return hits.repartition(min(spread, 100_000), "part").groupBy("part").applyInPandas(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, hash, fp, fingerprint, component_id) for every row of docs; hash: of its text."""
    files = parts_for(docs)
    few = max(LEAST_PARTS, files // 4)  # tables of a few numbers for each row
    own = checkpointed(fingerprints(docs, width), files)
    nodes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")), few)
    roots = components(ball_links(nodes, radius, few), few, loops=False).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(checkpointed(least, few), "root").select("fp", "component_id")
    of = nodes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # read from a table, both sides of the join are shuffled for it alone, so that Spark can split a fingerprint that many documents share
    return own.join(checkpointed(of, few), "fp").select("doc_id", "hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """docs without the rows of a group that don't have its smallest doc_id; a group of null ids only stays whole."""
    return without(docs, near_duplicates(docs, radius, width).where("doc_id is not null and doc_id <> component_id"))


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text's hash are in drop: of several texts of one doc_id, those not meant stay."""
    gone = drop.select(F.col("doc_id").alias("gone"), F.col("hash").alias("gone_hash")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column's name can clash
    return own.join(gone, F.xxhash64("row.text").eqNullSafe(F.col("gone_hash")) & F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
