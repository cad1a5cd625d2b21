"""Language-model scores from a log-frequency Bloom filter.

Counting: each task hashes words, sums the counts of words and word pairs over some million tokens and sends
them, sorted and packed, to segments of the hash range. A segment of words keeps exact counts; a segment of pairs
becomes a part of the Bloom filter: a pair whose count has quantised logarithm q (steps of `growth`) is
entered as (pair, 1) to (pair, q). A reader probes (pair, 1), (pair, 2), ... until a probe fails, which gives
the count to within a step; a wrong hit needs all of a level's bits to be set by others.

Score: p(w | h) = (c(h w) + mu p0(w)) / (c(h) + mu), with c(h w) from the filter, c(h) and p0 from the words,
p0 = (c(w) + 0.1) / (N + 0.1 (V + 1)), the base model. The word before the first is a start mark; an end token
follows the last word. c(h w) is taken as at most c(h).

Size: both structures grow with the corpus, so their bytes are summed before anything is broadcast. Up to `limit_mb` they
travel whole, and the documents are read once more. Beyond it the texts' distinct (document, context, word) go to the model instead:
joined with the words' counts, and then dealt by the context's segment, where they meet that segment's counts and
filter (a pair lies in its first word's segment), and their logarithms are summed by document. A segment that gets more than TUPLES of
them is copied to several tasks. So the work is linear in the corpus: two shuffles of some 30 bytes a distinct pair of a
document. The scores are the same but for the last bits, and a worker holds one segment.

Accuracy: a count is known to a step of `growth` (1.5), the middle of which is taken, so it is off by a quarter at most, and exact
up to 3; with 8 bits an entry and 5 probes an absent level is taken for a present one in 2.2% of probes, so about one pair in 45 counts a level too
high. Probabilities of one context are estimates that sum to 1 only about: the exact interpolation does, rounding of counts and
wrong hits move the sum by these shares.

Learning takes documents whose crc32(doc_id as text) mod 10 is not 0; a null doc_id has remainder 0.

Defined cases: a null or empty text is the end token alone; with nothing to learn from, N = V = 0 and p0 is 1 / 1;
equal rows all count and are all scored; an empty table gives an empty result; other columns are ignored. Words
are told apart by 64-bit hashes: a million million pairs of words meet by chance with less than 1 in 10 million. A very
long text's tokens are held as numbers, some hundred bytes each, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpointed, id_crc, parts_for, slices, stored, tidy, whole_texts
from tracewright.llm.simhash import mix

END = np.uint64(0xE4D0F7E7_0000_0001)
START = np.uint64(0x57A27000_0000_0001)
CHUNK = 1_000_000  # tokens that a task counts at a time
SEGMENT_BYTES = 12_000_000  # text bytes for each segment, about
TUPLES = 4_000_000  # pairs that a copy of a segment is asked for
PROBES = 5
BITS = 8  # of the filter for each entry


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts as 64-bit hashes, END after each text; where each text starts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    end = int(END)
    out: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(out))
        out += map(digest, t.lower().split())
        out.append(end)
    return np.array(out, np.uint64), np.array(starts, np.int64)


def before(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each token's preceding one; START at the start of a text."""
    prior = np.empty_like(tokens)
    prior[1:] = tokens[:-1]
    prior[starts] = START
    return prior


def pair(prior: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(mix(prior) + tokens)


def segment(words: np.ndarray, segments: int) -> np.ndarray:
    return ((mix(words) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def levels(counts: np.ndarray, growth: float) -> np.ndarray:
    """Quantised logarithms, 1 for a count of 1."""
    return 1 + np.floor(np.log(counts) / math.log(growth) + 1e-9).astype(np.int64)


def meant(level: np.ndarray, growth: float) -> np.ndarray:
    """The count that a level stands for: the middle of the whole numbers that it covers; 0 for level 0."""
    low = np.ceil(growth ** (level - 1.0) - 1e-6)
    return np.where(level > 0, (low + np.maximum(low, np.ceil(growth**level - 1e-6) - 1)) / 2, 0.0)


def bits(keys: np.ndarray, level: int | np.ndarray, size: int | np.ndarray) -> Iterator[np.ndarray]:
    """Places of (key, level) in a filter of `size` bits."""
    one = mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    two = mix(one ^ np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for k in range(PROBES):
        yield (one + np.uint64(k) * two) % np.asarray(size, np.uint64)


class Filter:
    """Bloom segments, one after another; segment s has sizes[s] bits (0: not here) from byte firsts[s]."""

    def __init__(self, data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, growth: float):
        self.data, self.firsts, self.sizes, self.growth = data, firsts, sizes, growth

    def counts(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Counts from repeated membership probes."""
        level = np.zeros(len(keys), np.int64)
        first, size = self.firsts[segments], self.sizes[segments]
        live = np.flatnonzero(size > 0)
        at = 0
        while len(live):
            at += 1
            held = np.ones(len(live), bool)
            for place in bits(keys[live], at, size[live]):
                byte = self.data[first[live] + (place >> np.uint64(3)).astype(np.int64)]
                held &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[held]
            level[live] = at
            if at > 400:
                break  # no count of 64 bits has as many levels
        return meant(level, self.growth)


def counted(docs: DataFrame, segments: int, growth: float) -> DataFrame:
    """(kind, segment, n, total, size, data): kind 1 has exact counts of words, kind 2 a Bloom segment of pairs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            words, n = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
            # a pair's segment is its first word's: sort by segment, then pair
            prior = np.concatenate([y for _, y in held])
            keys = pair(prior, np.concatenate([x for x, _ in held]))
            keys, first, m = np.unique(keys, return_index=True, return_counts=True)
            for kind, k, c, s in ((1, words, n, segment(words, segments)), (2, keys, m, segment(prior[first], segments))):
                order = np.argsort(s, kind="stable")
                k, c, s = k[order], c[order].astype("<u4"), s[order]
                at = np.searchsorted(s, np.arange(segments + 1, dtype=np.uint64)).tolist()
                used = [i for i in range(segments) if at[i + 1] > at[i]]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int64()), pa.array([k[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()), pa.array([c[at[i] : at[i + 1]].tobytes() for i in used], pa.binary())], ["kind", "segment", "keys", "counts"])
            held.clear()

        for b in batches:
            for i, j in slices(b, "t"):
                tokens, starts = hashes([x or b"" for x in b.column(0).slice(i, j - i).to_pylist()])
                held.append((tokens, before(tokens, starts)))
                if sum(len(x) for x, _ in held) >= CHUNK:
                    yield from out()
        if held:
            yield from out()

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        total = int(counts.sum())
        if key[0] == 1:
            data, size = keys.astype("<u8").tobytes() + counts.astype("<i8").tobytes(), 0
        else:
            level = levels(counts, growth)
            size = -(-int(level.sum()) * BITS // 8) * 8
            filled = np.zeros(size, bool)
            for at in range(1, int(level.max()) + 1):
                for place in bits(keys[level >= at], at, size):
                    filled[place] = True
            data = np.packbits(filled, bitorder="little").tobytes()
        return pd.DataFrame({"kind": [key[0]], "segment": [key[1]], "n": [len(keys)], "total": [total], "size": [size], "data": [data]})

    sent = whole_texts(docs.select(F.col("text").cast("binary").alias("t"))).mapInArrow(tidy(send), "kind int, segment long, keys binary, counts binary")
    return sent.groupBy("kind", "segment").applyInPandas(build, "kind int, segment long, n long, total long, size long, data binary")


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words and their counts that a segment of kind 1 holds."""
    n = len(data) // 16
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n)


def exact(keys: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Counts of x from sorted keys; 0 for others."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, counts[at], 0).astype(np.int64)


def smoothed(counts: np.ndarray, seen: np.ndarray, base: np.ndarray, mu: float) -> np.ndarray:
    """log10 p(w | h)."""
    return np.log10((np.minimum(counts, seen) + mu * base) / (seen + mu))


def dealt(rows: DataFrame, model: DataFrame, segments: int, floor: float, total: int, starts_n: int, growth: float, mu: float) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score): the sums of each row of texts (row, text), whose pairs go to the model's segments."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b, "t"):
                tokens, starts = hashes([x or b"" for x in b.column(1).slice(i, j - i).to_pylist()])
                prior, of = before(tokens, starts), np.repeat(np.arange(j - i), np.diff(np.append(starts, len(tokens))))
                _, first, n = np.unique(np.stack([of.astype(np.uint64), pair(prior, tokens)], axis=1), axis=0, return_index=True, return_counts=True)
                own = [np.asarray(b.column(0).slice(i, j - i))[of[first]], tokens[first].view(np.int64), prior[first].view(np.int64), segment(prior[first], segments).astype(np.int64), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, own)), ["row", "w", "h", "segment", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                keys, counts = words_in(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "c"])

    texts = whole_texts(rows.select("row", F.col("text").cast("binary").alias("t")))
    told = texts.mapInArrow(tidy(tell), "row long, w long, h long, segment long, n long")
    counts = model.where("kind = 1").select("data").mapInArrow(spell, "w long, c long")
    # an outer join whose large side Spark can split where a word is in most texts
    known = stored(told.join(counts, "w", "left").withColumn("c", F.coalesce("c", F.lit(0))), "told")
    copies = known.groupBy("segment").agg(F.ceil(F.count("*") / TUPLES).cast("int").alias("copies"))
    copies = stored(copies, "copies", parts_for(known))  # a row for each segment
    number = copies.agg(F.coalesce(F.sum("copies"), F.lit(1))).first()[0]
    none = {"data": "binary", "size": "long", "row": "long", "w": "long", "h": "long", "n": "long", "c": "long"}

    def shaped(df: DataFrame, kind) -> DataFrame:
        return df.select("segment", "copy", kind.alias("kind"), *[(F.col(k) if k in df.columns else F.lit(None).cast(t).alias(k)) for k, t in none.items()])

    held = shaped(model.join(copies, "segment").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), F.col("kind"))
    asked = shaped(known.join(F.broadcast(copies) if segments <= 1_000_000 else copies, "segment").withColumn("copy", F.pmod(F.xxhash64("row", "w"), F.col("copies")).cast("int")), F.lit(3))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, seen_counts, bloom = None, np.empty(0, np.uint64), np.empty(0, np.int64), None
        for b in batches:
            at = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], axis=1)
            kinds = np.asarray(b.column(2))
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1]), [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if place != tuple(at[i]):
                    place, keys, seen_counts, bloom = tuple(at[i]), np.empty(0, np.uint64), np.empty(0, np.int64), None
                if kinds[i] == 1:
                    keys, seen_counts = words_in(b.column(3)[i].as_py())
                elif kinds[i] == 2:
                    bloom = Filter(np.frombuffer(b.column(3)[i].as_py(), np.uint8), np.zeros(1, np.int64), np.array([b.column(4)[i].as_py()], np.int64), growth)
                else:
                    own = [np.asarray(b.column(k).slice(i, j - i)) for k in range(5, 10)]
                    w, h, n, c = own[1].view(np.uint64), own[2].view(np.uint64), own[3], own[4]
                    base = (c + 0.1) / floor if total else np.ones(len(w))
                    seen = np.where(h == START, starts_n, exact(keys, seen_counts, h))
                    met = bloom.counts(pair(h, w), np.zeros(len(w), np.int64)) if bloom else np.zeros(len(w))
                    columns = [own[0], n, n * (c > 0), n * np.log10(base), n * smoothed(met, seen, base, mu)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["row", "n_tokens", "n_known", "base_score", "score"])

    both = held.union(asked).repartition(int(min(max(number, 1), 100_000)), "segment", "copy").sortWithinPartitions("segment", "copy", "kind")
    sums = both.mapInArrow(tidy(probe), "row long, n_tokens long, n_known long, base_score double, score double")
    return sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])


def score(docs: DataFrame, growth: float = 1.5, mu: float = 50.0, limit_mb: int = 512, segments: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (id_crc() % 10 == 0).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    if segments is None:
        segments = max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SEGMENT_BYTES))
    model = checkpointed(counted(rows.where("not held_out"), segments, growth), parts_for(docs))
    found = {r["kind"]: r for r in model.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.octet_length("data")).alias("bytes")).collect()}  # two rows
    total, vocabulary = (found[1]["total"], found[1]["n"]) if 1 in found else (0, 0)
    size = {kind: r["bytes"] for kind, r in found.items()}
    whole = sum(size.values()) <= limit_mb << 20
    starts_n = rows.where("not held_out").count()
    floor = total + 0.1 * (vocabulary + 1)

    if not whole:
        sums = dealt(rows, model, segments, floor, total, starts_n, growth, mu)
        scored = rows.select("row", "doc_id", "held_out").join(sums, "row")
        return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

    def words_of() -> tuple[np.ndarray, np.ndarray]:
        n = size.get(1, 0) // 16
        keys, counts, at = np.empty(n, np.uint64), np.empty(n, np.int64), 0
        for r in model.where("kind = 1").select("data").toLocalIterator():
            own, c = words_in(bytes(r["data"]))
            keys[at : at + len(own)], counts[at : at + len(own)] = own, c
            at += len(own)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        return keys, counts.astype(np.uint32) if not n or counts.max() < 1 << 32 else counts

    def pairs_of() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, at = np.empty(size.get(2, 0), np.uint8), 0
        firsts, filled = np.zeros(segments, np.int64), np.zeros(segments, np.int64)
        for r in model.where("kind = 2").select("segment", "size", "data").toLocalIterator():
            part = np.frombuffer(bytes(r["data"]), np.uint8)
            data[at : at + len(part)], firsts[r["segment"]], filled[r["segment"]] = part, at, r["size"]
            at += len(part)
        return data, firsts, filled

    own, blooms = spark.sparkContext.broadcast(words_of()), spark.sparkContext.broadcast(pairs_of())  # limit_mb at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = own.value
        bloom = Filter(*blooms.value, growth)
        for b in batches:
            for i, j in slices(b, "t"):
                tokens, starts = hashes([x or b"" for x in b.column(2).slice(i, j - i).to_pylist()])
                words, back = np.unique(tokens, return_inverse=True)
                c = exact(keys, counts, words)
                base = (c + 0.1) / floor if total else np.ones(len(words))
                prior = before(tokens, starts)
                both, first_at, again = np.unique(pair(prior, tokens), return_index=True, return_inverse=True)
                h, w = prior[first_at], back[first_at]
                seen = np.where(h == START, starts_n, exact(keys, counts, h))
                p = smoothed(bloom.counts(both, segment(h, segments)), seen, base[w], mu)
                n = np.diff(np.append(starts, len(tokens)))
                columns = [n, np.add.reduceat((c > 0)[back].astype(np.int64), starts), np.add.reduceat(np.log10(base)[back], starts), np.add.reduceat(p[again], starts)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(2)), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.select("doc_id", "held_out", F.col("text").cast("binary").alias("t"))
    scored = whole_texts(texts).mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
