"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme values.

Model: tokens are runs of letters, A-Z lower-cased. Over all tokens of the labelled training documents, counts by
label are kept for words and for their leading 4, 5 and 6 bytes: exactly, by 64-bit hash, for each that occurs `least` times or
more (others count as unseen), so that a word's counts are its own in a corpus of any number of words. A token's log-odds has a chain of Dirichlet priors: the word's counts are smoothed by those of its longest prefix,
that by the next shorter one's, down to the overall odds; so an unseen form leans on its stem and a rare word on
little. A token's score is its log-odds less `drift`, so that a passage has to gain on every token, and faint
leanings of a language or topic don't add up.

Passages: a linear scan finds every maximal scoring segment of a document (all of them, not the best alone).
Passages whose expected number by chance, K * tokens * exp(-score), is at most `significance` are reported.

Document: t = log(sum exp(passage score)) - log(tokens) follows a Gumbel law in clean documents, which is fitted
by moments over the calibration documents; the surprise -log P(T >= t) is turned into a probability by
isotonic regression over bins of it, both classes counted over the calibration documents.

Labels are used only where crc32(doc_id as text) mod 4 is not 2: remainders 0 and 1 give the counts, remainder 3
calibrates. At most `max_labels` labelled documents are used (a hash sample of the ids above that), so the tables
of labels and of counts sent to workers are bounded; the counts cover these documents' whole texts.

Defined cases: a null or empty text has no passage and the lowest surprise; null doc_ids are scored, never learnt
from; several labels of one id: the largest; where the calibrating fold lacks a class all folds that
may be learnt from calibrate; without labels of both classes nothing can be told apart and every score is 0; where clean documents have passages of one statistic or none, the law has scale 1; equal rows are scored alike;
a very long text is one token list and scanned in linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpointed, id_crc, parts_for, stored, tidy, whole_texts

WORDS = re.compile(rb"[a-z\x80-\xff]+")
PREFIXES = (4, 5, 6)
MAX_LABELS = 2_000_000
RANGES = 64
LEAST = 2  # occurrences
BINS = np.concatenate(([-np.inf], np.linspace(0, 60, 121), [np.inf]))


def features(word: bytes) -> list[int]:
    """Hashes of the word's features: shortest prefix first, the word itself last."""
    import xxhash

    return [xxhash.xxh64_intdigest(p) for p in (*[bytes([n]) + word[:n] for n in PREFIXES if len(word) > n], b"\0" + word)]


class Counts:
    """Exact counts (clean, toxic) by feature, sorted by hash; totals: over all features, also those that are too rare to be kept."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        self.keys, self.counts, self.totals = keys, counts, totals

    def of(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(wanted), 2), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted)[:, None], self.counts[at], 0)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(keys) else counts


def labelled(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, toxic, fold) of the labels that may be learnt from, max_labels about at most; toxic is 0 or 1."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.withColumn("fold", (id_crc() % 4).cast("int")).where("fold <> 2")
    rows = stored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic"), "fold"), "labels", parts_for(labels))
    n = rows.count()
    if n > max_labels:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labels / n))
    return rows


def count_words(docs: DataFrame, labels: pd.DataFrame, least: int = LEAST) -> Counts:
    """Counts of the features in clean and toxic documents of these labels."""
    ids, toxic = labels["doc_id"].to_numpy(np.int64), labels["toxic"].to_numpy(np.int8)
    given = docs.sparkSession.sparkContext.broadcast((ids, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = given.value
        seen = (Counter(), Counter())

        def settled() -> Iterator[pa.RecordBatch]:
            hashes, numbers = [], []
            for c in range(2):
                own = [features(w) for w in seen[c]]
                hashes.append(np.fromiter((h for f in own for h in f), np.uint64))
                numbers.append(np.zeros((len(hashes[c]), 2), np.int64))
                numbers[c][:, c] = np.repeat(np.fromiter(seen[c].values(), np.int64, len(own)), np.fromiter(map(len, own), np.int64, len(own)))
                seen[c].clear()
            keys, counts = added(np.concatenate(hashes), np.concatenate(numbers))
            ranges = (keys >> np.uint64(58)).astype(int)
            edges = np.searchsorted(ranges, np.arange(RANGES + 1))
            for r, (i, j) in enumerate(zip(edges, edges[1:])):
                if j > i:
                    yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([keys[i:j].astype("<u8").tobytes()]), pa.array([counts[i:j].astype("<i8").tobytes()])], ["range", "keys", "counts"])

        for b in batches:
            own, given_id = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(0).is_valid())
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            for i in np.flatnonzero((ids[at] == own) & given_id).tolist():
                seen[toxic[at[i]]].update(WORDS.findall((b.column(1)[i].as_py() or b"").lower()))
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield from settled()
        yield from settled()

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = added(np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]]), np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in rows["counts"]]))
        total, often = counts.sum(axis=0), counts.sum(axis=1) >= least
        return pd.DataFrame({"range": [key[0]], "keys": [keys[often].tobytes()], "counts": [counts[often].tobytes()], "clean": [int(total[0])], "toxic": [int(total[1])]})

    # the driver gets RANGES rows: the features of at most max_labels documents, as Arrow, which isn't decoded and pickled on its way
    sums = whole_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"))).mapInArrow(tidy(run), "range long, keys binary, counts binary").groupBy("range").applyInPandas(add, "range long, keys binary, counts binary, clean long, toxic long")
    found = sums.toArrow().sort_by("range") if len(ids) else pa.table({c: [] for c in ("keys", "counts", "clean", "toxic")})
    given.unpersist()
    parts = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in found[c]]
    keys = np.concatenate([np.zeros(0, np.uint64), *parts("keys", "<u8")])
    counts = np.concatenate([np.zeros(0, np.int64), *parts("counts", "<i8")]).reshape(-1, 2)
    return Counts(keys, counts, np.array([sum(found[c].to_pylist()) for c in ("clean", "toxic")], np.int64))


class Scorer:
    """Log-odds of tokens from the table of counts."""

    KEEP = 200_000

    def __init__(self, table: Counts, strength: float = 20.0, drift: float = 1.0):
        self.table, self.strength, self.drift, self.known = table, strength, drift, {}
        words = table.totals.astype(float) + 1
        self.base = words[1] / words.sum()
        self.offset = math.log(self.base / (1 - self.base))

    def __call__(self, word: bytes) -> float:
        return self.of([word])[0]

    def of(self, words: list[bytes]) -> list[float]:
        """The words' scores: counts of all their features are looked up in one go."""
        own = [features(w) for w in words]
        counts, out, at = self.table.of(np.array([h for f in own for h in f], np.uint64)).tolist(), [], 0
        for f in own:
            p = self.base
            for clean, toxic in counts[at : at + len(f)]:
                p = (toxic + self.strength * p) / (clean + toxic + self.strength)
            at += len(f)
            out.append(math.log(p / (1 - p)) - self.offset - self.drift)
        return out

    def scores(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        words = WORDS.findall(text.lower())
        known = self.known
        if len(known) > self.KEEP:
            known.clear()
        new = list(set(words).difference(known))
        known.update(zip(new, self.of(new), strict=True))
        return np.fromiter(map(known.__getitem__, words), float, len(words)), words


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time (Ruzzo and Tompa).

    Neighbours of one sign are joined first: a maximal segment has whole runs of them."""
    scores = np.asarray(scores, float)
    if not len(scores):
        return []
    starts = np.flatnonzero(np.concatenate(([True], (scores[1:] > 0) != (scores[:-1] > 0))))
    sums, ends = np.add.reduceat(scores, starts), [*starts[1:].tolist(), len(scores)]
    held: list[list] = []  # start, end, sum before, sum up to the end, place of the last one with a smaller sum before
    total = 0.0
    for a, b, s in zip(starts.tolist(), ends, sums.tolist(), strict=True):
        if s > 0:
            new = [a, b, total, total + s, -1]
            while True:
                j = len(held) - 1
                while j >= 0 and held[j][2] >= new[2]:
                    j = held[j][4]
                if j < 0 or held[j][3] >= new[3]:
                    new[4] = j
                    held.append(new)
                    break
                new = [held[j][0], new[1], held[j][2], new[3], -1]
                del held[j:]
        total += s
    return [(a, b, r - left) for a, b, left, r, _ in held]


def statistic(scored: list[tuple[int, int, float]], tokens: int) -> float | None:
    """log(sum exp(passage score)) - log(tokens); None without a passage."""
    if not scored:
        return None
    top = max(s for _, _, s in scored)
    return top + math.log(sum(math.exp(s - top) for _, _, s in scored)) - math.log(tokens)


def surprise(t: np.ndarray, location: float, scale: float) -> np.ndarray:
    """-log P(T >= t) under the Gumbel law."""
    z = (t - location) / scale
    return np.where(z > 30, z, -np.log(-np.expm1(-np.exp(-np.clip(z, -50, 30)))))


def isotonic(bad: np.ndarray, all_: np.ndarray, prior: float) -> np.ndarray:
    """Rising shares of bad by bin (pooled neighbours); each bin has one more count at the overall share."""
    blocks: list[list[float]] = []
    for b, n in zip(bad + prior, all_ + 1.0, strict=True):
        blocks.append([b, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), b / n) for b, n, k in blocks])


class Model:
    """What fit() learns; workers get it by broadcast: 24 bytes for each feature of the labelled documents, of which there are max_labels at most."""

    def __init__(self, table: Counts, base: float, location: float = 0.0, scale: float = 1.0, steps: np.ndarray | None = None):
        self.table, self.base, self.location, self.scale, self.steps = table, base, location, scale, steps

    def probability(self, t: np.ndarray) -> np.ndarray:
        """0 to 1, rising with t; NaN (no passage) gives the lowest."""
        if self.steps is None:
            return np.full(len(t), self.base)
        x = np.where(np.isnan(t), 0.0, surprise(np.nan_to_num(t), self.location, self.scale))
        k = np.clip(np.searchsorted(BINS, x, "right") - 1, 0, len(self.steps) - 1)
        return np.clip(self.steps[k] + 1e-6 * np.minimum(x, 1000) / 1000, 0.0, 1.0)


def statistics(docs: DataFrame, table: Counts, passages: bool = False, location: float = 0.0, significance: float = 0.05) -> DataFrame:
    """(doc_id, t[, passages]): the statistic of each row; passages: (start, end, score, expected) by token of the significant ones."""
    given = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(given.value)
        for b in batches:
            t, found = [], []
            for x in b.column(1):
                values, words = score.scores(x.as_py() or b"")
                own = segments(values)
                t.append(statistic(own, max(1, len(words))))
                if passages:
                    chance = ((i, j, s, math.exp(min(50.0, location + math.log(len(words)) - s))) for i, j, s in own)
                    found.append([dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in chance if p[3] <= significance])
            columns = [b.column(0), pa.array(t, pa.float64())]
            if passages:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", *["passages"] * passages])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("x"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole_texts(rows).mapInArrow(tidy(run), f"doc_id {kind}, t double" + ", passages array<struct<start:long,end:long,score:double,expected:double>>" * passages)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Counts from folds 0 and 1, the Gumbel law and the probabilities from fold 3."""
    known = labelled(labels, max_labels)
    base, every, last = known.agg(F.avg("toxic"), F.countDistinct("toxic"), F.countDistinct(F.when(F.col("fold") == 3, F.col("toxic")))).first()
    base = base or 0.0
    # numbers of 12 bytes a label: rows of the driver's Python would take some hundred
    table = count_words(docs, known.where("fold < 3").select("doc_id", "toxic").toArrow().to_pandas().sort_values("doc_id", ignore_index=True))
    if every < 2:
        return Model(table, 0.0)
    model = Model(table, base)
    ids = (known if last < 2 else known.where("fold = 3")).select("doc_id", "toxic")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")  # bounded by max_labels
    t = checkpointed(statistics(chosen, table).join(ids.hint("merge"), "doc_id"), parts_for(docs))
    clean = t.where("toxic = 0").agg(F.avg("t").alias("m"), F.stddev_samp("t").alias("s")).first()
    if clean["s"] and clean["s"] > 1e-9:  # else equal but for rounding
        scale = clean["s"] * math.sqrt(6) / math.pi
        model.location, model.scale = clean["m"] - 0.5772156649015329 * scale, scale
    elif clean["m"] is not None:
        model.location = clean["m"]
    z = (F.col("t") - model.location) / model.scale
    x = F.when(F.col("t").isNull(), 0.0).when(z > 30, z).otherwise(-F.log(-F.expm1(-F.exp(-F.greatest(F.lit(-50.0), z)))))
    bins = F.when(x < 0, 0).otherwise(F.least(F.lit(len(BINS) - 2), F.floor(x * 2) + 1)).cast("int")
    counts = t.groupBy(bins.alias("bin")).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()  # one row for each bin
    bad, n = np.zeros(len(BINS) - 1), np.zeros(len(BINS) - 1)
    for r in counts:
        bad[r["bin"]], n[r["bin"]] = r["bad"], r["n"]
    model.steps = isotonic(bad, n, base)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All rows of docs as a struct `row`, with score and predicted."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        score = Scorer(model.table)
        for b in batches:
            t = []
            for x in b.column(1):
                values, words = score.scores(x.as_py() or b"")
                t.append(statistic(segments(values), max(1, len(words))))
            p = model.probability(np.array([math.nan if v is None else v for v in t], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("x"))
    return whole_texts(rows).mapInArrow(tidy(run), StructType([StructField("row", rows.schema["row"].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
