"""What the training-data operators share: shared-folder checkpoints, Arrow batching, words, tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import scratch, shared_dir

#: White space of the word rules: space and the control characters 9 to 13. bytes.split() uses the same set.
SPACE = r"[\x20\x09-\x0D]+"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of scratch(), in whatever store the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


PART_BYTES = 6 << 20  # of input for each file of an intermediate table
LEAST_PARTS = 8  # so that small inputs are still worked on by several tasks


def parts_for(df: DataFrame) -> int:
    """How many files a table about as large as df should have, by the planner's estimate of its bytes: a table written as one file for each
    shuffle partition would be thousands of small files where its input is small. Only lowers the number of partitions, never raises it."""
    return max(LEAST_PARTS, min(1_000_000, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)))


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df, computed once, in the shared folder, in `parts` files at most; lost executors don't take it along. Cleaned when unreferenced, if
    the session says so."""
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder, in `parts` files at most: smaller than a checkpoint, and its size is
    known to the planner."""
    path = scratch(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in batches of some 8 MB: the usual 10,000 rows of long texts would take hundreds of MB.

    Sets the session's spark.sql.execution.arrow.maxBytesPerBatch, which holds for later Arrow batches as well."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch whose texts hold about `most` bytes at most (one row at least)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def forget_tokenizers() -> None:
    """Drops the tokenizers, with the words that they remember, which an earlier stage's tasks have left in this worker."""
    if _TOKENIZERS:
        _TOKENIZERS.clear()
        gc.collect()
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives back the memory that it no longer uses: workers wait for other tasks, and what they keep adds up.

    Tasks that don't tokenize have no use for an earlier stage's tokenizers, and drop them first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizes:
            forget_tokenizers()
        yield from run(batches)
        give_back()

    return wrapped


_TOKENIZERS: dict[tuple[str, int], object] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; TOKENIZER_DIR or a full path overrides the installed one."""
    if os.path.isabs(name):
        return name
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCachedBPE:
    """ids of whole texts from a byte-level BPE file of the tokenizers library, remembering the ids of words.

    The library first splits a text before every space that a visible character follows (and likewise
    before a line break), and merges nothing across, so the ids of a text are those of its pieces.
    Texts with two white-space characters in a row, or a special token, are encoded as a whole.
    """

    OTHER = re.compile(r"[^\S \n]")  # white space but a space or a line break

    def __init__(self, path: str, keep: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.keep = keep  # words of a generation that a worker remembers, some 200 bytes each; it has the latest two generations
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens with a space first: only a word's first token
        self.starts[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.line = vocabulary["\u010a"]
        self.marks = {c: self.whole(c) for c in ",."}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str], between: str) -> None:
        """Encodes new words, all after a space or all after a line break, some hundred in a row."""
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        for run, e in zip(runs, self.model.encode_batch_fast([between + between.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.starts[ids] if between == " " else ids == self.line)
            data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
            if len(at) != len(run):
                raise ValueError("this tokenizer merges across words")
            if between == " ":
                self.known.update((w, data[i:j]) for w, i, j in zip(run, (4 * at).tolist(), ends, strict=True))
            else:
                self.known.update(("\n" + w, data[i:j]) for w, i, j in zip(run, (4 * at).tolist(), ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk all words that are open
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out: list = [b""] * len(texts)
        open_: list[tuple[int, list[str], list[bytes | None], list[int]]] = []  # texts with words that aren't known: those words' places
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in ("  ", " \n", "\n ", "\n\n", "<|")) or text[0] in " \n" or text[-1] in " \n" or self.OTHER.search(text):
                out[k] = self.whole(text)
                continue
            w = text.replace("\n", " \n").split(" ")
            w[0] = "\0" + w[0]  # without a space before it
            ids = list(map(known.get, w))
            if missing := [i for i, y in enumerate(ids) if y is None]:
                open_.append((k, w, ids, missing))
            else:
                out[k] = b"".join(ids)
        new = {w[i] for _, w, _, missing in open_ for i in missing}
        spaced, lined, made = set(), set(), []
        for x in new:
            if (ids := older.get(x)) is not None:
                known[x] = ids
                continue
            first = x[0]
            core = x[:-1] if x[-1] in ",." and x[first in "\0\n" : -1].isalpha() else x  # a mark after letters stands alone
            if first == "\0":
                core = "\n" + core[1:]
            if core != x:
                made.append((x, core))
            if core not in known:
                (lined.add(core[1:]) if core[0] == "\n" else spaced.add(core))
        self.learn(list(spaced), " ")
        self.learn(list(lined), "\n")
        for x, core in made:
            ids = known[core]
            if x[0] == "\0":
                ids = ids[4:]
            known[x] = ids + self.marks[x[-1]] if len(x) > len(core) else ids
        for k, w, ids, missing in open_:
            for i in missing:
                ids[i] = known[w[i]]
            out[k] = b"".join(ids)
        return out


def word_bpe(path: str, keep: int = 600_000) -> WordCachedBPE:
    if (path, keep) not in _TOKENIZERS:
        _TOKENIZERS[path, keep] = WordCachedBPE(path, keep)
    return _TOKENIZERS[path, keep]
