"""Token counts of whole texts by byte-pair merging, without making any token's id.

A text is cut into pieces as the tokenizer cuts it; merges never cross a piece. A piece starts as a linked list of
its bytes' symbols; the adjacent pair of the lowest rank is popped from a heap, again and again, and its two symbols
become one. The piece's count is the number of its bytes less the merges. Counts of words are remembered by each
worker (a bounded number: beyond it older ones are counted anew), so a text costs a look-up for each word.

Between two visible characters a single space or line break always starts a piece, so texts are split there, and
what stands between is looked up as a whole. Texts with other white space, or special tokens, are cut by the
tokenizer's pattern; texts with characters that this pattern classes differently from the library (younger than
one of the two Unicode tables) by the library's own cutting.

Defined cases: a null text is empty and has no bytes and no tokens; equal rows and equal doc_ids each give a row; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored; a very long text is held once, a
very long word takes some 300 bytes of memory for each of its bytes while it is merged.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tracewright.llm.common import slices, tidy, tokenizer_path, whole_text, whole_texts

TOKENIZER = "byte_bpe_50k.json"

#: Fixed value: the pattern of byte-level BPE tokenizers of this family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What keeps a text from being split at single spaces and line breaks, and white space beyond ASCII.
ODD = ("  ", " \n", "\n ", "\n\n", *map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31)))
WIDE = re.compile(r"[^\S\x00-\x20]")


class Remembered:
    """A function's whole numbers by text, of at most twice `keep` texts: the newest, and those before them that were asked for again."""

    def __init__(self, of: Callable[[str], int], keep: int):
        self.of, self.keep = of, keep
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def total(self, texts: list[str]) -> int:
        counts = list(map(self.known.get, texts))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    counts[i] = self.learn(texts[i])
        return sum(counts)

    def learn(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            n = self.older.get(text)
            if n is None:
                n = self.of(text)
            if len(self.known) >= self.keep:
                self.older, self.known = self.known, {}
            self.known[text] = n
        return n


class MergeCounter:
    """Counts tokens by a byte-level BPE file of the tokenizers library. keep: how many words' counts are remembered, twice."""

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        usual = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not told["normalizer"] and not model.get("ignore_merges") and not model.get("dropout")
        if not usual or any(a[k] for a in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only plain byte-level BPE files can be counted")
        vocabulary = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: by two symbols, shifted into one number: the rank of their merge and the symbol that it makes
        self.pairs = {vocabulary[a] << 32 | vocabulary[b]: (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # other bytes are written as characters from 256 on
        written = dict.fromkeys(printed) | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printed))}
        self.symbols = [vocabulary[written[b] or chr(b)] for b in range(256)]
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = regex.compile(PIECES)
        self.specials = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.classed: dict[str, bool] = {}  # whether the pattern and the library agree on a character
        self.words, self.pieces = Remembered(self.word, keep), Remembered(self.piece, keep)

    def piece(self, piece: str) -> int:
        """Symbols of a piece less its merges."""
        data = piece.encode()
        n = len(data)
        if n < 2:
            return n
        symbols, pairs = [self.symbols[b] for b in data], self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        count = n
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = pairs.get(symbols[i] << 32 | symbols[j])
            if found is None or found[0] != top >> 32:
                continue  # the pair has been merged with a neighbour since
            symbols[i], symbols[j] = found[1], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(symbols[i] << 32 | symbols[k]):
                    heapq.heappush(heap, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] << 32 | symbols[i])):
                heapq.heappush(heap, found[0] << 32 | h)
        return count

    def usual(self, text: str) -> bool:
        """Whether the pattern cuts the text as the library does: so for all ASCII, and for characters that were tried."""
        if text.isascii():
            return True
        for c in set(text):
            if c not in self.classed:
                probe = f"a{c}{c} 1{c}.{c} {c}x"
                self.classed[c] = [at for _, at in self.library.pre_tokenize_str(probe)] == [m.span() for m in self.pattern.finditer(probe)]
            if not self.classed[c]:
                return False
        return True

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        return self.pattern.findall(text) if self.usual(text) else [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]

    def word(self, word: str) -> int:
        """The count of what stands between two single spaces; the first character says when something else is before it."""
        text = word if word[0] == "\n" else word[1:] if word[0] == "\0" else " " + word
        return self.pieces.total(self.pattern.findall(text))

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not any(x in text for x in self.specials):
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD) or not self.usual(text) or (not text.isascii() and WIDE.search(text)):
            return self.pieces.total(self.cut(text))
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]  # nothing before it
        return self.words.total(words)


_COUNTERS: dict[tuple[str, int], MergeCounter] = {}


def count_tokens(docs: DataFrame, limit: int = 512, tokenizer: str = TOKENIZER, keep: int = 600_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs; over_limit: of more than `limit` tokens."""
    path = tokenizer_path(tokenizer)
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, keep) not in _COUNTERS:
            _COUNTERS[path, keep] = MergeCounter(path, keep)
        counter = _COUNTERS[path, keep]
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk all words
        try:
            for b in batches:
                for i, j in slices(b, "text"):
                    part = b.slice(i, j - i)
                    n = pa.array(map(counter.count, part.column(1).to_pylist()), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        finally:
            if collects:
                gc.enable()

    return whole_texts(rows).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
