import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tracewright.llm.common import tokenizer_path, word_bpe
from tracewright.llm.packing import best_fit, pack, sequences
from tracewright.llm.token_files import TOKENIZER, read_tokens, with_crc, write_tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(tokenizer_path(TOKENIZER))


def ids_of(bpe, text):
    return bpe.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "\n", ".", ",", "'s", "9", "é", "<|", "  ", "<|endoftext|>", "\t", "\u00a0", "ß", "!", "日"]), max_size=14).map("".join))
def test_cached_words_equal_the_library(text):
    own = word_bpe(tokenizer_path(TOKENIZER))
    assert own.encode([text])[0] == own.whole(text)


def test_token_files_round_trip(spark, bpe, tmp_path):
    docs = cases.awkward(spark)
    write_tokens(docs, str(tmp_path / "t"), files=3)
    got = [tuple(r) for r in read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.doc_id, r.text or "") for r in docs.collect())
    start = 0
    for (_, doc_id, text), r in zip(rows, got, strict=True):
        want = [*ids_of(bpe, text), 0]
        assert r == (doc_id, start, len(want), want)
        start += len(want)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in with_crc(read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert all(sums[r[0], r[1]] == crc(r[3]) for r in got)
    few = read_tokens(spark, str(tmp_path / "t"), [2, 9]).collect()
    assert sorted(r.doc_id for r in few) == [2, 9] and {r.start for r in few} == {r[1] for r in got if r[0] in (2, 9)}


def test_token_files_of_one_id_span_files(spark, bpe, tmp_path):
    rng = random.Random(3)
    texts = [cases.prose(rng, 20) for _ in range(400)]
    write_tokens(spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string"), str(tmp_path / "t"), files=6)
    assert sum(orc.ORCFile(f).nrows > 0 for f in (tmp_path / "t").glob("part-*.orc")) >= 5
    got = read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert sorted(tuple(r.ids) for r in got) == sorted((*ids_of(bpe, t), 0) for t in texts)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 200


def test_token_files_have_stripes_and_bloom_filters(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, cases.prose(rng, 200)) for i in range(300)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), files=1)
    files = list((tmp_path / "t").glob("part-*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 300
    assert all(orc.ORCFile(f).nstripes >= 1 and orc.ORCFile(f).compression == "ZSTD" for f in files)
    plain = spark.read.orc(str(tmp_path / "t")).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plain
    # a file without the option is smaller by its Bloom filter streams
    spark.read.orc(str(tmp_path / "t")).coalesce(1).write.option("orc.compress", "ZSTD").orc(str(tmp_path / "plain"))
    assert sum(f.stat().st_size for f in files) > sum(f.stat().st_size for f in (tmp_path / "plain").glob("part-*.orc"))


def test_empty_tables(spark, tmp_path):
    write_tokens(cases.empty(spark), str(tmp_path / "t"))
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert pack(cases.empty(spark)).count() == 0


def test_packing(spark, bpe):
    docs = cases.awkward(spark)
    got = pack(docs, capacity=64, with_ids=True).collect()
    whole: dict = {}
    for r in docs.collect():
        whole.setdefault(r.doc_id, []).append([*ids_of(bpe, r.text), 2])
    for r in got:
        ids = whole[r.doc_id][0][r.start : r.start + r.length]
        assert list(r.ids) == ids and crc(ids) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
    assert sum(r.length for r in got) == sum(len(x) for v in whole.values() for x in v)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    rows = sequences(pack(docs, capacity=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in rows) == sum(r.length for r in got) and all(len(r.ids) <= 64 for r in rows)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, free in enumerate(bins) if free >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_counts_pack_like_documents(lengths):
    counts: dict = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    placed: dict = {}
    for length, first, n, seq, at, per in best_fit(counts, 32):
        for i in range(n):
            placed.setdefault(seq + i // per, []).append((at + i % per * length, length))
        assert first + n <= counts[length]
    assert sum(map(len, placed.values())) == len(lengths)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert len(placed) == plain_best_fit(lengths, 32)
