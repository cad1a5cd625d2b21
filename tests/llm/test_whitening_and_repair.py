import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tracewright.llm import repair
from tracewright.llm.common import tokenizer_path
from tracewright.llm.token_counts import TOKENIZER, MergeCounter, Remembered, count_tokens
from tracewright.llm.whitening import jacobi, products, shares, sums, whitened

# whitening ------------------------------------------------------------------------------------------------------------


def brute_whitening(vectors, components=16):
    """By vec_id: deviation and absolute whitened values; explained; from exact whole numbers and a general solver."""
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors.items()}
    distinct = sorted({tuple(v) for v in x.values()})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in distinct) / n**3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    mean = np.array([t / n for t in s])
    return n, {k: (sum((n * a - b) ** 2 for a, b in zip(v, s)), np.abs((np.array(v) - mean) @ axes / np.sqrt(e))) for k, v in x.items()}, e / np.trace(cov)


def check_whitening(spark, vectors, got, components=16):
    n, want, explained = brute_whitening(vectors, components)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert set(rows) == set(want)
    for k, (deviation, values) in want.items():
        assert sorted(rows[k]) == list(range(1, len(values) + 1))
        for c, v in enumerate(values, 1):
            r = rows[k][c]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(v, rel=1e-6, abs=1e-7)
            assert r.identity_error < 1e-9


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 20)) * np.geomspace(3, 0.05, 20)
    vectors = {i: np.float32(v).tolist() for i, v in enumerate(base)} | {500 + i: np.float32(base[0]).tolist() for i in range(40)}
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors.items()], "vec_id long, embedding array<float>, x int, d int")
    check_whitening(spark, vectors, whitened(table.repartition(5)))
    check_whitening(spark, vectors, whitened(table, components=3), 3)


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    good = {i: rng.normal(size=4).tolist() for i in range(30)}
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, math.nan, 2.0, 3.0]), (103, [1.0, math.inf, 2.0, 3.0]), (104, [1.0, -math.inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [])]
    rows = [*good.items(), *bad, (None, good[0]), (7, good[7])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    _, want, _ = brute_whitening(good)
    found = got.collect()
    assert len(found) == 4 * 32 and {r.vec_id for r in found} == {*good, None}
    assert all(abs(r.whitened) == pytest.approx(want[r.vec_id if r.vec_id is not None else 0][1][r.component - 1], rel=1e-9) for r in found)
    empty = whitened(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == got.columns
    assert whitened(spark.createDataFrame(bad[:5], "vec_id long, embedding array<double>")).count() == 0


def test_whitening_without_variance_and_with_large_values(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got if r.whitened != 0} == {1} and all(r.identity_error < 1e-9 for r in got)
    one = whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    rng = np.random.default_rng(6)
    huge = [(i, [float(a) * 1e30, float(b), float(c)]) for i, (a, b, c) in enumerate(rng.normal(size=(50, 3)))]
    found = whitened(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 150 and all(r.deviation is None for r in found)
    middle = {i: [float(a) * 1e7, float(b), float(c)] for i, (a, b, c) in enumerate(rng.normal(size=(50, 3)))}
    got = whitened(spark.createDataFrame([*middle.items()], "vec_id long, embedding array<double>")).collect()
    assert all(r.identity_error < 1e-4 for r in got)


def test_jacobi_is_accurate_for_small_eigenvalues():
    d = np.diag(np.geomspace(1e12, 1e-12, 9))
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(9, 9)))
    a = q @ np.diag(np.linspace(1, 2, 9)) @ q.T
    scaled = np.sqrt(d) @ a @ np.sqrt(d)
    values, vectors = jacobi(scaled)
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in scaled]  # the determinant tells whether small eigenvalues are right
    det = Fraction(1)
    for i in range(9):
        det *= exact[i][i]
        for j in range(i + 1, 9):
            f = exact[j][i] / exact[i][i]
            exact[j] = [x - f * y for x, y in zip(exact[j], exact[i])]
    assert float(np.prod(values)) == pytest.approx(float(det), rel=1e-10)
    assert np.abs(vectors.T @ vectors - np.eye(9)).max() < 1e-13
    for n in (0, 1, 2, 5):
        m = np.random.default_rng(n).normal(size=(n, n))
        values, vectors = jacobi(m @ m.T)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, m @ m.T) and list(values) == sorted(values, reverse=True)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 61), 1 << 61) | st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=6))
def test_sums_and_products_are_exact(rows):
    y = np.array(rows, np.int64)
    assert sums(y) == [sum(r[i] for r in rows) for i in range(3)]
    assert products(y).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    for v in (sum(r[0] * r[1] for r in rows), -5, 0):
        assert sum(s << 40 * i for i, s in enumerate(shares(v))) == v and all(abs(s) < 1 << 62 for s in shares(v))


# repair -----------------------------------------------------------------------------------------------------------------


def brute_damage(rows):
    """By conv_id the rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2])) for k, v in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(initials, faults):
    """(cost, audit, roles): all edits of one row after the other are tried, the best for each last role kept."""
    open_ = [(0, "", ())]
    for initial, fault in [*zip(initials, faults), (None, None)]:
        now = {}
        for cost, audit, roles in open_:
            for inserted in itertools.chain([()], itertools.product("ua", repeat=1), itertools.product("ua", repeat=2)):
                c, a, r = cost + 5 * len(inserted), audit + "I" * len(inserted), roles + tuple((x, "insert") for x in inserted)
                options = [(c, a, r)] if initial is None else [(c + 2, a + "D", (*r, ("", "delete")))]
                if initial is not None and fault not in ("blank", "duplicate"):
                    late = 5 if fault == "truncated" else 0
                    options += [(c + late, a + "K", (*r, (initial, "keep"))), *((c + 1 + late, a + "R", (*r, (x, "rerole"))) for x in "ua")]
                for c2, a2, r2 in options:
                    text = "".join(x for x, _ in r2)
                    if re.fullmatch(r"s?(ua)*u?", text):
                        key = (text[-1:], bool(text))
                        if key not in now or (c2, a2) < now[key][:2]:
                            now[key] = (c2, a2, r2)
        open_ = list(now.values())
    return min((c, a, r) for c, a, r in open_ if re.fullmatch(r"(s?(ua)+)?", "".join(x for x, _ in r)))


def every_edit(initials, faults):
    """(cost, audit) of the best of all sequences of edits, by trying each: for a few rows only."""
    found = []
    choices = [[("D", 2, "")] + ([] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated"), i), ("R", 1 + 5 * (f == "truncated"), "u"), ("R", 1 + 5 * (f == "truncated"), "a")]) for i, f in zip(initials, faults)]
    gaps = [()] + [(x,) for x in "ua"] + [("u", "a"), ("a", "u")]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(edits) + 1):
            roles = "".join("".join(g) + e[2] for g, e in zip(put, [*edits, ("", 0, "")]))
            if re.fullmatch(r"(s?(ua)+)?", roles):
                found.append((sum(e[1] for e in edits) + 5 * sum(map(len, put)), "".join("I" * len(g) + e[0] for g, e in zip(put, [*edits, ("", 0, "")]))))
    return min(found)


LETTERS = [*"suaoSUAO", "y1"]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solved_signatures_against_all_edits(n):
    for tokens in itertools.product(LETTERS, repeat=n):
        initials = [t[0].lower() for t in tokens]
        faults = ["blank" if t == "y1" else "truncated" if t.isupper() else "" for t in tokens]
        ways = [(w[0] + repair.ENDS[e][0], w[1] + repair.ENDS[e][1]) for e, w in enumerate(repair.solve("".join(tokens))[repair.NONE]) if w]
        assert min(ways) == every_edit(initials, faults), tokens


def brute_repair(rows):
    out = {}
    for conv, own in brute_damage(rows).items():
        faults = brute_faults(own)
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, roles = brute_edits(initials, faults)
        said, at = [], 0
        names = {"u": "user", "a": "assistant"}
        for x, how in roles:
            if how == "insert":
                said.append(names[x] + ":")
                continue
            _, role, text = own[at]
            at += 1
            if how != "delete":
                said.append(f"{role if how == 'keep' else names[x]}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def check_repair(spark, rows, schema="conv_id long, turn long, role string, text string"):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{schema}, key string, block int")
    got = {r[0]: tuple(r[1:]) for r in repair.repaired(table.repartition(3)).collect()}
    want = brute_repair(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == v, k


def some_rows(rng, conversations, most):
    texts = ["Yes.", "No", "  ", "Why?", "So it is!", "and then", "", "été 🙂.", "a\nb."]
    return [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User"]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}" + rng.choice([".", "", "! "])) for c in range(conversations) for t in range(rng.randrange(1, most)) if rng.random() < 0.9]


def test_repair_against_brute_force(spark):
    check_repair(spark, some_rows(random.Random(1), 150, 14))


def test_repair_of_awkward_rows(spark):
    rng = random.Random(2)
    rows = some_rows(rng, 20, 8)
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", None), (50, None, "user", "a."), (50, None, "user", "a."), (50, 3, "user", "b."), (51, None, None, None), (52, 5, "", "."), (53, 7, "system", "Only.")]
    rows += rows[:9] + [(54, 1, r, t) for r in ("user", "assistant") for t in ("x.", "y.", "x.")] + [(55, t, "user", "x" * 40000 + ".") for t in range(3)]
    check_repair(spark, rows)
    empty = repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == 0


def test_repair_of_one_long_conversation_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", " "]
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(texts) if rng.random() < 0.2 else f"{t}" + rng.choice(["."] * 4 + [""])) for t in range(3000)]
    rows += [(2, 1, "user", "again.")] * 500
    check_repair(spark, rows)
    monkeypatch.setattr(repair, "BLOCK", 2)
    check_repair(spark, some_rows(random.Random(7), 60, 20))


# token counts -----------------------------------------------------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "Bc", " ", "\n", ".", ",", "'s", "9", "é", "<|", "  ", "<|endoftext|>", "\t", " ", "ß", "!", "日", "\0", "\r", "՘", "꟎", "🙂", "'", "\x1c", " ", "　", "Ünï", "xyzzy" * 9]


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(tokenizer_path(TOKENIZER))


@pytest.fixture(scope="module")
def counter():
    return MergeCounter(tokenizer_path(TOKENIZER), keep=50)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20))
def test_counts_equal_the_library(bpe, counter, text):
    assert counter.count(text) == len(bpe.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_a_table(spark, bpe):
    docs = cases.awkward(spark)
    got = sorted(map(tuple, count_tokens(docs).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(i, len(t.encode()), n := len(bpe.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(cases.empty(spark)).count() == 0


def test_counts_on_given_texts(bpe, counter):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert counter.count(text or "") == len(bpe.encode(text or "", add_special_tokens=False).ids)


def test_remembered_keeps_a_bounded_number():
    asked = []
    r = Remembered(lambda t: asked.append(t) or len(t), 3)
    assert [r.total([c * 2 for c in "abcabcdefga"]) for _ in range(2)] == [22, 22]
    assert len(r.known) <= 3 and len(r.older) <= 3


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        MergeCounter(tokenizer_path("word_bpe_49k.json"))
