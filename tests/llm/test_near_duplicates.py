import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tracewright.llm import decontaminate, line_templates, near_copies, simhash


def brute_fp(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in own}


def test_awkward_documents(spark):
    docs = cases.awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in got)
    root = brute_components(set(fps.values()))
    least: dict = {}
    for i, f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[fps[r.doc_id]]) for r in got)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").distinct().collect()) == sorted(set(least.values()))


def test_chains_and_stars_of_fingerprints(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    signed = np.array(sorted(set(fps)), np.uint64).view(np.int64)
    links = simhash.ball_links(spark.createDataFrame([(int(f),) for f in signed], "fp long"))
    from tracewright.operators.graph import components

    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(links).collect()}
    want = brute_components(set(fps))
    for a in want:
        for b in want:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_empty(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_first(cases.empty(spark)).count() == 0
    assert decontaminate.contained(cases.empty(spark), cases.benchmark(spark, cases.awkward(spark))).count() == 0
    assert line_templates.dedup_lines(cases.empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60))
def test_packed_codes_round_trip(codes):
    x = np.sort(np.array(codes, np.uint64))
    assert (simhash.unpack(simhash.pack(x)) == x).all()


def test_a_text_that_occurs_once_stays(spark):
    rng = random.Random(6)
    a, b = cases.prose(rng, 80), cases.prose(rng, 80)
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, None), (7, "one two")], "doc_id long, text string")
    for keep in (simhash.keep_first, near_copies.keep_first):
        assert sorted((r.doc_id, r.text or "") for r in keep(docs).collect()) == sorted([(1, a), (5, b), (7, ""), (7, "one two")])


def test_rows_without_an_id_are_deduplicated(spark):
    rng = random.Random(6)
    a, b = cases.prose(rng, 80), cases.prose(rng, 80)
    docs = spark.createDataFrame([(3, a), (None, a), (None, b), (None, b + " end")], "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in near_copies.keep_first(docs).collect()]
    assert (3, a) in left and len(left) == 2 and left[0][1] != left[1][1]


def test_shingle_sets_and_fingerprints():
    rng = random.Random(1)
    text = cases.prose(rng, 70_000).encode()
    found = near_copies.shingles(text)
    words = text.lower().split()
    assert len(set(found.tolist())) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    print_ = near_copies.fingerprint(found) & (2**64 - 1)
    assert print_ == sum((sum(int(x) >> b & 1 for x in found.tolist()) * 2 > len(found)) << b for b in range(64))


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def item_shingles(item, text):
    """The item's shingles, and the text's of that many words."""
    width = max(1, min(5, len((item or "").split())))
    return shingles(item, width), shingles(text, width)


def test_containment_against_brute_force(spark):
    docs = cases.awkward(spark)
    items = cases.benchmark(spark, docs)
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained(docs, items).collect()}
    want = {}
    for d in docs.where("doc_id is not null").collect():
        for i in items.collect():
            s, t = item_shingles(i.text, d.text)
            if s and len(s & t) / len(s) >= 0.8:
                want[d.doc_id, i.item_id] = len(s & t) / len(s)
    assert got == want and want
    wide = decontaminate.contained(docs, items, most_broadcast=0)
    assert {(r.doc_id, r.item_id): r.containment for r in wide.collect()} == want
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and 9 not in {r.doc_id for r in left.collect()} and left.count() == docs.count() - 1


def test_short_items_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(1, "it is Far too\tshort here"), (2, "too far short"), (None, "x far TOO short"), (4, "far too"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "far too short"), (8, "short"), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(1, 7), (1, 8), (2, 8)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [4, 5]


def test_sketches_never_miss(spark):
    rng = random.Random(4)
    rows, items = [], []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 60))]
        items.append((k, " ".join(words)))
        own = list(words)
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = "other"
        rows.append((k, cases.prose(rng, 300) + " " + " ".join(own) + " " + cases.prose(rng, 300)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in rows for i, u in items if len(shingles(u) & shingles(t)) >= 0.8 * len(shingles(u)) - 1e-9}


def test_line_templates(spark):
    line = "User 17 logged in from host alpha at noon"
    rows = [(1, f"first text\n{line}\nlast"), (2, "User 99 logged in from host alpha at noon\nown words"), (3, f"{line}\n{line}"), (4, "own\n\nlines"), (5, None), (None, line), (6, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dropped string")
    got = {r.row.doc_id: (r.kept, r.dropped) for r in line_templates.dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], []), 2: ("own words", [0]), 3: ("", [0, 1]), 4: (rows[3][1], []), 5: (None, []), None: ("", [0]), 6: ("", [])}
    left = line_templates.dedup_lines(docs, drop_emptied=True)
    assert sorted(r.row.doc_id for r in left.where("row.doc_id is not null").collect()) == [1, 2, 4, 5, 6]


def test_short_lines_need_many_documents(spark):
    docs = spark.createDataFrame([(i, f"The end.\nnumber {'abc'[i % 3]} text of {i} own words here x{'y' * i}") for i in range(25)], "doc_id long, text string")
    few = line_templates.dedup_lines(docs.where("doc_id < 10")).collect()
    assert all(0 not in r.dropped for r in few)
    many = line_templates.dedup_lines(docs).collect()
    assert sum(0 in r.dropped for r in many) == 24


def brute_lines(docs):
    """{doc_id: places that go} by the rule of line_templates, over {doc_id: text}."""
    import re

    places = []
    for i, text in docs.items():
        for pos, line in enumerate(text.split("\n")):
            if w := line.lower().split():
                places.append((i, pos, tuple("<*>" if re.search("[0-9]", x) else x for x in w)))
    first, of = {}, {}
    for i, pos, t in sorted(places):
        first.setdefault(t, (i, pos))
        of.setdefault(t, set()).add(i)
    keep = {t: first[t][0] for t in first if len(of[t]) >= (2 if len(t) >= 5 else 20)}

    def blocks(t):
        return [t[len(t) * i // 8 : len(t) * (i + 1) // 8] for i in range(8)]

    owner = {}
    for t in sorted((t for t in first if len(t) >= 10), key=first.get):
        for i in range(0, 8, 2):
            owner.setdefault((len(t), t[:1], i, *blocks(t)[i : i + 2]), t)
    for t in first:
        if len(t) >= 10:
            for i in range(0, 8, 2):
                o = owner[(len(t), t[:1], i, *blocks(t)[i : i + 2])]
                if sum(x == y for x, y in zip(blocks(t), blocks(o))) >= 5:
                    keep[t] = min(keep.get(t, 10**9), first[o][0])
    gone = {}
    for i, pos, t in places:
        if t in keep and i > keep[t]:
            gone.setdefault(i, []).append(pos)
    return gone


def test_fields_without_digits(spark):
    say = "User {} logged in from the {} host and opened the door of {} today"
    rows = {i: f"own text number of document {'abcdefghij'[i]} only\n" + say.format(who, "same", "hall") for i, who in enumerate(["alice", "bob", "carol", "dave"])}
    rows[7] = say.format("eve", "other", "attic")
    rows[8] = "User gina logged out of every single one of those hosts that are known today"
    got = {r.row.doc_id: r.dropped for r in line_templates.dedup_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [1], 2: [1], 3: [1], 7: [0], 8: []}


def test_line_templates_against_brute_force(spark):
    rng = random.Random(12)
    base = [cases.prose(rng, rng.randrange(3, 40)) for _ in range(12)]
    rows = {}
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(cases.WORDS)
            own.append(" ".join(w))
        rows[i] = "\n".join(own)
    want = brute_lines(rows)
    for most in (500_000, 0):
        got = {r.doc_id: list(r.dropped) for r in line_templates.dropped_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), most_broadcast=most).collect()}
        assert got == want and want


def test_every_pair_of_line_templates(spark):
    """A template that its owner hides from an earlier one that it agrees with goes too, once all pairs are asked for."""
    from itertools import combinations

    rng = random.Random(5)
    base = [cases.prose(rng, 16).split() for _ in range(3)]
    rows = {}
    for i in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(1, 16)] = rng.choice(cases.WORDS)
        rows[i] = " ".join(w)
    t = {i: tuple(x.lower().split()) for i, x in rows.items()}
    cut = lambda w: [w[2 * k : 2 * k + 2] for k in range(8)]
    want = {b for a, b in combinations(t, 2) if len(t[a]) == len(t[b]) == 16 and t[a][0] == t[b][0] and sum(x == y for x, y in zip(cut(t[a]), cut(t[b]))) >= 5}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    by_owners, all_pairs = ({r.doc_id for r in line_templates.dropped_lines(docs, every_pair=e).collect()} for e in (False, True))
    assert all_pairs == want and by_owners < want


def test_awkward_lines(spark):
    docs = cases.awkward(spark)
    got = line_templates.dedup_lines(docs)
    assert got.count() == docs.count() and set(got.first().row.asDict()) == set(docs.columns)
    long = spark.createDataFrame([(1, "z" * 400_000 + " b"), (2, "q " * 100_000)], "doc_id long, text string")
    assert [list(r.dropped) for r in line_templates.dedup_lines(long).collect()] == [[], []]


def test_broadcasts_are_bounded_by_bytes(spark):
    """Rows with many leaders are wide: fewer of them are sent through the driver."""
    rows, told = spark.range(200_000), lambda df: df._jdf.queryExecution().analyzed().toString().lower()
    assert "strategy=broadcast" in told(near_copies.small(rows, 24))
    assert "strategy=broadcast" not in told(near_copies.small(rows, 88 + 8 * 32))


def test_tasks_drop_tokenizers_of_earlier_stages(monkeypatch):
    from tracewright.llm import common

    monkeypatch.setattr(common, "_TOKENIZERS", {("a", 1): object()})
    assert list(common.tidy(lambda batches: iter(batches), tokenizes=True)([1])) == [1] and common._TOKENIZERS
    assert list(common.tidy(lambda batches: iter(batches))([1])) == [1] and not common._TOKENIZERS
