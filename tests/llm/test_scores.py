import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tracewright.llm import lm, merkle, pii, toxicity, urls


def words(text):
    return (text or "").encode().lower().split()


def test_lm_against_exact_counts(spark):
    docs = cases.awkward(spark)
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in lm.score(docs, segments=3).collect():
        got[r.doc_id].append(r)
    held = {r.doc_id: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0 for r in rows}
    c = collections.Counter()
    for r in rows:
        if not held[r.doc_id]:
            c.update([*words(r.text), None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        tokens = [*words(r.text), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        for g in got[r.doc_id]:
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert g.base_score == pytest.approx(base) and g.score <= 0
    assert sum(map(len, got.values())) == len(rows)


def test_lm_score_against_exact_pair_counts(spark, monkeypatch):
    """Counts up to 3 are exact levels, and with 64 bits an entry wrong hits are one in a hundred thousand probes."""
    monkeypatch.setattr(lm, "BITS", 64)
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(80)] + [(90, None), (91, ""), (92, "w1 w2 w3"), (92, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            w = [*words(t), "end"]
            one.update(w)
            two.update(zip(["start", *w], w))
            starts += 1
    assert max(n for (a, _), n in two.items() if a != "start") <= 3
    total, floor = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)

    def brute(t):
        w, out = [*words(t), "end"], 0.0
        for h, x in zip(["start", *w], w):
            seen, base = (starts if h == "start" else one[h]), (one[x] + 0.1) / floor
            n = two[h, x]
            if h == "start":
                n = float(lm.meant(lm.levels(np.array([max(n, 1)]), 1.5), 1.5)[0]) if n else 0
            out += math.log10((min(n, seen) + 50 * base) / (seen + 50))
        return out

    for limit in (512, 0):
        for r in lm.score(docs, segments=4, limit_mb=limit).collect():
            wanted = {brute(t) for i, t in rows if i == r.doc_id}
            assert any(r.score == pytest.approx(x, rel=1e-6) for x in wanted) and r.train_tokens == total


def test_long_texts_are_scored(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in lm.score(docs).collect()) == [(1, 400_001), (2, 2)]


def test_lm_dealt_by_segment_equals_one_pass(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, cases.prose(rng, 400) + f" word{i * 7}" * 3 + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(900))) for i in range(60)], "doc_id long, text string")
    one = {r.doc_id: r for r in lm.score(docs, segments=6).collect()}
    many = {r.doc_id: r for r in lm.score(docs, segments=6, limit_mb=1).collect()}
    for i, a in one.items():
        b = many[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)


def test_filter_counts_within_a_step(spark):
    docs = spark.createDataFrame([(i, " ".join(["common pair"] * 100)) for i in range(1, 40)], "doc_id long, text string")
    r = lm.score(docs, segments=1)
    best = r.agg(F.min(F.col("score") / F.col("n_tokens")).alias("x")).first().x
    assert best > -0.1  # nearly certain continuations


def test_levels_cover_all_counts():
    counts = np.arange(1, 5000)
    level = lm.levels(counts, 1.5)
    mid = lm.meant(level, 1.5)
    assert (np.abs(np.log(mid / counts)) <= math.log(1.5) + 1e-9).all() and level[0] == 1 and mid[0] == 1


def test_empty_tables(spark):
    e = cases.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm.score(e).count() == 0 and pii.find_pii(e).count() == 0 and merkle.compare_edited(e).count() == 0
    assert toxicity.scored(e, toxicity.fit(e, labels)).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# personal data ------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_spans(x):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(x)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(k) <= 255 for k in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_against_plain_regexes():
    rng = random.Random(9)
    for _ in range(5000):
        x = "".join(rng.choice("aé.@-9+ (%2048\n") for _ in range(rng.randrange(40)))
        own = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(pii.base_spans(x), key=lambda s: (s.start, pii.KINDS.index(s.kind))))
        assert own == brute_spans(x), x


def test_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    pii.spans("7" * 1_000_000)
    pii.spans("1." * 300_000)
    pii.spans("a@" * 300_000)
    many = " ".join(f"u{i}@h.example born 1990-01-{10 + i % 20}" for i in range(20_000))
    found = pii.spans(many)
    assert time.perf_counter() - began < 20 and sum(s.kind == "email" for s in found) == sum(s.kind == "birth_date" for s in found) == 20_000


def test_further_spans_never_overlap_taken_ones():
    rng = random.Random(2)
    parts = ["4111 1111 1111 1111", "+44 20 7946 0958", "call 555-123-4567", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "born 1990-01-31", "10.0.0.1", " ", "1", "x@y.zz"]
    for _ in range(400):
        found = pii.spans(rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(8))))
        for i, a in enumerate(found):
            for b in found[:i]:
                assert {a.kind, b.kind} <= set(pii.BASE) or a.end <= b.start or b.end <= a.start


def test_pii_on_awkward_rows(spark):
    odd = cases.awkward(spark)
    assert pii.digest(pii.find_pii(odd)).count() == odd.count()


def test_checksums_and_context():
    found = {s.kind: s for s in pii.spans("Pay to GB82 WEST 1234 5698 7654 32, born 1990-01-31, SSN 123-45-6789, card 4111 1111 1111 1111, a@b.co, 10.0.0.256")}
    assert {"iban", "birth_date", "ssn", "card", "email"} == set(found)
    assert not [s for s in pii.spans("GB83 WEST 1234 5698 7654 32 and 1990-01-31 and 4111 1111 1111 1112") if s.kind in ("iban", "birth_date", "card")]


def test_pii_query_columns(spark):
    docs = spark.createDataFrame([(1, "é a@b.co 10.0.0.1"), (2, None), (2, ""), (None, "+44 20 7946 0958")], "doc_id long, text string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_phone): (r.base_sha256, r.spans) for r in pii.digest(pii.find_pii(docs)).collect()}
    assert got[1, 1, 1, 0] == (hashlib.sha256(b"email:2:8,ip:9:17").hexdigest(), "email:2:8,ip:9:17")
    assert got[2, 0, 0, 0] == (hashlib.sha256(b"").hexdigest(), "") and got[None, 0, 0, 1][1] == "phone:0:16"


# toxicity -----------------------------------------------------------------------------------------------------------


def brute_segments(x):
    out = []

    def cut(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += x[j]
                if s > 0 and (best is None or s > best[0] + 1e-12):
                    best = (s, i, j + 1)
        if best:
            cut(a, best[1])
            out.append(best[1:])
            cut(best[2], b)

    cut(0, len(x))
    return out


def test_segments_against_brute_force():
    rng = random.Random(7)
    for _ in range(800):
        x = [rng.choice([-3.7, -2.3, -1.1, 1.3, 2.9, 0.7]) + rng.random() * 0.01 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(x))] == brute_segments(x)


def toxic_table(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        t = cases.prose(rng, 60).split()
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(50)
            t[at : at + 3] = ["gruk" + rng.choice(["el", "ot", "amu"]), "fnord", "gruk" + rng.choice(["ix", "um"])]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).join(labels.select(F.col("doc_id"), "toxic"), F.col("row.doc_id") == F.col("doc_id")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([r.predicted == r.toxic for r in held]) >= 0.97
    found = toxicity.statistics(docs.where("doc_id = 4"), model.table, passages=True, location=model.location).first()
    assert found.passages


def test_documents_without_an_id_are_never_learnt_from(spark):
    import pandas as pd

    docs = spark.createDataFrame([(None, "gruk gruk"), (0, "calm words")], "doc_id long, text string")
    table = toxicity.count_words(docs, pd.DataFrame({"doc_id": [-1, 0], "toxic": [1, 0]}))
    assert table.totals[1] == 0 and table.totals[0] > 0


def test_a_words_score_is_its_own_among_any_number_of_others():
    own = [h for w in (b"vilest", b"gentle") for h in toxicity.features(w)]
    told = {}
    for others in (0, 100_000, 5_000_000):
        more = np.random.default_rng(others).integers(0, 1 << 64, others, np.uint64)
        keys = np.concatenate([np.array(own, np.uint64), more])
        counts = np.concatenate([np.array([[1, 50], [1, 50], [2, 60], [2, 60], [70, 1], [70, 1], [60, 1], [60, 1]][: len(own)]), np.tile([[3, 1]], (others, 1))])
        score = toxicity.Scorer(toxicity.Counts(*toxicity.added(keys, counts), np.array([9000, 1000])))
        told[others] = (score(b"vilest"), score(b"gentle"), score(b"unseen"))
    assert told[0] == told[100_000] == told[5_000_000] and told[0][0] > 1 > -1 > told[0][1]


def test_rare_features_are_dropped_but_counted_in_the_totals(spark):
    import pandas as pd

    docs = spark.createDataFrame([(0, "calm calm words"), (1, "calm gruk")], "doc_id long, text string")
    table = toxicity.count_words(docs, pd.DataFrame({"doc_id": [0, 1], "toxic": [0, 1]}))
    assert table.of(np.array(toxicity.features(b"calm")[-1:] + toxicity.features(b"gruk")[-1:], np.uint64)).tolist() == [[2, 1], [0, 0]]
    assert table.totals.tolist() == [len(toxicity.features(b"calm")) * 2 + len(toxicity.features(b"words")), len(toxicity.features(b"calm")) + len(toxicity.features(b"gruk"))]


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels = toxic_table(spark, 200)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.table.keys == b.table.keys).all() and (a.table.counts == b.table.counts).all() and a.location == b.location and (a.steps == b.steps).all()


def plain_scores(docs, labels):
    """{doc_id: score}: the operator's rule over exact counts, in plain Python; docs {id: text}, labels {id: 0 or 1}."""
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in docs}
    token = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())
    parts = lambda w: [(n, w[:n]) for n in (4, 5, 6) if len(w) > n] + [(0, w)]
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in docs.items():
        if i in labels and fold[i] < 2:
            for w in token(t):
                for k in parts(w):
                    counts[k][labels[i]] += 1
    whole = [1 + sum(c[j] for c in counts.values()) for j in range(2)]
    base = whole[1] / sum(whole)

    def odds(w):
        p = base
        for k in parts(w):
            clean, toxic = counts.get(k, (0, 0))
            clean, toxic = (clean, toxic) if clean + toxic >= 2 else (0, 0)  # too rare
            p = (toxic + 20 * p) / (clean + toxic + 20)
        return math.log(p / (1 - p)) - math.log(base / (1 - base)) - 1

    def statistic(t):
        w = token(t)
        x = [odds(v) for v in w]
        found = [sum(x[a:b]) for a, b in brute_segments(x)]
        return math.log(sum(map(math.exp, found))) - math.log(len(w)) if found else None

    stat = {i: statistic(t) for i, t in docs.items()}
    known = [i for i in docs if i in labels and fold[i] != 2]
    rest = [i for i in known if fold[i] == 3]
    clean = [stat[i] for i in rest if not labels[i] and stat[i] is not None]
    location, scale = (float(np.mean(clean)) if clean else 0.0), 1.0
    if len(clean) > 1 and np.std(clean, ddof=1) > 1e-9:
        scale = float(np.std(clean, ddof=1)) * math.sqrt(6) / math.pi
        location -= 0.5772156649015329 * scale

    def surprise(t):
        if t is None:
            return 0.0
        z = (t - location) / scale
        return z if z > 30 else -math.log(-math.expm1(-math.exp(-max(-50.0, z))))

    place = lambda x: min(121, math.floor(x * 2) + 1)
    prior = sum(labels[i] for i in known) / len(known)
    steps = [[prior, 1.0] for _ in range(122)]
    for i in rest:
        steps[place(surprise(stat[i]))][0] += labels[i]
        steps[place(surprise(stat[i]))][1] += 1
    # the least of the largest means of runs around a bin: rising shares without pooling
    total = np.concatenate(([[0.0, 0.0]], np.cumsum(steps, axis=0)))
    share = [min(max((total[b][0] - total[a][0]) / (total[b][1] - total[a][1]) for a in range(k + 1)) for b in range(k + 1, 123)) for k in range(122)]
    return {i: share[place(surprise(t))] + 1e-6 * min(surprise(t), 1000) / 1000 for i, t in stat.items()}


def test_toxicity_labels_are_no_rows_of_the_driver(spark):
    """Some hundred bytes for each label would fill the driver of a large table."""
    import tracemalloc

    docs, labels = toxic_table(spark, 100)
    want = toxicity.fit(docs, labels)
    others = spark.range(1_000_000, 1_300_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    tracemalloc.start()
    try:
        got, most = toxicity.fit(docs, labels.union(others)), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20_000_000
    assert got.table.keys.tolist() == want.table.keys.tolist() and got.table.counts.tolist() == want.table.counts.tolist() and got.steps is not None


def test_toxicity_scores_against_plain_python(spark):
    docs, labels = toxic_table(spark, 240)
    mixed = docs.collect()
    rng = random.Random(5)
    mixed = {r.doc_id: r.text + (" fnord" if rng.random() < 0.1 else "") for r in mixed} | {900: None, 901: "", 902: "12 34"}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    df = spark.createDataFrame(list(mixed.items()), "doc_id long, text string")
    want = plain_scores(mixed, known)
    for r in toxicity.scored(df, toxicity.fit(df, labels)).collect():
        assert r.score == pytest.approx(want[r.row.doc_id], abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_toxicity_edge_rows(spark):
    docs, labels = toxic_table(spark, 100)
    model = toxicity.fit(docs, labels)
    odd = cases.awkward(spark)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert set(got[0].row.asDict()) == set(odd.columns)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    bad = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r.predicted for r in toxicity.scored(docs, bad).collect()} == {0}


# fingerprints and urls ----------------------------------------------------------------------------------------------


def test_merkle_against_brute_force(spark):
    docs = cases.awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text)
    prints = {}
    for r in merkle.compare_edited(docs, 3).collect():
        a, b = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (a == edited) and 0 <= r.near_next <= 1
        assert (r.near_edited == 1.0) == (a == edited)
        prints[r.doc_id] = r.fingerprint
    for i in ids:
        for j in ids:
            assert (prints[i] == prints[j]) == (text[i] == text[j])


def brute_tree(text):
    """The root's children: (digest, [(digest, [(digest, length)])]), all digests whole."""

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    marks, tree, at = r".!?;:,|\n", [], 0
    for section in re.split(r"(?<=\n\n)(?=[^\n])", text):
        nodes = []
        for paragraph in re.split(r"(?<=\n)(?=[^\n])", section):
            found, done = [], 0
            for to, most in ((32, 6), (256, 24)):
                end = max(to - at, done)
                found += re.findall(f"(?s)[^{marks}]{{1,{most}}}[{marks}]{{0,16}}|[{marks}]{{1,16}}", paragraph[done:end])
                done = end
            found += re.findall(f"(?s).{{128,239}}?[{marks}]{{1,16}}|.{{1,239}}", paragraph[done:])
            assert "".join(found) == paragraph
            leaves = [(sha(x), len(x)) for x in found]
            nodes.append((sha("".join(d for d, _ in leaves)), leaves))
            at += len(paragraph)
        tree.append((sha("".join(d for d, _ in nodes)), nodes))
    return tree


def brute_likeness(a, b):
    if a == b:
        return 1.0

    def length(node):
        return sum(map(length, node[1])) if isinstance(node[1], list) else node[1]

    x, y, common, sizes = brute_tree(a), brute_tree(b), 0, [0, 0]
    for level in range(3):
        x, y = ({n[0]: n for n in side} for side in (x, y))
        common += sum(length(x[d]) for d in x.keys() & y.keys())
        x, y = [n for d, n in x.items() if d not in y], [n for d, n in y.items() if d not in x]
        if level < 2:
            x, y = [c for n in x for c in n[1]], [c for n in y for c in n[1]]
    most = common + max(sum(map(length, x)), sum(map(length, y)))
    return common / most if most else 0.0


def test_likeness_against_brute_force(spark):
    rng = random.Random(3)
    text = {i: "".join(cases.prose(rng, rng.randrange(1, 40)) + rng.choice([". ", "\n", "\n\n"]) for _ in range(rng.randrange(9))) for i in range(30)}
    text |= {40: text[3], 41: text[3] + " more", 42: "", 43: None, 44: "\n" * 50, 45: "é日🙂" * 40, 46: "z" * 200_000}
    ids = sorted(text)
    for r in merkle.compare_edited(spark.createDataFrame(list(text.items()), "doc_id long, text string"), 4).collect():
        a, b = text[r.doc_id] or "", text[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert r.near_edited == pytest.approx(brute_likeness(a, edited)) and r.near_next == pytest.approx(brute_likeness(a, b))
        assert len(r.fingerprint) <= 80 + 160 + 0.12 * len(a) + 16 * len(re.split(r"\n+", a))


def test_merkle_locates_edits(spark):
    a = "Head.\n\nOne line here.\nTwo line here.\n\nTail part."
    rows = [(a, a.replace("Two", "Three")), (a, a), (a, a + "\nmore\nmore"), (a, "Tail part."), ("", "x"), ("x", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a string, b string")
    got = df.select("i", merkle.changes(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).orderBy("i").collect()
    assert [tuple(r.e) for r in got] == [(1, 1, 1), (0, None, None), (3, 2, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0)]  # the fourth's part has moved to the start, where leaves are shorter


def test_single_and_repeated_rows(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    r = merkle.compare_edited(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert merkle.compare_edited(one.union(one)).count() == 2
    assert merkle.compare_edited(cases.awkward(spark)).count() == cases.awkward(spark).count()


def test_url_rules(spark):
    given = ["http://a.NET/x", "https://www.example.net/en/1", "http://example.com/de/", "http://b.org/fr/?q=1", "http://b.org/FR/", "http://net", "http://net/", "no scheme", None, "x://evil.example.com/de/a?b#c", "http://bnet/", "http://example.net/de/", "http://q://r.net/a"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert got == {0: ("a.net", "/x", "net/"), 1: ("www.example.net", "/en/1", "example.net/en/"), 2: ("example.com", "/de/", "example.com/de/"), 3: ("b.org", "/fr/", "org/fr/"), 4: ("b.org", "/FR/", None), 5: ("net", "", None), 6: ("net", "/", "net/"), 7: ("", "", None), 8: ("", "", None), 9: ("evil.example.com", "/de/a", "example.com/de/"), 10: ("bnet", "/", None), 11: ("example.net", "/de/", "net/"), 12: ("q:", "//r.net/a", None)}


def test_urls_without_both_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages).collect()} == {"allow"}
    blocked = pages.union(spark.createDataFrame([(3, "http://a.net/x")], pages.schema))
    assert {r.verdict for r in urls.judge(blocked).collect()} == {"block"}


def test_trees_learn_from_the_rules(spark):
    rows = [(i, f"http://spam{i}-99.example.com/de/{i}?a={i}&b={i}") for i in range(60)] + [(100 + i, f"https://nice.example.org/fr/{'abc'[i % 3]}") for i in range(60)]
    more = [(500, "http://spam7-99.example.com/it/7?a=7&b=7"), (501, "https://nice.example.org/pt/a")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows + more, "page_id long, url string"), max_rows=100).collect()}
    assert got[500] == "block" and got[501] == "allow"


def plain_features(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    u, n = url or "", max(1, len(url or ""))
    ent = lambda x: -sum(c / len(x) * math.log2(c / len(x)) for c in collections.Counter(x).values()) if x else 0.0
    count = lambda x, s: sum(c in s for c in x)
    x = [len(u), len(host), len(path), path.count("/"), host.count("."), count(u, "0123456789") / n, count(host, "0123456789"), host.count("-"), ent(u), ent(host), u.count("="), u.count("&"), u.count("#"), u.count("%"), float(u.startswith("https"))]
    parts = host.split(".")
    return host, path, x, (parts[-1], ".".join(parts[-2:]), "/".join(path.split("/")[:2]).split("/")[-1])


def plain_tree(node, x):
    while node.subtreeDepth():
        s = node.split()
        node = node.leftChild() if x[s.featureIndex()] <= s.threshold() else node.rightChild()
    return node.prediction()


def test_verdicts_against_plain_trees(spark):
    rng = random.Random(6)
    given = []
    for i in range(400):
        host = rng.choice(["a", "spam-9", "shop1"]) + "." + rng.choice(["example.net", "example.com", "b.org", "c.net", "d.io"])
        given.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['de', 'en', 'fr', 'it'])}/{rng.randrange(10**6)}" + rng.choice(["", "?a=1&b=2", "#x%20"]))
    given += [None, "", "no scheme", "http://x.io/é?" + "a=1&" * 20_000]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    own = urls.with_features(pages).collect()
    assert all((r.host, r.path) == plain_features(given[r.page_id])[:2] and list(r.x) == pytest.approx(plain_features(given[r.page_id])[2]) for r in own)
    known = {r.page_id: r.known for r in own if r.known}
    share = sum(v == "block" for v in known.values()) / len(known)
    stored = urls.checkpointed(urls.with_features(pages))
    model = urls.fit(stored, urls.suffix_counts(stored), share, len(known), 50_000, 10, 4)
    tally = [collections.defaultdict(list) for _ in range(3)]
    for i, v in known.items():
        for k, s in enumerate(plain_features(given[i])[3]):
            tally[k][s].append(v == "block")
    weights = list(model.treeWeights)
    roots = [t._call_java("rootNode") for t in model.trees]
    for r in urls.judge(pages).collect():
        _, _, x, suffixes = plain_features(given[r.page_id])
        x = x + [(sum(tally[k][s]) + share) / (len(tally[k][s]) + 1) for k, s in enumerate(suffixes)]
        vote = sum(w * plain_tree(t, x) for w, t in zip(weights, roots))
        assert r.verdict == known.get(r.page_id, "block" if vote > 0 else "allow")


def test_clashing_columns_and_equal_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", "p", 2), (1, "http://a.net/x", "h", "p", 2), (None, None, None, None, None)], "page_id long, url string, host string, rule string, x int")
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in urls.judge(pages).collect()) == [(0, "", "block"), (1, "a.net", "block"), (1, "a.net", "block")]


def test_suffixes_are_counted_over_all_labels(spark, monkeypatch):
    rng = random.Random(4)
    kinds = [rng.random() < 0.5 for _ in range(600)]  # whether a domain's urls are blocked: nothing else tells
    rows = [(2 * i + j, f"http://{i:03d}.example.{'com' if bad else 'net'}/{'de' if bad else 'en'}{j}") for i, bad in enumerate(kinds) for j in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = tuple((f"{i:03d}.example.{'com' if bad else 'net'}", f"/{'de' if bad else 'en'}", "block" if bad else "allow") for i, bad in enumerate(kinds[:4]))
    counts = urls.suffix_counts(urls.with_features(pages, rules))
    bad = sum(kinds[:4])
    assert {(r.s0, sum(r.n0), sum(r.blocked0)) for r in counts[0].collect()} == {x for x in (("com", 2 * bad, 2 * bad), ("net", 2 * (4 - bad), 0)) if x[1]}

    # paths x0 to x599 each with labels of one kind: fitted on few rows, verdicts of unlabelled pages follow their path segment
    rows = [(3 * i + j, f"http://{'ok' if j == 2 else 'no' if bad else 'go'}.h.test/x{i:03d}/a") for i, bad in enumerate(kinds) for j in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("no.h.test", "/", "block"), ("go.h.test", "/", "allow"))
    for most in (urls.MOST_BROADCAST, 0):
        monkeypatch.setattr(urls, "MOST_BROADCAST", most)
        got = {r.page_id: r.verdict for r in urls.judge(pages, rules, max_rows=200).where("rule is null").collect()}
        assert got == {3 * i + 2: "block" if bad else "allow" for i, bad in enumerate(kinds)}
