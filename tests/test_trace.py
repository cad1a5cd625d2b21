import random

from pyspark.sql import functions as F

from tracewright.operators import trace as T
from tracewright.operators.stacks import NOT_TRACING


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_latencies_golden(spark):
    tasks = spark.createDataFrame([(1, 20, 80, "n1"), (2, 10, 30, "n1"), (3, 5, 75, "n2"), (4, 15, 60, "n2")], "task int, init long, sync long, node string")
    want = {"node": [-10, -10, -5, -5], "task": [-10, 40, -5, 10], "none": [-5] * 4}
    for mode, expected in want.items():
        assert [x for _, x in rows(T.latencies(tasks, mode), "task", "latency")] == expected
    moved = T.synchronise(spark.createDataFrame([(2, 7)], "task int, time long"), T.latencies(tasks, "task"), ["task"])
    assert rows(moved, "task", "time") == [(2, 47)]
    assert rows(T.desynchronise(moved, T.latencies(tasks, "task"), ["task"]), "task", "time") == [(2, 7)]


def replay(acts, end):
    stack, since, state, out = [2], 0, 2, []
    for t, a, s in acts:
        if a == "reset":
            stack = [s]
        elif a == "pop_until":
            while stack and stack[-1] != s:
                stack.pop()
        else:
            if stack and stack[-1] == NOT_TRACING:
                stack.pop()
            if a == "push":
                stack.append(s)
            elif stack and stack[-1] == s:
                stack.pop()
        top = stack[-1] if stack else 0
        if top != state:
            if since < t and state != 0:
                out.append((since, t, state))
            since, state = t, top
    if since < end and state != 0:
        out.append((since, end, state))
    return out


def test_state_stack_against_replay(spark):
    rng = random.Random(5)
    acts = {k: [(t, rng.choice(["push", "push", "pop", "pop", "pop_until", "reset"]), rng.choice([1, 3, 5, NOT_TRACING])) for t in sorted(rng.choices(range(100), k=30))] for k in range(6)}
    df = spark.createDataFrame([(k, t, i, a, s) for k, v in acts.items() for i, (t, a, s) in enumerate(v)], "thread int, time long, seq long, action string, state int")
    got = rows(T.state_intervals(df, ["thread"], end_time=120), "thread", "t0", "t1", "state")
    assert got == sorted((k, *r) for k, v in acts.items() for r in replay(v, 120))


def test_wildcard_steals_the_oldest_send(spark):
    ends = [("send", 1), ("send", 2), ("recv", T.ANY_TAG), ("recv", 1), ("recv", 2), ("send", 1)]
    df = spark.createDataFrame([(0, i, i, k, t) for i, (k, t) in enumerate(ends)], "pair int, time long, seq long, kind string, tag int")
    # the any-tag receive takes send 0; the tag-1 receive then waits for send 5
    assert rows(T.match_wildcard(df, ["pair"]), "send_seq", "recv_seq") == [(0, 2), (1, 4), (5, 3)]


def test_asof_directions_and_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, 7), (1, 15, 8), (1, 10, 9)], "k int, t int, v int")
    got = {(r.k, r.t): r.v for r in T.asof(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {(1, 10): 9, (1, 20): 8, (2, 5): None}
    got = {(r.k, r.t): r.v for r in T.asof(left, right, ["k"], "t", ["v"], "forward").collect()}
    assert got == {(1, 10): 7, (1, 20): None, (2, 5): None}
    got = {(r.k, r.t): r.v for r in T.asof(left, right, ["k"], "t", ["v"], "forward", strict=True).collect()}
    assert got == {(1, 10): 8, (1, 20): None, (2, 5): None}


def test_share_threshold_golden(spark):
    for durations, p, want in (([1, 2, 3, 4, 10], 80, 3), ([5, 5, 5, 5], 50, 5), ([1, 1, 1, 97], 80, 97), ([1, 2], 0, None)):
        df = spark.createDataFrame([(d,) for d in durations], "dur long")
        assert T.share_threshold(df, p).first()[0] == want
    empty = T.share_threshold(spark.createDataFrame([], "dur long"), 50).collect()
    assert not empty or empty[0][0] is None


def test_stacked_types(spark):
    values = [3, 5, 0, 0, 0, 2]
    df = spark.createDataFrame([(1, i, i, 9, v) for i, v in enumerate(values)], "thread int, time long, seq long, type int, value long")
    assert [t for _, t in rows(T.stacked_types(df, ["thread"]), "seq", "top")] == [3, 5, 3, 0, 0, 2]


def test_global_rank_is_one_to_n_with_ties_in_one_range(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 50).alias("x"), "id")
    got = rows(T.global_rank(df, ["x", "id"]), "rank", "x", "id")
    assert [r[0] for r in got] == list(range(1, 1001)) and [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_lifetime_ends_are_inclusive(spark):
    ev = spark.createDataFrame([(0, 1, "alloc", 100, 10), (0, 5, "free", 100, 0), (0, 7, "alloc", 100, 4)], "task int, seq long, kind string, address long, size long")
    acc = spark.createDataFrame([(0, 2, 110), (0, 3, 111), (0, 6, 100), (0, 9, 104)], "task int, seq long, address long")
    assert rows(T.live_region(acc, T.lifetimes(ev, ["task"]), ["task"], 16), "seq", "alloc_seq") == [(2, 1), (9, 7)]


def split_over(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return before


def test_stacks_of_one_long_thread_span_many_tasks(spark):
    rng = random.Random(8)
    before = split_over(spark, 13)
    try:
        for weights in ((6, 3, 1, 1), (3, 6, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (40, 40, 1, 1)):
            acts = [(t, rng.choices(["push", "pop", "pop_until", "reset"], weights)[0], rng.choice([1, 3, NOT_TRACING, 5])) for t in range(1500)]
            some = [(t, "push", 1 + t % 3) for t in range(0, 40, 7)]
            df = spark.createDataFrame([("a", t, i, a, s) for i, (t, a, s) in enumerate(acts)] + [("b", t, i, a, s) for i, (t, a, s) in enumerate(some)], "thread string, time long, seq long, action string, state int")
            got = rows(T.state_intervals(df, ["thread"], end_time=2000), "thread", "t0", "t1", "state")
            assert got == sorted([("a", *x) for x in replay(acts, 2000)] + [("b", *x) for x in replay(some, 2000)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_intervals_of_one_long_thread(spark):
    before = split_over(spark, 7)
    try:
        acts = [(t, "push" if t % 3 else "pop", 1) for t in range(300)]
        df = spark.createDataFrame([("a", t, t, a, s) for t, a, s in acts], "thread string, time long, seq long, action string, state int")
        got = rows(T.state_intervals(df, ["thread"], drop=(), split=True), "t0", "t1", "state")
        assert [x[:2] for x in got] == [(t, t + 1) for t in range(299)]
        none = df.where("time < 0")
        assert T.state_intervals(none, ["thread"], end_time=5).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stacked_types_of_one_long_thread(spark):
    rng = random.Random(9)
    before = split_over(spark, 11)
    try:
        for ups in (1, 2, 3):
            values = [rng.randrange(1, 10**12) if rng.randrange(4) < ups else 0 for _ in range(1200)]
            want, stack = [], []
            for v in values:
                stack.append(v) if v else (stack.pop() if stack else None)
                want.append(stack[-1] if stack else 0)
            df = spark.createDataFrame([("a", 1, i, i, v) for i, v in enumerate(values)], "thread string, type int, time long, seq long, value long")
            assert [t for _, t in rows(T.stacked_types(df, ["thread"]), "seq", "top")] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wildcards_of_one_key_span_many_tasks(spark):
    from tracewright.operators.matching import ANY_TAG, Matcher

    rng = random.Random(10)
    before = split_over(spark, 9)
    try:
        for receives, sends in (([1, 2, 3], [1, 2, 3]), ([ANY_TAG], [1, 2, 3]), ([ANY_TAG, 1, 2], [1, 2, 3]), ([ANY_TAG, 1, 1, 1], [1, 1, 2, ANY_TAG])):
            ends = [(0, t, t, *(("send", rng.choice(sends)) if rng.random() < 0.5 else ("recv", rng.choice(receives)))) for t in range(900)]
            ends += [(k, t, 1000 * k + t, *(("send", rng.choice(sends)) if rng.random() < 0.5 else ("recv", rng.choice(receives)))) for k in (1, 2) for t in range(10)]
            want, matchers = [], {}
            for k, _, seq, kind, tag in ends:
                if m := matchers.setdefault(k, Matcher()).end(seq, kind, tag):
                    want.append((k, *m))
            df = spark.createDataFrame(ends, "pair int, time long, seq long, kind string, tag int")
            assert rows(T.match_wildcard(df, ["pair"]), "pair", "send_seq", "recv_seq") == sorted(want)
        assert T.match_wildcard(df.where("time < 0"), ["pair"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sends_of_one_tag_are_matched_by_place(spark, monkeypatch):
    from tracewright.operators import matching

    monkeypatch.setattr(matching, "in_rounds", None)  # no rounds, however many ends stay open
    rng = random.Random(11)
    before = split_over(spark, 9)
    try:
        for receives, sends in (([matching.ANY_TAG, 7], [7]), ([matching.ANY_TAG, 7, 3], [7]), ([matching.ANY_TAG, 7], [matching.ANY_TAG]), ([matching.ANY_TAG, 7], [])):
            for share in (0.2, 0.5, 0.8):
                ends = [(0, t, t, *(("send", rng.choice(sends)) if sends and rng.random() < share else ("recv", rng.choice(receives)))) for t in range(600)]
                matcher = matching.Matcher()
                want = [(k, *m) for k, _, seq, kind, tag in ends if (m := matcher.end(seq, kind, tag))]
                df = spark.createDataFrame(ends, "pair int, time long, seq long, kind string, tag int")
                assert rows(T.match_wildcard(df, ["pair"]), "pair", "send_seq", "recv_seq") == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
