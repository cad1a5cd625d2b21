"""Operators against brute force, and at the sizes and depths where simpler forms fail."""

import itertools
import math
import random
from collections import deque
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import exprs, sdf
from tracewright.operators import code, features, graph, rules, scopes, trace
from tracewright.session import broadcast_within
from tracewright.streaming import signals


def chain(spark, n):
    return spark.createDataFrame([("f", i, i - 1 if i else None, "ITN" if i % 10 == 0 else "NONE", 1, "2" if i % 10 == 0 else None) for i in range(n)], "file string, scope_id int, parent_id int, kind string, own long, repeat string")


def test_roll_up_of_a_hundred_levels(spark):
    got = {r.scope_id: r.total for r in scopes.roll_up(chain(spark, 100)).collect()}
    want = 0
    for i in range(99, -1, -1):
        want = 1 + (2 * want if i % 10 == 0 else want)
        assert got[i] == {"1": want}


def test_closures_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, kept = [], scopes.checkpointed
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scopes, "checkpointed", lambda df, *rest: plans.append(told(df)) or kept(df, *rest))
    plans.append(told(scopes.roll_up(chain(spark, 6))))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_cycles_of_scopes_are_errors(spark):
    ring = spark.createDataFrame([("f", i, (i + 1) % 3, "NONE", 1, None) for i in range(3)], "file string, scope_id int, parent_id int, kind string, own long, repeat string")
    with pytest.raises(ValueError):
        scopes.roll_up(ring)
    params = spark.createDataFrame([("f", i, "a", None) for i in range(3)], "file string, scope_id int, var string, elements long")
    with pytest.raises(ValueError):
        scopes.propagate_memory(params, spark.createDataFrame([("f", (i + 1) % 3, i) for i in range(3)], "file string, parent int, child int"))


def test_memory_comes_from_far_above(spark):
    params = spark.createDataFrame([("f", i, "a", 7 if i == 0 else None) for i in range(100)], "file string, scope_id int, var string, elements long")
    tree = spark.createDataFrame([("f", i, i + 1) for i in range(99)], "file string, parent int, child int")
    assert {r.elements for r in scopes.propagate_memory(params, tree).collect()} == {7}


def plain_wildcard(ends):
    sends, receives, out = [], [], []
    for seq, kind, tag in ends:
        mine, other = (sends, receives) if kind == "send" else (receives, sends)
        hit = next((i for i, (_, t) in enumerate(other) if t == tag or trace.ANY_TAG == (t if kind == "send" else tag)), None)
        if hit is None:
            mine.append((seq, tag))
        else:
            found = other.pop(hit)[0]
            out.append((seq, found) if kind == "send" else (found, seq))
    return sorted(out)


def test_wildcard_matching_against_a_plain_search(spark):
    rng = random.Random(4)
    ends = [(i, rng.choice(["send", "recv"]), rng.choice([1, 2, 3])) for i in range(600)]
    ends = [(i, k, trace.ANY_TAG if k == "recv" and rng.random() < 0.3 else t) for i, k, t in ends]
    df = spark.createDataFrame([(0, i, i, k, t) for i, k, t in ends], "key int, time long, seq long, kind string, tag int")
    assert sorted((r.send_seq, r.recv_seq) for r in trace.match_wildcard(df, ["key"]).collect()) == plain_wildcard(ends)


def test_pairs_of_one_name_are_many_tasks(spark):
    params = spark.range(300).select(F.lit("f").alias("fun"), F.when(F.col("id") < 200, "v").otherwise(F.col("id").cast("string")).alias("var_name"), F.col("id").alias("var_pos"))
    names = params.select("fun", F.col("var_name").alias("par_name"), F.col("var_pos").alias("par_pos")).where("var_pos % 4 = 0")
    got = scopes.parameter_links(params, names, most_pairs=500).withColumn("task", F.spark_partition_id())
    want = {("f", a.var_name, a.var_pos, b.par_pos) for a in params.collect() for b in names.collect() if a.var_name == b.par_name}
    rows = [tuple(r) for r in got.drop("task").collect()]
    assert set(rows) == want and len(rows) == len(want) == 200 * 50 + 25
    assert got.where("var_name = 'v'").select("task").distinct().count() > 5
    assert scopes.parameter_links(params.limit(0), names).count() == 0


def test_wide_and_empty_intervals(spark):
    rng = random.Random(5)
    spans = [(i, a, a + rng.choice([0, 3, 70, 5000, 10**12])) for i, a in enumerate(rng.randrange(-(10**6), 10**6) for _ in range(80))] + [(99, 5, 4)]
    points = [(k, rng.randrange(-(10**6), 10**7)) for k in range(200)] + [(500, spans[0][1]), (501, spans[0][2])]
    got = trace.range_join(spark.createDataFrame(points, "k long, p long"), spark.createDataFrame(spans, "i long, lo long, hi long"), "p", "lo", "hi", 64)
    assert sorted((r.k, r.i) for r in got.collect()) == sorted((k, i) for k, p in points for i, lo, hi in spans if lo <= p <= hi)


def test_running_total_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), t, rng.randrange(-5, 9)) for t in range(300)]
    want, sums = {}, {}
    for k, t, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[t] = sums[k]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    assert {r.t: r.s for r in trace.running_total(df, ["t"], "v", "s", ["k"]).collect()} == want
    assert {r.t: r.s for r in trace.running_total(df, ["t"], "v", "s").collect()} == dict(zip(range(300), itertools.accumulate(v for _, _, v in rows)))


def test_bounded_broadcasts(spark):
    assert "ResolvedHint" in broadcast_within(spark.range(5), 5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_within(spark.range(6), 5)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        features.transition_table(spark.createDataFrame([], "prev_state int, rule int, state int"), spark.range(1).withColumnRenamed("id", "state"), spark.range(features.MOST_RULES + 1).withColumnRenamed("id", "action"))


def test_a_negative_cycle_shows_early_on_a_long_ring(spark):
    ring = spark.range(400).select(F.col("id").alias("src"), ((F.col("id") + 1) % 400).alias("dst"), F.lit(1).alias("weight"))
    tail = spark.createDataFrame([(0, 401, 1), (401, 402, -5), (402, 401, 1)], "src long, dst long, weight int")
    assert graph.distances(ring.union(tail), 0)[1]


def test_longest_distances(spark):
    rng = random.Random(1)
    edges = [(i, j, rng.randrange(-5, 10)) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.4]
    best = {0: 0}
    for i, j, w in sorted(edges):
        if i in best and (j not in best or best[i] + w > best[j]):
            best[j] = best[i] + w
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    assert {r.node: r.dist for r in graph.distances(df, 0, longest=True)[0].collect()} == best


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for root in sorted(near):
        todo = [] if root in want else [root]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = root
                todo += near[x]
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


# exact analyses -----------------------------------------------------------------------------------------------------


def random_graph(rng, n):
    q = [rng.randrange(1, 5) for _ in range(n)]
    actors = {f"a{i}": tuple(rng.randrange(1, 6) for _ in range(rng.choice([1, 1, 2]))) for i in range(n)}
    channels = []
    for i in range(n):
        j = (i + 1) % n
        g = math.gcd(q[i], q[j])
        channels.append((f"a{i}", f"a{j}", (q[j] // g,), (q[i] // g,), 3 * q[i] * q[j] if j == 0 else rng.randrange(3)))
        channels.append((f"a{i}", f"a{i}", (1,), (1,), 1))
    return actors, channels


def period(actors, channels):
    return sdf.max_cycle_ratio(sdf.weighted(*sdf.expand(actors, channels)))[0]


def test_incremental_bounds_hold_the_period():
    rng = random.Random(2)
    for _ in range(25):
        a, c = random_graph(rng, rng.randrange(2, 4))
        exact = period(a, c)
        low, high, _ = sdf.incremental_bounds(a, c)
        assert low <= exact <= high and (low == high or high < Fraction(101, 100) * low)


def test_unfolding_keeps_the_period_at_several_rates():
    rng = random.Random(7)
    for _ in range(20):
        a, c = random_graph(rng, 2)
        q, _, _ = sdf.repetition(a, c)
        times = {x: rng.choice([t for t in range(1, n + 1) if n % t == 0]) for x, n in q.items()}
        assert period(*sdf.unfold(a, c, times)) == period(a, c)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14))
def test_cycle_basis(n, more):
    edges = list(dict.fromkeys([(i, (i + 1) % n) for i in range(n)] + [(a % n, b % n) for a, b in more]))
    cycles = sdf.cycle_basis(list(range(n)), edges)
    assert len(cycles) == len(edges) - n + 1 and {e for c in cycles for e in c} == set(edges)
    assert all(x[1] == y[0] for c in cycles for x, y in zip(c, [*c[1:], c[0]], strict=True))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12))
def test_simple_cycles(n, pairs):
    edges = list(dict.fromkeys((a % n, b % n) for a, b in pairs))
    found = {frozenset(c) for c in sdf.simple_cycles(edges)}
    want = {frozenset(zip(p, [*p[1:], p[0]])) for k in range(1, n + 1) for p in itertools.permutations(range(n), k) if all(e in edges for e in zip(p, [*p[1:], p[0]]))}
    assert found == want


def test_buffers_have_an_answer_or_none():
    a = {"a": (3,), "b": (2,)}
    c = [("a", "b", (5,), (3,), 0), ("b", "a", (3,), (5,), 0), ("a", "a", (1,), (1,), 1), ("b", "b", (1,), (1,), 1)]
    best = period(a, [(*c[0][:4], 10**6), (*c[1][:4], 10**6), *c[2:]])
    found = sdf.size_buffers(a, c, [1], best)
    assert found and found[1] >= 5 + 3 - 1
    reach = lambda t: (r := sdf.max_cycle_ratio(sdf.weighted(*sdf.expand(a, [c[0], (*c[1][:4], t), *c[2:]])))[0]) is not None and r <= best
    assert found[1] == next(t for t in range(200) if reach(t))
    assert sdf.size_buffers(a, c, [1], best - 1) is None
    big = [("a", "b", (500,), (300,), 0), ("b", "a", (300,), (500,), 0)]
    assert sdf.size_buffers(a, big, [1], Fraction(1000))[1] >= 700  # more than any fixed number of added tokens


def test_path_methods_on_negative_cycles():
    rng = random.Random(9)
    for _ in range(60):
        edges = [(a, b, rng.randrange(-2, 9)) for a in range(6) for b in range(6) if a != b and rng.random() < 0.4]
        results = [sdf.scanned_paths(edges, 0, m) for m in ("queue", "order", "policy")]
        assert len({bad for _, _, bad in results}) == 1
        if not results[0][2]:
            dist = {0: 0}
            for _ in range(7):
                for a, b, w in edges:
                    if a in dist and dist[a] + w < dist.get(b, 10**9):
                        dist[b] = dist[a] + w
            assert all(d == dist for d, _, _ in results)


def test_distort_and_parallelism():
    c = [("a", "b", (1,), (1,), 2), ("b", "a", (1,), (1,), 1), ("b", "z", (1,), (1,), 4)]
    assert [x[4] for x in sdf.distort(c, 5)] == [10, 5, 4]
    a = {"a": (1,), "b": (1,), "z": (1,)}
    assert sdf.cycle_parallelism(a, c) == {"a": (3, 1), "b": (3, 1)}
    assert sdf.pushed_parallelism(a, c[:2], "b") == 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["put", "remove", "pop"]), st.integers(0, 5), st.integers(0, 9)), max_size=40))
def test_keyed_heap_against_a_plain_list(steps):
    heap, plain = sdf.KeyedHeap(), {}
    for n, (what, key, priority) in enumerate(steps):
        if what == "put":
            heap.put(key, priority)
            plain[key] = (priority, n)
        elif what == "remove" and key in plain:
            heap.remove(key)
            del plain[key]
        elif what == "pop" and plain:
            best = min(plain, key=plain.get)
            assert heap.first() == heap.pop() == (best, plain.pop(best)[0])
        assert len(heap) == len(plain) and all((k in heap) == (k in plain) for k in range(6))


# numbers, signals, code ---------------------------------------------------------------------------------------------


def test_large_primes_and_factors():
    assert exprs._is_prime(2**61 - 1) and not exprs._is_prime(3215031751) and not exprs._is_prime(1)
    for n in (1, 2, 97 * 97, 1_000_003 * 999_983, (2**31 - 1) * 65_537, 2**40, 600_851_475_143):
        assert math.prod(exprs._factors(n)) == n and all(map(exprs._is_prime, exprs._factors(n)))


def test_gcds_and_codes(spark):
    pairs = [(240, 46), (-7, 21), (0, 5), (5, 0), (0, 0), (2**62, 2**40 - 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", exprs.xgcd(F.col("a"), F.col("b")).alias("e")).collect():
        assert r.e[0] == math.gcd(r.a, r.b) == r.a * r.e[1] + r.b * r.e[2]
    assert spark.range(1).select(exprs.prime_code(F.array(F.lit(2), F.lit(0), F.lit(1))).cast("long")).first()[0] == 20
    with pytest.raises(Exception, match="46 digits"):
        spark.range(1).select(exprs.prime_code(F.array_repeat(F.lit(0).cast("long"), 47))).collect()


def plain_clusters(points, radius, least):
    near = {k: [o for o, y in points.items() if math.dist(x, y) <= radius] for k, x in points.items()}
    core = {k for k, o in near.items() if len(o) >= least}
    out = {}
    for root in sorted(core):
        todo = deque([] if root in out else [root])
        while todo:
            k = todo.popleft()
            if k not in out:
                out[k] = root
                todo += [o for o in near[k] if o in core]
    return {k: out[k] if k in core else out[min(o for o in near[k] if o in core)] if core & set(near[k]) else None for k in points}


def test_density_clusters_against_brute_force(spark):
    rng = random.Random(8)
    points = {i: (rng.gauss(rng.choice([0, 6, 20]), 1.5), rng.gauss(rng.choice([0, 9]), 1.5)) for i in range(160)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "k long, x double, y double")
    for radius, least in ((1.0, 4), (0.5, 2), (2.0, 9)):
        assert {r.k: r.cluster for r in signals.cluster_bursts(df, "k", ["x", "y"], radius, least).collect()} == plain_clusters(points, radius, least)


def test_phase_schedule_waits_longer_without_a_find(spark):
    hits = spark.createDataFrame([("a", 5), ("a", 1000)], "task string, time long")
    got = [(r.t0, r.t1, r.found) for r in signals.phase_schedule(hits, "task", 0, 60, 10).orderBy("t0").collect()]
    assert got == [(0, 10, True), (10, 20, False), (20, 35, False), (35, 57.5, False), (57.5, 91.25, False)]


def test_late_samples_take_no_energy_away(spark, tmp_path):
    for n, rows in enumerate(([("a", 0, 2.0), ("a", 1000, 4.0)], [("a", 500, 9.0), ("a", 1000, 7.0), ("a", 2000, 6.0)])):
        spark.createDataFrame(rows, "k string, t_ms long, w double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    got = []
    stream = spark.readStream.schema("k string, t_ms long, w double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = signals.stream_energy(stream, "k", ["w"]).writeStream.outputMode("update").foreachBatch(lambda rows, n: got.extend((r.t_ms, r.energy_j) for r in rows.collect())).option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert got == [(1000, 4.0), (2000, 10.0)]


def test_features_of_code():
    text = """
int total; struct point { int x; int y; };
int main(int n) {
  struct point p, q; int i, j, k, m[4][4], v[9], c = 3; k = 0;
  start(n); // for (;;) {}
#pragma omp parallel for schedule(static)
  for (i = 0; i < n; i++) { c = k; for (j = 1; j < 4; j += 2) { m[i][j] = k * c; v[j - 1] = i > 2 ? 1 : g(j); if (v[j]) continue; } k += 1; }
  if (n) ; else total = 4;
  5;
  return 0;
}"""
    found = dict(zip(features.FEATURES, code.features(text), strict=True))
    assert {k: found[k] for k in ("max_loop_depth", "calls", "shifted_writes", "irregular_loops", "globals", "ifs", "static_limits", "schedules", "simd_loops")} == {"max_loop_depth": 1, "calls": 2, "shifted_writes": 1, "irregular_loops": 1, "globals": 1, "ifs": 2, "static_limits": 1, "schedules": 1, "simd_loops": 0}
    assert {k: found[k] for k in ("for_loops", "non_unit_steps", "ternaries", "useless_statements", "struct_vars", "empty_ifs", "non_1d_arrays", "roll_ups")} == {"for_loops": 2, "non_unit_steps": 1, "ternaries": 1, "useless_statements": 1, "struct_vars": 2, "empty_ifs": 1, "non_1d_arrays": 1, "roll_ups": 0}
    assert code.features("")[0] == -1 and code.features("for (i = 0; i < n; i++) { n = n - 1; }")[features.FEATURES.index("static_limits")] == 0
    for odd in ("}", "{", "for (", "if", "a[", "#pragma x", "struct", "'", "int f( {"):
        assert len(code.features(odd)) == 23


def test_equal_texts_are_parsed_once(spark, tmp_path):
    log, real = str(tmp_path / "parsed"), code.features

    def logged(text):
        with open(log, "a") as f:
            f.write("x")
        return real(text)

    texts = ["int f() { g(); }", "int f() { if (a) { } }", None, "/*" + "x" * 5000 + "*/ int f() { g(); g(); }"]
    df = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "file int, value string").coalesce(1)
    code.features = logged
    try:
        got = {r.file: r.feat for r in code.code_features(df).collect()}
    finally:
        code.features = real
    assert got == {i: real(texts[i % 4] or "") for i in range(40)}
    assert len(open(log).read()) == 3 + 10


def test_rules_and_protocols(spark, tmp_path):
    assert len(rules.RULES) == 61 and len(rules.TRANSFORMATIONS) == 52 and rules.transformations(spark).where("name = 'roll_up_array'").first().type == 1_000_051
    seen = []
    known = rules.Protocols()
    known.register("count", lambda rows, n: seen.append(rows.count()))
    with pytest.raises(ValueError):
        known.register("count", print)
    spark.range(7).write.parquet(f"{tmp_path}/in")
    query = known.start("count", spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 7
