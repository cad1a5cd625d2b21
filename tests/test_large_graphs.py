import itertools
import random
import time
from fractions import Fraction
from math import gcd, lcm

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph, large_graphs
from tracewright.operators.large_graphs import factors_of, max_cycle_ratio, repetition_of_one, short_cycles


def brute_cycles(edges, most):
    nodes = sorted({x for e in edges for x in e[:2]})
    have = {(a, b) for a, b, *_ in edges}
    out = set()
    for n in range(1, most + 1):
        for c in itertools.permutations(nodes, n):
            if c[0] == min(c) and all((c[i], c[(i + 1) % n]) in have for i in range(n)):
                out.add(c)
    return out


def test_factors():
    for n in [*range(1, 300), 2**31, 97 * 89**2]:
        back = 1
        for p, e in factors_of(n):
            back *= p**e
            assert all(p % q for q in range(2, min(p, 50)))
        assert back == n


def test_short_cycles(spark):
    rng = random.Random(1)
    edges = [(a, b) for a in range(7) for b in range(7) if rng.random() < 0.4]
    got = short_cycles(spark.createDataFrame(edges + edges[:3], "src long, dst long"), 4).collect()
    assert sorted((r.length, tuple(r.nodes)) for r in got) == sorted((len(c), c) for c in brute_cycles(edges, 4))


def ratio_by_brute(edges):
    """By node, over all simple cycles that it reaches."""
    nodes = sorted({x for e in edges for x in e[:2]})
    best = {}
    for a, b, w, t in edges:
        best.setdefault((a, b), []).append((w, t))
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b, *_ in edges:
            reach[a] |= reach[b]
    cycles = {}
    for c in brute_cycles(edges, len(nodes)):
        for pick in itertools.product(*[best[c[i], c[(i + 1) % len(c)]] for i in range(len(c))]):
            r = Fraction(sum(w for w, _ in pick), sum(t for _, t in pick))
            cycles[c[0]] = max(cycles.get(c[0], r), r)
    return {n: max((cycles[m] for m in reach[n] if m in cycles), default=None) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_cycle_ratios_against_all_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.randrange(-5, 30), rng.randrange(1, 4)) for a in range(6) for b in range(6) if rng.random() < 0.3]
    edges += [(6, 7, 3, 1), (8, 7, 4, 1), (8, edges[0][0], 1, 0), *[(a, b, w - 1, t) for a, b, w, t in edges[:3]]]
    got = max_cycle_ratio(spark.createDataFrame(edges, "src long, dst long, weight long, tokens long")).collect()
    want = ratio_by_brute(edges)
    assert {r.node: None if r.num is None else Fraction(r.num, r.den) for r in got} == want
    value = {r.node: r for r in got}
    for a, b, w, t in edges:  # the values prove the ratios
        if want[a] is not None and want[a] == want[b]:
            assert value[a].den * w - value[a].num * t <= value[a].value - value[b].value


def test_cycle_without_tokens(spark):
    with pytest.raises(ValueError, match="no tokens"):
        max_cycle_ratio(spark.createDataFrame([(1, 2, 3, 0), (2, 1, 1, 0)], "src long, dst long, weight long, tokens long"))


def test_ratios_by_components(spark):
    """Components of one cycle, of several, ways of any length between them, nodes that reach none, a cycle that the first links leave for a sink."""
    inner = [(0, 0, -1, 2), (0, 1, 23, 2), (0, 4, -4, 2), (1, 2, 23, 2), (1, 4, 1, 2), (2, 0, -4, 3), (2, 3, 8, 2), (3, 4, 9, 2)]
    edges = [*inner, (10, 11, 40, 3), (11, 10, 2, 1), (11, 0, 1, 0), (12, 10, -9, 1), (13, 13, 7, 2), (13, 13, 8, 2), (14, 13, 1, 1), (15, 16, 3, 1), (14, 15, 2, 1), (17, 17, -3, 2), (17, 16, 5, 1)]
    given = spark.createDataFrame(edges, "src long, dst long, weight long, tokens long")
    want = {n: None if r is None else (r.numerator, r.denominator) for n, r in ratio_by_brute(inner).items()}
    want |= {10: (21, 2), 11: (21, 2), 12: (21, 2), 13: (4, 1), 14: (4, 1), 15: None, 16: None, 17: (-3, 2)}
    assert want[0] == (6, 1)
    for options in ({}, {"most_rounds": 1}, {"block": 2}):  # as it is; ways too long for the rounds; components that need colours
        got = large_graphs.reachable_ratio(given, **options).collect()
        assert {r.node: None if r.num is None else (r.num, r.den) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="no tokens"):
        large_graphs.reachable_ratio(spark.createDataFrame([(1, 2, 3, 0), (2, 1, 1, 0)], "src long, dst long, weight long, tokens long"))


def test_rings_of_a_table_take_few_jobs(spark):
    """Policies of all lines took several times as many."""
    from tracewright.plans import queries

    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert queries.queries()["cycle_ratios_one_graph"](spark, "/root/testdata/sf0.001").count() > 0
    assert jobs() - before < 150


def test_ratio_of_one_long_ring(spark):
    n = 3000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), (F.col("id") % 7).alias("weight"), F.lit(1).alias("tokens"))
    want = Fraction(sum(i % 7 for i in range(n)), n)
    got = max_cycle_ratio(ring).agg(F.min("num"), F.max("num"), F.min("den"), F.max("den"), F.count("*")).first()
    assert got[:] == (want.numerator, want.numerator, want.denominator, want.denominator, n)


def repetition_by_brute(channels):
    near, q, out = {}, {}, {}
    for a, b, p, c in channels:
        near.setdefault(a, []).append((b, Fraction(p, c)))
        near.setdefault(b, []).append((a, Fraction(c, p)))
    for n in sorted(near):
        if n in q:
            continue
        q[n], members, todo = Fraction(1), [n], [n]
        while todo:
            a = todo.pop()
            for b, r in near[a]:
                if b not in q:
                    q[b] = q[a] * r
                    members.append(b)
                    todo.append(b)
        good = all(q[a] * p == q[b] * c for a, b, p, c in channels if a in members)
        size = lcm(*(q[m].denominator for m in members))
        shared = gcd(*(int(q[m] * size) for m in members))
        for m in members:
            out[m] = (n, good, str(int(q[m] * size) // shared) if good else None)
    return out


def test_repetition_against_brute_force(spark):
    rng = random.Random(3)
    rates = {i: rng.choice([1, 2, 3, 4, 6, 10, 35]) for i in range(60)}
    channels = []
    for group in (range(20), range(20, 40), range(40, 60)):
        for _ in range(30):
            a, b = rng.choice(group), rng.choice(group)
            k = rng.choice([1, 2, 5])
            channels.append((a, b, k * rates[b], k * rates[a]))
    channels.append((45, 46, 7, 11))
    channels += [(100, 100, 2, 2), (101, 101, 2, 3), *channels[:2]]
    got = repetition_of_one(spark.createDataFrame(channels, "src long, dst long, production long, consumption int"))
    assert {r.actor: (r.component, r.consistent, r.q) for r in got.collect()} == repetition_by_brute(channels)


def test_repetition_of_a_long_chain_is_exact(spark):
    n = 400  # its products pass 2^400
    chain = [(i, i + 1, 2 if i < n // 2 else 1, 1 if i < n // 2 else 3) for i in range(n)]
    got = {r.actor: r.q for r in repetition_of_one(spark.createDataFrame(chain, "src long, dst long, production long, consumption long")).collect()}
    assert got == {k: v[2] for k, v in repetition_by_brute(chain).items()}
    assert len(got[0]) > 60


def test_components_of_a_path_of_a_million_nodes(spark):
    n, began = 1_000_000, time.monotonic()
    path = spark.range(n - 1).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = graph.components(path)
    assert found.agg(F.count("*"), F.count_distinct("root")).first()[:] == (n, 1)
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200 << 20  # an estimate from the table's own bytes
    assert time.monotonic() - began < 900


def test_later_rounds_value_changed_ways_only(spark, monkeypatch):
    """Rings in a tree, as deep as it has levels: all nodes are valued once, and then those whose ways change."""
    valued = []
    monkeypatch.setattr(large_graphs, "cycles_of", lambda policy, run=large_graphs.cycles_of: (valued.append(policy.count()), run(policy))[1])
    n, rng = 300, random.Random(5)
    edges = [(3 * k + i, 3 * k + (i + 1) % 3, rng.randrange(1, 50), 1) for k in range(n) for i in range(3)] + [(3 * (k // 4), 3 * k, 0, 1) for k in range(1, n)]
    got = {r.node: Fraction(r.num, r.den) for r in max_cycle_ratio(spark.createDataFrame(edges, "src long, dst long, weight long, tokens long")).collect()}
    best = [Fraction(sum(w for _, _, w, _ in edges[3 * k : 3 * k + 3]), 3) for k in range(n)]
    for k in range(n - 1, 0, -1):
        best[k // 4] = max(best[k // 4], best[k])
    assert got == {3 * k + i: best[k] for k in range(n) for i in range(3)}
    assert valued[0] == 3 * n and len(valued) > 2 and sum(valued) < 2 * len(valued) * n  # of 3 n each round


def strong_by_brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("block", [3, 1000])
def test_strong_components_within_and_over_blocks(spark, block):
    rng = random.Random(block)
    edges = [(a, b) for a in range(30) for b in range(30) if rng.random() < 0.05]
    edges += [(40 + i, 40 + (i + 1) % 9) for i in range(9)] + [(40, 3), (60, 60), (61, 40), (62, 63), *[(0, 100 + i) for i in range(12)], (111, 0)]
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    want = strong_by_brute(edges)
    got = graph.strong_components(df, block=block).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_rings_in_a_tree_are_not_coloured(spark, monkeypatch):
    """Only the parts between rings are left after the blocks, and these form a tree, which is peeled."""
    monkeypatch.setattr(graph, "coloured", lambda *_: pytest.fail("coloured"))
    n = 500
    edges = [(8 * k + i, 8 * k + (i + 1) % 5) for k in range(n) for i in range(5)] + [(8 * (k // 4), 8 * k) for k in range(1, n)]
    got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), block=600)
    assert {r.node: r.component for r in got.collect()} == {8 * k + i: 8 * k for k in range(n) for i in range(5)}


def test_rates_of_channels_are_not_carried_as_maps(spark, monkeypatch):
    """Tables of channels hold numbers; maps of exponents are made for actors."""
    kept = []
    real = large_graphs.checkpointed
    monkeypatch.setattr(large_graphs, "checkpointed", lambda df, *rest: (out := real(df, *rest), kept.append((out.count(), "map<" in out.schema.simpleString())))[0])
    rng = random.Random(9)
    rates = [rng.choice([1, 2, 3, 6]) for _ in range(20)]
    channels = [(a, b, rates[b], rates[a]) for a in range(20) for b in range(20) if a != b]
    got = repetition_of_one(spark.createDataFrame(channels, "src long, dst long, production long, consumption long"))
    assert {r.actor: (r.component, r.consistent, r.q) for r in got.collect()} == repetition_by_brute(channels)
    assert max(n for n, _ in kept) == len(channels) and all(n <= 20 for n, maps in kept if maps)


def test_paths_of_the_full_length_are_not_kept(spark, monkeypatch):
    """Paths that only have to close are joined as they are made; others hold their nodes and nothing else."""
    kept = []
    real = large_graphs.checkpointed
    monkeypatch.setattr(large_graphs, "checkpointed", lambda df, *rest: (kept.append(df.columns), real(df, *rest))[1])
    edges = [(0, 1), (1, 2), (2, 0), (2, 1), (1, 3), (3, 0), (3, 3)]
    got = short_cycles(spark.createDataFrame(edges, "src long, dst long"), 3).collect()
    assert sorted(tuple(r.nodes) for r in got) == [(0, 1, 2), (0, 1, 3), (1, 2), (3,)]
    assert kept == [["src", "dst"], ["src", "dst"], ["n1", "n2"]]
