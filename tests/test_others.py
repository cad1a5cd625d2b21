"""Scopes, energy, features, sources and streams."""

import json
import math
import random
import struct

import numpy as np

import pytest
from pyspark.sql import functions as F

from tracewright.operators import energy, features, scopes
from tracewright.plans import fixtures
from tracewright.sources import graphs, texts, traces
from tracewright.streaming import signals


def test_energy_golden(spark):
    s = spark.createDataFrame([(0, 2.0), (1000, 4.0), (2500, 6.0)], "t long, w double").withColumn("k", F.lit(1))
    r = energy.integral(s, ["k"], "t", ["w"]).first()
    assert (r.energy_j, r.power_w) == (13.0, 5.2)


def test_sibling_edges_golden(spark):
    uses = spark.createDataFrame([(1, "x", 0, False, True), (1, "x", 1, True, False), (1, "x", 2, True, True), (1, "x", 3, True, False)], "p int, var string, pos int, reads boolean, writes boolean")
    assert sorted((r.src, r.dst) for r in scopes.sibling_edges(uses, ["p"]).collect()) == [(0, 1), (0, 2), (2, 3)]


def test_memory_propagates_down(spark):
    params = spark.createDataFrame([("f", 0, "a", 100), ("f", 1, "a", None), ("f", 2, "a", None), ("f", 2, "b", None)], "file string, scope_id int, var string, elements long")
    tree = spark.createDataFrame([("f", 0, 1), ("f", 1, 2)], "file string, parent int, child int")
    got = {(r.scope_id, r.var): r.elements for r in scopes.propagate_memory(params, tree).collect()}
    assert got == {(0, "a"): 100, (1, "a"): 100, (2, "a"): 100, (2, "b"): None}


def test_change_selection_and_tree(spark):
    ch = spark.createDataFrame([(0, 4, 7, 1), (0, 4, 5, 1), (0, 4, 3, 2)], "state int, rule int, id_change int, result int")
    want = spark.createDataFrame([(0, 4, 1)], "state int, rule int, next_state int")
    assert features.choose_change(ch, want).first().id_change == 5
    rows = spark.createDataFrame([([i, i % 3], int(i > 4)) for i in range(10)], "feat array<int>, label int")
    model = features.decision_tree(rows)
    assert "Predict" in model.toDebugString and model.numNodes == 3


def test_transition_defaults(spark):
    moves = spark.createDataFrame([(0, 1, 2)], "prev_state int, rule int, state int")
    t = features.transition_table(moves, spark.createDataFrame([(0,), (2,)], "state int"), spark.createDataFrame([(0,), (1,)], "action int"))
    assert sorted((r.state, r.action, r.next_state) for r in t.collect()) == [(0, 0, 0), (0, 1, 2), (2, 0, 2), (2, 1, 2)]


def test_lexical_features(spark):
    code = "int f(int a) { for (i = 0; i < 4; i += 2) { if (a) ; b[i][j] += g(a) ? 1 : 2; } /* if (x) */ return a; }"
    df = spark.createDataFrame([(code,)], "c string")
    r = df.select(*[x.alias(n) for n, x in features.lexical_features(F.col("c")).items()]).first()
    assert (r.for_loops, r.ifs, r.ternaries, r.empty_ifs, r.non_unit_steps, r.non_1d_arrays, r.brace_depth) == (1, 1, 1, 1, 1, 1, 2)


def test_graph_json_and_xml_round_trip(spark, tmp_path):
    own, ways = fixtures.GRAPHS["csdf"]
    text = {"type": "csdf", "actors": [{"name": a, "wcet": w if len(w) > 1 else w[0]} for a, w in own], "channels": [{"from": u, "to": v, "production": p, "consumption": "[3 * 1]" if u == v == "c" else c, "tokens": t, "capacity": cap} for u, v, p, c, t, cap in ways]}
    (tmp_path / "g.json").write_text(json.dumps(text))
    actors, channels = graphs.read_json(spark, str(tmp_path / "g.json"))
    assert sorted((r.actor, r.wcet) for r in actors.collect()) == sorted(own)
    assert {(r.src, r.dst): (r.production, r.consumption, r.tokens, r.capacity) for r in channels.collect()} == {(u, v): (p, c, t, cap) for u, v, p, c, t, cap in ways}
    assert graphs.unknown_actors(actors, channels).isEmpty()
    again = json.loads(graphs.to_json(actors, channels).first().value)
    assert [a["name"] for a in again["actors"]] == ["a", "b", "c"] and len(again["channels"]) == 4
    (tmp_path / "g.xml").write_text(graphs.to_xml(actors, channels).first().value)
    a2, c2 = graphs.read_xml(spark, str(tmp_path / "g.xml"))
    assert sorted((r.actor, r.wcet) for r in a2.collect()) == sorted(own)
    assert sorted((r.src, r.dst, r.production, r.consumption, r.tokens) for r in c2.collect()) == sorted((u, v, p, c, t) for u, v, p, c, t, _ in ways)
    assert graphs.to_text(actors, channels).count() == 7
    assert graphs.to_dimacs(spark.createDataFrame([(1, 2, 3)], "src int, dst int, weight int"), 2, 1).orderBy("ord").collect()[1].value == "a 1 2 3"


def test_binary_trace(spark, tmp_path):
    one = struct.pack("<iiiiqQQ8qii", 3, 100, 7, 1, 55, 2**63 + 1, 1234, *range(8), 50000001, -2)
    (tmp_path / "t.mpit").write_bytes(one * 3)
    got = traces.read_binary(spark, str(tmp_path / "t.mpit")).orderBy("seq").collect()
    r = got[2]
    assert len(got) == 3 and (r.seq, r.time, r.type, r.target, r.size, r.tag, r.comm, r.aux, r.hwc_set, r.hwc) == (2, 1234, 50000001, 3, 100, 7, 1, 55, -2, list(range(8)))
    assert int(r.value) == 2**63 + 1
    (tmp_path / "bad.mpit").write_bytes(one[:-1])
    with pytest.raises(Exception, match="whole number"):
        traces.read_binary(spark, str(tmp_path / "bad.mpit")).collect()


def test_trace_sinks(spark, tmp_path):
    records = spark.sql("select 1 rtype, 1 cpu, 1 ptask, 2 task, 1 thread, 10L time, 20L end_time, 0 event, 1 value, 0 cpu_r, 0 ptask_r, 0 task_r, 0 thread_r, 0L log_r, 0L phy_r, cast(null as array<struct<type:int,value:int>>) pairs union all select 2, 1, 1, 2, 1, 10L, 10L, 0, 0, 0, 0, 0, 0, 0L, 0L, array(named_struct('type', 1234, 'value', 1), named_struct('type', 4321, 'value', 0))")
    traces.write_trace(records, str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["2:1:1:2:1:10:1234:1:4321:0", "1:1:1:2:1:10:20:1"]
    labels = spark.createDataFrame([(1234, "User")], "type int, label string")
    assert sorted((r.type, r.label) for r in traces.labels_used(records, labels).collect()) == [(1234, "User"), (4321, "Unknown type 4321")]
    objects = spark.createDataFrame([(1, 1, 1, "n1", 1), (1, 1, 2, "n1", 2)], "ptask int, task int, thread int, node string, cpu int")
    assert [r.value for r in traces.row_names(objects).where("level = 'THREAD'").orderBy("ord").collect()] == ["THREAD 1.1.1", "THREAD 1.1.2"]
    assert traces.trace_header("Trace", 50, [4], [[(1, 1), (1, 1)]], "01/01/20 at 00:00") == "#Trace (01/01/20 at 00:00):50_ns:1(4):1:2(1:1,1:1)"


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.c").write_text("int f() {\n  if (x) { y; }\n}\n")
    got = texts.read_scopes(spark, str(tmp_path / "a.c")).orderBy("scope_id").collect()
    assert [(r.lstart, r.lend) for r in got] == [(2, 2), (1, 3)]
    (tmp_path / "l.lst").write_text("   3:a.c **** x\n  12 0004 8B45\n  13 0008 90\n   4:a.c **** y\n  14 000c C3\n")
    rows = texts.listing(texts.numbered_lines(spark, str(tmp_path / "l.lst")))
    assert [(r.line, r.n) for r in scopes.line_counts(rows).collect()] == [(3, 2)]
    assert sorted((r.line, r.n) for r in scopes.line_counts(rows, drop_trailing=False).collect()) == [(3, 2), (4, 1)]
    head = spark.createDataFrame([("x.c", "// TEST_VECTOR: [1, 2,3]\n// TEST_LABEL: 7\n// RULE_APPLD: inlining\n")], "file string, value string")
    r = texts.feature_headers(head).first()
    assert (r.test, r.label, r.rule, r.func) == ([1, 2, 3], 7, "inlining", None)
    text = "Rule Names\n['a', 'b']\n\nAbst.-State mappings\n{'10': 0, '11': 1}\n\nInit. States\n[0]\n\nFinal States\n[1]\n\nTransition Table\n[0, 1]\n[1, 1]\n"
    t = texts.training_table(spark.createDataFrame([("f", text)], "file string, value string"))
    assert sorted(map(tuple, t["transitions"].drop("file").collect())) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    assert sorted(map(tuple, t["rules"].collect())) == [("f", 0, "a"), ("f", 1, "b")] and t["final"].first().state == 1 and sorted(r.key for r in t["states"].collect()) == ["10", "11"]
    assert texts.training_text(t).first().value == text
    tree = texts.scope_json([{"scope_id": 0, "parent_id": None, "name": "ddot", "weight": 17, "lstart": 10, "lend": 23}, {"scope_id": 1, "parent_id": 0, "name": "MSUM", "weight": 8, "lstart": 18, "lend": 20}])
    assert tree[0]["scopes"][0]["name"] == "MSUM"
    (tmp_path / "e.csv").write_text("0," + ",".join(["1"] * 12) + "\n")
    assert texts.read_energy(spark, str(tmp_path / "e.csv")).first().w_a15 == 1.0


def test_streamed_representatives_equal_the_batch(spark, tmp_path):
    rows = [(0, [10.0, 1.0]), (1, [10.2, 1.0]), (2, [1.0, 9.0]), (3, [10.0, 1.1])]
    schema = "phase long, vector array<double>"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = signals.representatives(stream, min_seen=1, max_traced=1).writeStream.format("memory").queryName("reps").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("reps").collect())
    assert len(got) == 4 and sorted(s for _, _, s, _ in got) == [1, 1, 2, 3] and sum(t for *_, t in got) == 1


def test_streamed_energy(spark, tmp_path):
    schema = "k int, t_ms long, w double"
    spark.createDataFrame([(1, 0, 2.0), (1, 1000, 4.0), (1, 2500, 6.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = signals.stream_energy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", ["w"]).writeStream.format("memory").queryName("joules").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("joules").first().energy_j == 13.0


def test_periods_and_policy(spark):
    rows = spark.createDataFrame([(1, t, float(t % 8 == 0)) for t in range(128)], "k int, time long, value double")
    r = signals.periods(rows, "k").first()
    assert r.period == 8 and r.iterations == 16
    b = spark.createDataFrame([(1, 5, 10), (1, 15, 10), (1, 16, 1), (1, 40, 10)], "task int, ts long, dur long")
    z = spark.createDataFrame([(1, 10, 30, "profile")], "task int, t0 long, t1 long, policy string")
    assert {r.ts: r.policy for r in signals.detail_policy(b, z, 5).collect()} == {5: "none", 15: "profile", 16: "none", 40: "none"}
    plans = spark.createDataFrame([(1, 10, 5, 3, 2), (2, 1, 1, 0, 4)], "plan int, start long, step long, rounds int, loops int")
    assert sorted(map(tuple, signals.injection_schedule(plans, ["plan"]).collect())) == [(1, loop, r, 10 + 5 * r) for loop in range(2) for r in range(3)]


def test_periods_of_many_signals_equal_those_of_each(spark):
    """Signals of one length are transformed together; lengths, flat and short ones and missing values stay apart."""
    rng = np.random.default_rng(4)
    made = {k: np.where(np.arange(n) % p < 2, 5.0, 0.0) + rng.random(n) for k, (n, p) in enumerate([(60, 7), (60, 9), (61, 5), (3, 2), (120, 11), (4, 2), (60, 13)])}
    made |= {50: np.zeros(30), 51: np.ones(60), 52: np.array([1.0, -1.0] * 5)}
    rows = [(k, t, float(v)) for k, x in made.items() for t, v in enumerate(x)] + [(60, t, None if t == 3 else 1.0) for t in range(20)]
    got = {r.k: r for r in signals.periods(spark.createDataFrame(rows, "k int, time long, value double").repartition(3), "k").collect()}
    for k, x in made.items():
        p, good = signals.dominant_period(x)
        assert (got[k].period, got[k].iterations) == (p, len(x) // p if p else 0) and abs(got[k].goodness - good) < 1e-9
    assert got[60].period == 0 and len(got) == len(made) + 1
    m = np.array([made[0], made[1], made[6]])
    assert signals.dominant_periods(m, 60)[0].tolist() == signals.dominant_periods(m)[0].tolist() == [7, 9, 13]


def test_periods_of_long_signals_equal_those_of_whole_ones(spark):
    rng = random.Random(4)
    waves = {"a": [math.sin(2 * math.pi * i / 37) + 0.2 * rng.random() for i in range(5000)], "b": [(i % 60 < 7) * 5.0 + rng.random() for i in range(3001)], "c": [rng.random() for _ in range(900)], "d": [1.0] * 50, "e": [1.0, 2.0]}
    df = spark.createDataFrame([(k, i * 10, v) for k, w in waves.items() for i, v in enumerate(w)], "app string, time long, value double")
    for block in (256, 1000):
        got = {r.app: r for r in signals.long_periods(df.repartition(5), "app", 200, block).collect()}
        for k, w in waves.items():
            x = np.array(w) - np.mean(w)
            n, lags = len(x), min(200, len(x) // 2) + 1
            r = np.array([np.dot(x[: n - j], x[j:]) / (n - j) for j in range(lags)])
            if k == "d":
                continue  # rounding alone
            p, good = signals.peak_of(r) if n >= 4 else (0, 0.0)
            assert got[k].period == p and abs(got[k].goodness - good) < 1e-6 and got[k].iterations == (n // p if p else 0), k
    assert got["a"].period == 37 and got["b"].period == 60
    whole = {r.app: r for r in signals.periods(df.where("app <> 'd'"), "app").collect()}
    assert whole["a"].period == 37 and whole["b"].period == 60


@pytest.mark.parametrize("dims,spread", [(1, 40.0), (2, 6.0), (3, 3.0), (5, 2.0)])
def test_representatives_in_rounds_equal_the_sequential_ones(spark, dims, spread):
    rng = random.Random(dims)
    centres = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(12)]
    rows = [(a, p, [c + rng.gauss(0, 0.08) * (1 + abs(c)) for c in rng.choice(centres)]) for a in ("x", "y") for p in range(150)]
    rows += [("x", 150, [0.0] * dims), ("x", 151, [0.0] * dims), ("y", 160, rows[3][2]), ("z", 1, [1e-9] * dims)]
    df = spark.createDataFrame(rows, "job string, phase long, vector array<double>").repartition(4)
    for limits in ({}, {"min_seen": 2, "max_traced": 3}, {"min_likeness": 60, "min_seen": 1}):
        got = signals.representatives_in_rounds(df, app="job", **limits)
        want = signals.representatives(df, app="job", **limits)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), limits


def test_representatives_in_rounds_of_one_application_and_of_none(spark):
    rows = [(0, [10.0, 1.0]), (1, [10.2, 1.0]), (2, [1.0, 9.0]), (3, [10.0, 1.1]), (4, [1.0, 9.1])]
    df = spark.createDataFrame(rows, "phase long, vector array<double>")
    assert sorted(map(tuple, signals.representatives_in_rounds(df).collect())) == sorted(map(tuple, signals.representatives(df).collect()))
    empty = signals.representatives_in_rounds(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["phase", "representative", "seen", "traced"]
