"""Further registered queries: channels and graphs, policies, signals, and the smaller trace operators."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.functions import sdf
from tracewright.operators import features, graph, scopes
from tracewright.operators import trace as T
from tracewright.plans import fixtures
from tracewright.plans.queries import BURSTS, COO, INTERVALS, SIDES, _bursts, _matrix, _sides, events, is_, query, table
from tracewright.sources import traces
from tracewright.streaming import signals

# trace --------------------------------------------------------------------------------------------------------------


@query(INTERVALS + " SELECT task, t0, t1, state FROM v WHERE state NOT IN ('error')")
def excluded_states(spark, d):
    return T.drop_states(T.next_event_intervals(events(spark, d), ["task"], "time", "seq", "type"), ["error"])


@query("WITH m AS (SELECT * FROM (VALUES ('click', 50000001), ('view', 50000002)) t(type, grouped)) SELECT event_id AS seq, m.grouped FROM events LEFT JOIN m ON m.type = event_type")
def type_translation(spark, d):
    m = spark.createDataFrame([("click", 50000001), ("view", 50000002)], "type string, grouped int")  # a fixed dictionary
    return T.encode(events(spark, d), m).select("seq", "grouped")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return T.event_counts(events(spark, d), ["type"])


@query("SELECT user_id % 16 AS worker, CAST(sum(octet_length(CAST(props AS BLOB))) AS BIGINT) AS bytes FROM events GROUP BY 1")
def size_per_worker(spark, d):
    return T.sizes(table(spark, d, "events").withColumn("worker", F.col("user_id") % 16), ["worker"], "props")


@query("{EV} SELECT seq, max(cents % 13) OVER (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING) AS virtual_thread FROM e")
def max_virtual_thread(spark, d):
    return T.running_max(events(spark, d), ["task"], ["seq"], F.col("cents") % 13, "virtual_thread").select("seq", "virtual_thread")


@query("{EV} SELECT task % 10 AS node, max(cents) AS most, CAST(sum(cents) AS BIGINT) AS whole, bool_or(type = 'error') AS failed FROM e GROUP BY 1")
def reduced_over_workers(spark, d):
    return T.reduced(events(spark, d).withColumn("node", F.col("task") % 10), ["node"], {"most": F.col("cents")}, {"whole": F.col("cents")}, {"failed": is_("error")})


@query("{EV}, r AS (SELECT time // 86400000000 AS day, unnest([type, 'cycles']) AS counter, unnest([cents, seq]) AS v FROM e), c AS (SELECT time // 86400000000 AS day, count(*) AS n FROM e GROUP BY 1) SELECT r.day, r.counter, CAST(sum(r.v) AS BIGINT) AS n FROM r JOIN c USING (day) GROUP BY r.day, r.counter, c.n HAVING count(*) = c.n")
def counter_sums_common(spark, d):
    r = events(spark, d).select(F.expr("time div 86400000000").alias("day"), F.create_map("type", "cents", F.lit("cycles"), "seq").alias("counters"))
    return T.counter_sums(r, ["day"], common=True)


@query(BURSTS + " SELECT task, ts, dur FROM b WHERE dur > 3600000000")
def burst_mode(spark, d):
    return T.long_bursts(_bursts(spark, d), 3_600_000_000)


@query(SIDES + " SELECT task, count(*) FILTER (r.seq IS NOT NULL) AS matched, count(*) FILTER (r.seq IS NULL) AS unmatched FROM s LEFT JOIN r USING (task, k) GROUP BY task")
def message_totals(spark, d):
    s, r = _sides(spark, d)
    m = T.match_messages(s, r, ["task"], ["time", "seq"]).groupBy("task").agg(F.count("*").alias("matched"))
    u = T.unmatched_sends(s, r, ["task"], ["time", "seq"]).groupBy("task").agg(F.count("*").alias("unmatched"))
    return m.join(u, "task", "full").select("task", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "unmatched")])


@query("{EV} SELECT seq, '2:1:1:' || task || ':1:' || time || ':' || seq || ':' || cents AS line FROM e")
def record_lines(spark, d):
    e = events(spark, d)
    r = e.select("seq", F.lit(2).alias("rtype"), F.lit(1).alias("cpu"), F.lit(1).alias("ptask"), "task", F.lit(1).alias("thread"), "time", F.col("time").alias("end_time"), F.lit(0).alias("event"), F.lit(0).alias("value"), *[F.lit(0).alias(c) for c in ("cpu_r", "ptask_r", "task_r", "thread_r", "log_r", "phy_r")], F.array(F.struct(F.col("seq").alias("type"), F.col("cents").alias("value"))).alias("pairs"))
    return traces.record_lines(r).select(F.split("value", ":")[6].cast("long").alias("seq"), F.col("value").alias("line"))


@query("{EV} SELECT DISTINCT 'TASK ' || 1 || '.' || task AS value FROM e")
def row_names(spark, d):
    o = events(spark, d).select(F.lit(1).alias("ptask"), "task", F.lit(1).alias("thread"), F.lit("n").alias("node"), F.lit(1).alias("cpu"))
    return traces.row_names(o).where("level = 'TASK'").select("value")


@query("{EV} SELECT seq, 'EV: ' || seq || ' VAL: ' || cents || ' PARAM: ' || task AS value FROM e")
def dumped_events(spark, d):
    e = events(spark, d).select(F.lit("f").alias("file"), "seq", "time", F.col("seq").alias("type"), F.col("cents").alias("value"), F.col("task").alias("param"))
    return traces.dump(e, with_time=False).select("seq", "value")


@query(BURSTS + ", z AS (SELECT DISTINCT task, time // 864000000000 * 864000000000 AS t0, time // 864000000000 * 864000000000 + 432000000000 AS t1 FROM e) SELECT b.task, b.ts, b.dur, CASE WHEN b.dur < 3600000000 OR z.t0 IS NULL OR b.ts >= z.t1 THEN 'none' ELSE 'profile' END AS policy FROM b LEFT JOIN z ON z.task = b.task AND z.t0 <= b.ts AND NOT EXISTS (SELECT 1 FROM z y WHERE y.task = b.task AND y.t0 <= b.ts AND y.t0 > z.t0)")
def detail_policy(spark, d):
    t0 = F.expr("time div 864000000000 * 864000000000")
    z = events(spark, d).select("task", t0.alias("t0"), (t0 + 432000000000).alias("t1"), F.lit("profile").alias("policy")).distinct()
    return signals.detail_policy(_bursts(spark, d), z, 3_600_000_000)


@query("SELECT c_custkey AS plan, l AS loop, r AS round, c_nationkey + r * (c_custkey % 5 + 1) AS load FROM customer, range(2) a(l), range(4) b(r) WHERE r < c_custkey % 3 + 2")
def injection_schedule(spark, d):
    """A schedule for each customer, by its own start, step and rounds."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"), F.col("c_nationkey").cast("long").alias("start"), (F.col("c_custkey") % 5 + 1).alias("step"), (F.col("c_custkey") % 3 + 2).alias("rounds"), F.lit(2).alias("loops"))
    return signals.injection_schedule(c, ["plan"])


@query("{EV}, n AS (SELECT task, time, cents, row_number() OVER (PARTITION BY task ORDER BY time) AS k, count(*) OVER (PARTITION BY task) AS n FROM e) SELECT task, min(time) AS time, round(avg(cents), 6) AS value FROM n GROUP BY task, (k - 1) // CAST(ceil(n / 20.0) AS BIGINT)")
def signal_compressed(spark, d):
    s = events(spark, d).select("task", "time", F.col("cents").alias("value"))
    return signals.compress(s, ["task"], 20).select("task", "time", F.round("value", 6).alias("value"))


# scopes and changes -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS scope_id, w.weight FROM part LEFT JOIN (SELECT p_brand AS name, max(p_size) AS weight FROM part WHERE p_brand <> '*' GROUP BY 1) w ON w.name = p_brand")
def scope_name_weight(spark, d):
    p = table(spark, d, "part")
    named = p.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("weight"))
    return scopes.name_weights(p.select(F.col("p_partkey").alias("scope_id"), F.col("p_brand").alias("name")), named).select("scope_id", "weight")


@query("SELECT a.fun, a.var_name, a.var_pos, b.par_pos FROM (VALUES ('f', 'x', 0), ('f', 'y', 1), ('g', 'x', 0)) a(fun, var_name, var_pos) JOIN (VALUES ('f', 'x', 2), ('g', 'z', 0)) b(fun, par_name, par_pos) ON a.fun = b.fun AND a.var_name = b.par_name")
def parameter_links(spark, d):
    a = spark.createDataFrame([("f", "x", 0), ("f", "y", 1), ("g", "x", 0)], "fun string, var_name string, var_pos int")
    b = spark.createDataFrame([("f", "x", 2), ("g", "z", 0)], "fun string, par_name string, par_pos int")
    return scopes.parameter_links(a, b)


@query(fixtures.golden_sql("scope_id, elements", [(0, 100), (1, 100), (2, 100)]))
def memory_propagation(spark, d):
    params = spark.createDataFrame([("f", 0, "a", 100), ("f", 1, "a", None), ("f", 2, "a", None)], "file string, scope_id int, var string, elements long")
    tree = spark.createDataFrame([("f", 0, 1), ("f", 1, 2)], "file string, parent int, child int")
    return scopes.propagate_memory(params, tree).select("scope_id", "elements")


@query("SELECT x AS kind, i AS code FROM (VALUES ('NONE', 0), ('MAP', 1), ('ITN', 2), ('ZIPWITH', 3), ('FOLDL', 4), ('MEMALLOC', 5), ('MEMFREE', 6)) t(x, i)")
def scope_kinds(spark, d):
    codes = spark.range(7).select(X.scope_kind(F.col("id").cast("int")).alias("kind"))
    return codes.select("kind", X.scope_code(F.col("kind")).alias("code"))


# graphs -------------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber = 2 THEN 7 ELSE 0 END AS tokens FROM lineitem")
def bound_channels(spark, d):
    c = table(spark, d, "lineitem").select(F.lit("g").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("var"), F.col("l_quantity").cast("long").alias("tokens"))
    return graph.bind(c, spark.createDataFrame([("g", "v2", 7)], "graph_id string, var string, value long")).select("src", "dst", "tokens")


@query("SELECT DISTINCT n_nationkey AS node FROM nation WHERE n_nationkey IN (SELECT n_regionkey FROM nation)")
def without_sinks(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.lit("g").alias("graph_id"), F.col("n_nationkey").alias("node"))
    edges = n.select(F.lit("g").alias("graph_id"), F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return graph.remove_sinks(nodes, edges)[0].select("node")


@query(fixtures.golden_sql("graph_id, channels, tokens", [("csdf", 6, 7), ("mrsdf", 4, 64), ("hsdf", 7, 7), ("cycle3", 3, 17)]))
def reverse_channels(spark, d):
    return fixtures.graphs(spark)[1].groupBy("graph_id").agg(F.count("*").alias("channels"), F.sum("tokens").alias("tokens"))


@query(fixtures.golden_sql("graph_id, phase_channels", [("csdf", 4 + 4 + 6 + 6 + 9 + 4), ("mrsdf", 4), ("hsdf", 7), ("cycle3", 3)]))
def multi_rate_size(spark, d):
    return graph.multi_rate(*fixtures.graphs(spark)).groupBy("graph_id").agg(F.count("*").alias("phase_channels"))


@query("SELECT * FROM (VALUES ('csdf', true), ('mrsdf', true), ('hsdf', true), ('cycle3', true)) t(graph_id, within)")
def single_rate_upper_bounds(spark, d):
    b = graph.single_rate_bounds(*fixtures.graphs(spark))
    p = graph.throughput(*fixtures.graphs(spark))
    return b.join(p, "graph_id").select("graph_id", (F.col("num") / F.col("den") <= F.col("upper") + 1e-9).alias("within"))


@query(fixtures.golden_sql("graph_id, num, den, deadlock", [("dead", 1, 1, False), ("dag", None, None, False), ("m2", 9, 1, False), ("m2neg", -3, 1, False)]))
def max_cycle_mean(spark, d):
    return graph.max_cycle_ratios(fixtures.weighted(spark).where("graph_id in ('dead', 'dag', 'm2', 'm2neg')"), mean=True)


@query(fixtures.golden_sql("graph_id, starts_at_zero, firings", [("csdf", True, 19), ("mrsdf", True, 33), ("hsdf", True, 3), ("cycle3", True, 31)]))
def sdf_schedule(spark, d):
    return graph.schedule(*fixtures.graphs(spark)).groupBy("graph_id").agg((F.min(F.col("start_num") / F.col("start_den")) == 0).alias("starts_at_zero"), F.count("*").alias("firings"))


@query("SELECT 8.0 AS first, 9.5 AS second")
def minimum_parameters(spark, d):
    g = [(1, 2, 5, 2, "d2"), (2, 3, 4, 3, "d1"), (3, 1, 3, 1, "d4"), (2, 4, 7, 3, "d3"), (4, 1, 6, 0, None), *((i, i, 0, 1, f"d{i}") for i in range(1, 5))]
    names = ["d1", "d2", "d3", "d4"]
    more = [e for e in g if e[:2] not in ((1, 1), (4, 4))] + [(1, 1, 1, 1, "d1"), (4, 4, 1, 1, "d4"), (4, 5, 2, 1, "d1"), (5, 4, 3, 1, "d3")]
    sums = [float(sum(sdf.minimum_parameters(e, names).values())) for e in (g, more)]
    return spark.createDataFrame([tuple(sums)], "first double, second double")


@query("SELECT 'mrsdf' AS graph_id, true AS met")
def buffer_sizes(spark, d):
    actors, channels = fixtures.graphs(spark)
    a, c = actors.where("graph_id = 'mrsdf'"), channels.where("graph_id = 'mrsdf'")
    sized = graph.buffer_sizes(a, c, (F.col("src") == "b") & (F.col("dst") == "a"), 70)
    new = c.join(sized.withColumnRenamed("tokens", "t"), ["graph_id", "src", "dst"], "left").withColumn("tokens", F.coalesce("t", "tokens")).drop("t")
    return graph.throughput(a, new).select("graph_id", (F.col("num") <= 70 * F.col("den")).alias("met"))


# by hand: v1 waits for v2's first firing, and v0's third for v1's end at 4
@query(fixtures.golden_sql("time, actor, firing", [(0, "v0", 1), (1, "v0", 2), (1, "v2", 1), (2, "v1", 1), (2, "v2", 2)]))
def marking_simulation(spark, d):
    def run(g, a, c):
        yield from sdf.simulate_marking(a, c, 2)

    actors, channels = fixtures.graphs(spark)
    return graph.per_graph(actors.where("graph_id = 'hsdf'"), channels.where("graph_id = 'hsdf'"), "time long, actor string, firing long", run)


@query(COO + ", x AS (SELECT r AS c, max(v) AS xv FROM a GROUP BY 1) SELECT a.r, max(a.v + x.xv) AS v FROM a JOIN x USING (c) GROUP BY 1")
def maxplus_vector(spark, d):
    a = _matrix(spark, d)
    return graph.mp_apply(a, a.groupBy("r").agg(F.max("v").alias("v")))


@query(fixtures.golden_sql("r, c, v", [("x", "x<x@1", 0), ("x<x@1", "x", 5), ("y", "x", 1)]))
def maxplus_first_order(spark, d):
    return graph.first_order(spark.createDataFrame([(2, "x", "x", 5), (1, "y", "x", 1)], "delay int, r string, c string, v long"))


@query("WITH RECURSIVE l AS (SELECT DISTINCT c_custkey % 40 AS src, (c_custkey * 3 + c_nationkey) % 55 AS dst FROM customer), r AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src) SELECT src, dst FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.src = l.dst AND r.dst = l.src)")
def cycle_edges(spark, d):
    n = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("src"), ((F.col("c_custkey") * 3 + F.col("c_nationkey")) % 55).alias("dst")).distinct()
    return graph.inside_components(n)


@query("WITH n AS (SELECT count(*) AS n FROM nation), m AS (SELECT count(*) AS m FROM supplier), i AS (SELECT row_number() OVER () - 1 AS i FROM nation), j AS (SELECT row_number() OVER () - 1 AS j FROM supplier) SELECT i * m + j AS src, CASE k WHEN 0 THEN i * m + (j + 1) % m ELSE (i + 1) % n * m + j END AS dst FROM n, m, i, j, range(2) c(k)")
def torus_edges(spark, d):
    """A ring of as many rings as there are nations, with a node for each supplier."""
    return graph.torus(spark, table(spark, d, "nation").count(), table(spark, d, "supplier").count()).select("src", "dst")


@query("SELECT l_orderkey, gcd(min(l_partkey), max(l_suppkey)) AS g FROM lineitem GROUP BY 1")
def rate_gcd(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(F.min("l_partkey")).alias("production"), F.array(F.max("l_suppkey")).alias("consumption"))
    return graph.rate_gcd(c).select("l_orderkey", "g")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + (l_partkey % 9) * 3 - (l_suppkey % 7) * 2 AS tokens FROM lineitem")
def tokens_after_firings(spark, d):
    one = lambda n: F.array(F.lit(n).cast("long"))
    t = X.channel_tokens(F.col("l_quantity").cast("long"), one(3), one(2), F.col("l_partkey") % 9, F.col("l_suppkey") % 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("tokens"))


@query("SELECT * FROM (VALUES ('[3 * 1, 2]', '1,1,1,2'), ('4', '4'), ('[1,0,1]', '1,0,1')) t(rates, parsed)")
def parsed_rates(spark, d):
    r = spark.createDataFrame([("[3 * 1, 2]",), ("4",), ("[1,0,1]",)], "rates string")
    return r.select("rates", F.array_join(X.parse_rates(F.col("rates")).cast("array<string>"), ",").alias("parsed"))


@query("SELECT n AS n, (SELECT count(*) FROM range(1, 200) t(k) WHERE n % k = 0) = 2 AS prime FROM range(1, 200) s(n)")
def primes(spark, d):
    return spark.range(1, 200).select(F.col("id").alias("n"), X.is_prime(F.col("id")).alias("prime"))


@query("SELECT n, (SELECT min(k) FROM range(1, 97) t(k) WHERE n * k % 97 = 1) AS inverse FROM range(1, 97) s(n)")
def modular_inverses(spark, d):
    return spark.range(1, 97).select(F.col("id").alias("n"), X.modinv(F.col("id"), F.lit(97)).alias("inverse"))


@query("SELECT event_id AS seq, greatest(CASE WHEN user_id % 2 = 0 THEN user_id END, CASE WHEN event_id % 3 = 0 THEN event_id END) AS added, CASE WHEN user_id % 2 = 0 THEN user_id END + CASE WHEN event_id % 3 = 0 THEN event_id END AS multiplied FROM events")
def maxplus_scalars(spark, d):
    a, b = F.when(F.col("task") % 2 == 0, F.col("task")), F.when(F.col("seq") % 3 == 0, F.col("seq"))
    return events(spark, d).select("seq", X.mp_add(a, b).alias("added"), X.mp_times(a, b).alias("multiplied"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z_]+'))) AS n FROM documents WHERE text IS NOT NULL")
def identifier_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.identifiers(F.col("text"))).cast("long").alias("n"))


# policies -----------------------------------------------------------------------------------------------------------


@query("{EV}, m AS (SELECT coalesce(lag(type) OVER (PARTITION BY task ORDER BY seq), 'start') AS state, cents % 5 AS action, type AS next FROM e), k AS (SELECT state, action, max(next) AS next FROM m GROUP BY 1, 2) SELECT s.state, a.action, coalesce(k.next, s.state) AS next_state FROM (SELECT DISTINCT type AS state FROM e UNION SELECT 'start') s CROSS JOIN range(7) a(action) LEFT JOIN k ON k.state = s.state AND k.action = a.action")
def transition_table(spark, d):
    s = events(spark, d).withColumn("rule", F.col("cents") % 5).withColumn("start", F.lit("start"))
    moves = features.transitions(s, "task", "seq", "type", "rule", "start")
    states = s.select(F.col("type").alias("state")).union(spark.createDataFrame([("start",)], "state string")).distinct()
    return features.transition_table(moves, states, spark.range(7).withColumnRenamed("id", "action"))


@query("{EV}, q AS (SELECT task AS state, cents % 5 AS action, max(cents // 1000) AS q FROM e GROUP BY ALL), b AS (SELECT state, max(q) AS q FROM q GROUP BY 1) SELECT state, min(action) AS action FROM q JOIN b USING (state, q) GROUP BY 1")
def first_argmax(spark, d):
    q = events(spark, d).groupBy(F.col("task").alias("state"), (F.col("cents") % 5).alias("action")).agg(F.max(F.expr("cents div 1000")).alias("q"))
    return features.first_argmax(q, "state", "action", "q")


@query("SELECT 0 AS state, 5 AS id_change")
def chosen_change(spark, d):
    ch = spark.createDataFrame([(0, 4, 7, 1), (0, 4, 5, 1), (0, 4, 3, 2)], "state int, rule int, id_change int, result int")
    return features.choose_change(ch, spark.createDataFrame([(0, 4, 1)], "state int, rule int, next_state int"))


@query("SELECT i AS id, CASE WHEN i > 4 THEN 1 ELSE 0 END AS predicted FROM range(10) t(i)")
def decision_tree(spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(10).select("id", F.array("id", F.col("id") % 3).alias("feat"), F.when(F.col("id") > 4, 1).otherwise(0).alias("label"))
    told = features.decision_tree(rows).transform(rows.select("id", array_to_vector(F.col("feat").cast("array<double>")).alias("features")))
    return told.select("id", F.col("prediction").cast("int").alias("predicted"))


@query(fixtures.golden_sql("for_loops, ifs, ternaries, empty_ifs, non_unit_steps", [(1, 1, 1, 1, 1)]))
def lexical_features(spark, d):
    code = spark.createDataFrame([("for (i = 0; i < 4; i += 2) { if (a) ; b[i] = a ? 1 : 2; }",)], "code string")
    return code.select(*[x.alias(n) for n, x in features.lexical_features(F.col("code")).items() if n in ("for_loops", "ifs", "ternaries", "empty_ifs", "non_unit_steps")])


@query("SELECT 0.5 AS ratio")
def cycle_sums(spark, d):
    cycle = [(1, 2, Fraction(1), Fraction(2)), (2, 1, Fraction(2), Fraction(4))]
    w, t = sdf.each_cycle_sum(cycle, lambda e: e[2]), sdf.each_cycle_sum(cycle, lambda e: e[3])
    return spark.createDataFrame([(float(w / t),)], "ratio double")




@query("SELECT file, line, address, row_number() OVER (ORDER BY file, line, address) + 1 AS id FROM (SELECT DISTINCT p_brand AS file, p_size AS line, p_partkey AS address FROM part)")
def address_ids(spark, d):
    return T.address_ids(table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("address")))


@query("{EV}, i AS (SELECT task, time AS t0, coalesce(lead(time) OVER (PARTITION BY task ORDER BY time, seq), 2000000000000000) AS t1, type AS state FROM e UNION ALL SELECT task, 0, min(time), 'Stopped' FROM e GROUP BY task) SELECT * FROM i WHERE t0 < t1")
def bounded_states(spark, d):
    return T.bounded_intervals(events(spark, d), ["task"], "time", "seq", "type", "Stopped", 2_000_000_000_000_000)


@query("SELECT event_id AS seq FROM events WHERE event_type NOT IN ('error', 'signup')")
def skipped_types(spark, d):
    return T.skip(events(spark, d), ["error", "signup"]).select("seq")


@query(fixtures.golden_sql("graph_id, period", [("csdf", 18), ("mrsdf", 70), ("hsdf", 2), ("cycle3", 6)]))
def critical_cycle(spark, d):
    c = graph.critical_cycles(*fixtures.graphs(spark)).groupBy("graph_id").agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t"))
    return c.select("graph_id", F.expr("w div t").alias("period"))


@query("SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place FROM customer")
def input_order(spark, d):
    """Inputs by object, then order."""
    return T.global_rank(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"], "place")
