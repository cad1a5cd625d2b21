"""Registered queries, each with the SQL that it must agree with. The `events` table stands in for a trace: user_id is the
task, ts (in microseconds) the time, event_id the sequence number, event_type the type and value, in hundredths, the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import energy, features, graph, scopes
from tracewright.operators import trace as T
from tracewright.plans import fixtures
from tracewright.streaming import signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EV = "WITH e AS (SELECT user_id AS task, epoch_us(ts) AS time, event_id AS seq, event_type AS type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{EV}", EV)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("task"), X.micros(F.col("ts")).alias("time"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def is_(kind: str):
    return F.col("type") == kind


# order and clocks ---------------------------------------------------------------------------------------------------


@query("{EV} SELECT seq, row_number() OVER (ORDER BY time, CASE WHEN type = 'error' THEN 1 ELSE 0 END, task, seq) AS rank FROM e")
def event_merge_order(spark, d):
    e = events(spark, d).withColumn("lane", F.when(is_("error"), 1).otherwise(0)).withColumn("file_idx", F.col("task"))
    return T.merge_order(e).select("seq", "rank")


@query("{EV} SELECT seq, row_number() OVER (ORDER BY time // 3600000000, CASE type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, task, seq) AS rank FROM e")
def record_merge_order(spark, d):
    e = events(spark, d).select(F.expr("time div 3600000000").alias("time"), F.when(is_("purchase"), 3).when(is_("click"), 2).otherwise(1).alias("rtype"), F.col("task").alias("file_idx"), "seq")
    return T.record_order(e).select("seq", "rank")


@query("{EV} SELECT task, seq, k FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS k FROM e) WHERE k <= 7")
def first_events(spark, d):
    return T.first_n(events(spark, d), 7, "task", "seq").withColumn("k", F.row_number().over(Window.partitionBy("task").orderBy("seq"))).select("task", "seq", "k")


def _tasks(spark, d):
    points = T.sync_points(events(spark, d), "task", "time", F.lit(True), is_("purchase"), is_("signup"))
    return points.withColumn("node", F.col("task") % 4)


TASKS = EV + ", t AS (SELECT task, min(time) AS init, coalesce(min(time) FILTER (type = 'purchase'), min(time) FILTER (type = 'signup'), min(time)) AS sync, task % 4 AS node FROM e GROUP BY task)"


@query(TASKS + ", r AS (SELECT *, max(sync) OVER () - sync AS raw FROM t) SELECT task, init, sync, raw - min(init + raw) OVER () AS latency FROM r")
def clock_sync_task(spark, d):
    return T.latencies(_tasks(spark, d), "task").select("task", "init", "sync", "latency")


@query(TASKS + ", r AS (SELECT *, max(sync) OVER () - max(sync) OVER (PARTITION BY node) AS raw FROM t) SELECT task, node, raw - min(init + raw) OVER () AS latency FROM r")
def clock_sync_node(spark, d):
    return T.latencies(_tasks(spark, d), "node").select("task", "node", "latency")


@query(TASKS + ", r AS (SELECT *, max(sync) OVER () - sync AS raw FROM t), l AS (SELECT task, raw - min(init + raw) OVER () AS latency FROM r) SELECT e.seq, e.time + l.latency AS time FROM e JOIN l USING (task)")
def synchronised_events(spark, d):
    return T.synchronise(events(spark, d), T.latencies(_tasks(spark, d), "task"), ["task"]).select("seq", "time")


# states -------------------------------------------------------------------------------------------------------------

INTERVALS = EV + ", i AS (SELECT task, time AS t0, lead(time) OVER (PARTITION BY task ORDER BY time, seq) AS t1, type AS state FROM e), v AS (SELECT * FROM i WHERE t0 < t1)"


@query(INTERVALS + " SELECT task, t0, t1, state FROM v")
def state_intervals(spark, d):
    return T.next_event_intervals(events(spark, d), ["task"], "time", "seq", "type")


@query(INTERVALS + ", m AS (SELECT *, CASE WHEN lag(state) OVER w = state AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY task ORDER BY t0)), g AS (SELECT *, sum(new) OVER (PARTITION BY task ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT task, min(t0) AS t0, max(t1) AS t1, any_value(state) AS state FROM g GROUP BY task, run")
def state_joined(spark, d):
    return T.join_states(T.next_event_intervals(events(spark, d), ["task"], "time", "seq", "type"), ["task"])


@query(INTERVALS + " SELECT task, state, CAST(sum(t1 - t0) AS BIGINT) AS busy, count(*) AS n FROM v GROUP BY task, state")
def time_in_state(spark, d):
    return T.next_event_intervals(events(spark, d), ["task"], "time", "seq", "type").groupBy("task", "state").agg(F.sum(F.col("t1") - F.col("t0")).alias("busy"), F.count("*").alias("n"))


@query("{EV}, a AS (SELECT task, time, seq, CASE WHEN type = 'click' THEN 1 ELSE 0 END AS push, lag(CASE WHEN type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY time, seq) AS prev FROM e WHERE type IN ('click', 'purchase')), s AS (SELECT *, sum(CASE WHEN push = prev THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS run FROM a), r AS (SELECT task, run, any_value(push) AS push, min(time) AS t FROM s GROUP BY task, run), x AS (SELECT task, push, t AS t0, lead(t) OVER (PARTITION BY task ORDER BY run) AS t1 FROM r) SELECT task, t0, coalesce(t1, 2000000000000000) AS t1, 1 AS state FROM x WHERE push = 1")
def state_stack(spark, d):
    e = events(spark, d).where(is_("click") | is_("purchase"))
    w = Window.partitionBy("task").orderBy("time", "seq")
    first = F.lag("type").over(w)
    # the trace is made flat: a push only after a pop and the other way round
    flat = e.withColumn("p", first).where("p is null or p <> type")
    acts = flat.select("task", "time", "seq", F.when(is_("click"), "push").otherwise("pop").alias("action"), F.lit(1).alias("state"))
    return T.state_intervals(acts, ["task"], end_time=2_000_000_000_000_000, drop=(0, 2))


@query("{EV} SELECT seq, count(*) FILTER (type = 'signup') OVER w AS segment, arg_max(cents, seq) FILTER (type = 'signup') OVER w AS mode FROM e WINDOW w AS (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def mode_segments(spark, d):
    return T.mode_segments(events(spark, d), ["task"], ["seq"], F.when(is_("signup"), F.col("cents"))).select("seq", "segment", "mode")


# counters and groups ------------------------------------------------------------------------------------------------


@query("{EV}, c AS (SELECT *, cents - lag(cents) OVER (PARTITION BY task, type ORDER BY time, seq) AS delta FROM e) SELECT seq, delta FROM c WHERE delta >= 0")
def counter_delta(spark, d):
    return T.counter_deltas(events(spark, d), ["task", "type"], ["time", "seq"], "cents").select("seq", "delta")


@query("{EV}, c AS (SELECT *, count(*) FILTER (type = 'signup') OVER (PARTITION BY task ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM e), p AS (SELECT *, cents - lag(cents) OVER (PARTITION BY task, epoch ORDER BY time, seq) AS delta FROM c) SELECT seq, epoch, delta FROM p WHERE delta >= 0")
def counter_epoch(spark, d):
    e = T.counter_epochs(events(spark, d), ["task"], ["time", "seq"], is_("signup"))
    return T.counter_deltas(e, ["task", "epoch"], ["time", "seq"], "cents").select("seq", "epoch", "delta")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem) SELECT l_orderkey, epoch_us(l_shipdate) AS ship, (k - 1) // 2 AS line, string_agg(l_linenumber || '=' || l_partkey, ',' ORDER BY k) AS pairs FROM l GROUP BY ALL")
def multi_event_group(spark, d):
    li = table(spark, d, "lineitem").withColumn("type", F.col("l_linenumber")).withColumn("value", F.col("l_partkey"))
    out = T.multi_events(li, ["l_orderkey", "l_shipdate"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"], 2)
    pairs = F.array_join(F.transform("pairs", lambda x: F.concat(x["type"].cast("string"), F.lit("="), x["value"].cast("string"))), ",")
    return out.select("l_orderkey", X.micros(F.col("l_shipdate")).alias("ship"), "line", pairs.alias("pairs"))


@query("{EV} SELECT seq, last_value(CASE WHEN type = 'click' THEN cents END IGNORE NULLS) OVER (PARTITION BY task ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS begun FROM e")
def begin_of_event(spark, d):
    return T.begin_of(events(spark, d), ["task"], ["time", "seq"], is_("click"), "cents", "begun").select("seq", "begun")


@query("{EV}, f AS (SELECT task, type, time, seq, cents % 3 AS v FROM e), s AS (SELECT *, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER w AS pushes FROM f WINDOW w AS (PARTITION BY task, type ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) SELECT seq, pushes FROM s")
def stacked_pushes(spark, d):
    e = events(spark, d).withColumn("value", F.col("cents") % 3)
    w = Window.partitionBy("task", "type").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("pushes", F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).over(w)).select("seq", "pushes")


# the depth after an event is the running sum less its own minimum so far, as pops of an empty stack do nothing; on top is the latest push to that depth
@query("{EV}, f AS (SELECT task, type, time, seq, cents % 3 AS v, sum(CASE WHEN cents % 3 > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY task, type ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS s FROM e), g AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY task, type ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) AS depth FROM f) SELECT task, type, seq, CASE WHEN depth = 0 THEN 0 ELSE last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY task, type, depth ORDER BY time, seq ROWS UNBOUNDED PRECEDING) END AS top FROM g")
def stacked_types(spark, d):
    e = events(spark, d).withColumn("value", F.col("cents") % 3)
    return T.stacked_types(e, ["task"]).select("task", "type", "seq", "top")


# messages -----------------------------------------------------------------------------------------------------------

SIDES = EV + ", s AS (SELECT task, seq, time, row_number() OVER (PARTITION BY task ORDER BY time, seq) AS k FROM e WHERE type = 'click'), r AS (SELECT task, seq, time, row_number() OVER (PARTITION BY task ORDER BY time, seq) AS k FROM e WHERE type = 'purchase')"


def _sides(spark, d):
    e = events(spark, d).select("task", "seq", "time", "type")
    return e.where(is_("click")).drop("type"), e.where(is_("purchase")).drop("type")


@query(SIDES + " SELECT task, s.seq AS s_seq, r.seq AS r_seq, s.time AS s_time, r.time AS r_time FROM s JOIN r USING (task, k)")
def message_match(spark, d):
    return T.match_messages(*_sides(spark, d), ["task"], ["time", "seq"]).drop("ordinal")


@query(SIDES + " SELECT task, seq FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.task = s.task AND r.k = s.k)")
def message_unmatched(spark, d):
    return T.unmatched_sends(*_sides(spark, d), ["task"], ["time", "seq"]).select("task", "seq")


@query(SIDES + " SELECT task, s.seq AS send_seq, r.seq AS recv_seq FROM s JOIN r USING (task, k)")
def message_any_tag(spark, d):
    s, r = _sides(spark, d)
    ends = s.select("task", "time", "seq", F.lit("send").alias("kind"), F.lit(5).alias("tag")).union(r.select("task", "time", "seq", F.lit("recv"), F.lit(T.ANY_TAG)))
    return T.match_wildcard(ends, ["task"])


@query("{EV}, z AS (SELECT *, count(*) FILTER (type = 'error') OVER (PARTITION BY task ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS zone FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY task, zone ORDER BY time, seq) AS k FROM z WHERE type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY task, zone ORDER BY time, seq) AS k FROM z WHERE type = 'purchase') SELECT s.seq AS s_seq, r.seq AS r_seq, zone FROM s JOIN r USING (task, zone, k)")
def message_zones(spark, d):
    z = T.zones(events(spark, d), ["time", "seq"], is_("error"), ["task"]).select("task", "zone", "seq", "time", "type")
    return T.match_messages(z.where(is_("click")), z.where(is_("purchase")), ["task", "zone"], ["time", "seq"]).select("s_seq", "r_seq", "zone")


@query("{EV} SELECT c.seq, (SELECT min(v.time) FROM e v WHERE v.type = 'view' AND v.task = c.task AND v.time >= c.time) AS found FROM e c WHERE c.type = 'click'")
def request_resolve(spark, d):
    e = events(spark, d)
    right = e.where(is_("view")).select("task", "time", F.col("time").alias("found"))
    return T.asof(e.where(is_("click")).select("task", "time", "seq"), right, ["task"], "time", ["found"], "forward").select("seq", "found")


@query("{EV} SELECT c.seq, (SELECT arg_max(v.cents, v.time) FROM e v WHERE v.type = 'signup' AND v.task = c.task AND v.time <= c.time) AS cents FROM e c WHERE c.type = 'purchase'")
def persistent_latest(spark, d):
    e = events(spark, d)
    right = e.where(is_("signup")).select("task", "time", "cents")
    return T.asof(e.where(is_("purchase")).select("task", "time", "seq"), right, ["task"], "time", ["cents"]).select("seq", "cents")


@query("SELECT event_id AS seq, 'send' AS kind, user_id + 1 AS partner, 7 AS tag FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'recv', user_id + 2, 8 FROM events WHERE event_type = 'click'")
def sendrecv_sides(spark, d):
    c = events(spark, d).where(is_("click")).select("seq", (F.col("task") + 1).alias("to"), (F.col("task") + 2).alias("from"), F.lit(7).alias("send_tag"), F.lit(8).alias("recv_tag"))
    return T.sendrecv_sides(c)


@query("SELECT event_id AS seq, unnest(['send_size', 'recv_size', 'comm', 'root']) AS what, unnest([user_id, event_id, user_id % 3, user_id % 2]) AS value FROM events")
def collective_sides(spark, d):
    c = events(spark, d).select("seq", F.col("task").alias("send_size"), F.col("seq").alias("recv_size"), (F.col("task") % 3).alias("comm"), (F.col("task") % 2).alias("root"))
    return T.collective_sides(c)


@query("SELECT event_id AS seq, CASE WHEN user_id % 3 = 1 THEN user_id % 3 + 100 ELSE user_id % 3 END AS target_app FROM events")
def interapp_target(spark, d):
    m = events(spark, d).select("seq", (F.col("task") % 3).alias("app"), F.lit(0).alias("task"), F.lit(1).alias("comm"))
    links = spark.createDataFrame([(1, 0, 1, 101)], "app long, task int, comm int, target_app long")
    return T.target_app(m, links).select("seq", "target_app")


@query("{EV}, x AS (SELECT task, min(time) AS t FROM e GROUP BY task), y AS (SELECT task, max(time) AS t FROM e GROUP BY task) SELECT x.task AS pred, y.task AS succ, x.t AS t_send, y.t AS t_recv, 0 AS size, x.task * 10 AS tag FROM x JOIN y ON y.task = x.task + 1 WHERE y.t >= x.t")
def task_dependency(spark, d):
    e = events(spark, d)
    deps = e.select(F.col("task").alias("pred")).distinct().select("pred", (F.col("pred") + 1).alias("succ"), (F.col("pred") * 10).alias("tag"))
    ends = e.groupBy("task").agg(F.min("time").alias("time")).withColumnRenamed("task", "task_id")
    starts = e.groupBy("task").agg(F.max("time").alias("time")).withColumnRenamed("task", "task_id")
    return T.dependencies(deps, ends, starts)


@query("SELECT event_id AS seq FROM events WHERE user_id % 2 = 0 OR (user_id + 3) % 5 IN (0, 2, 4)")
def task_mask(spark, d):
    m = events(spark, d).select("seq", (F.col("task") % 10).alias("src"), ((F.col("task") + 3) % 5).alias("dst"))
    on = spark.createDataFrame([(0,), (2,), (4,), (6,), (8,)], "task long")
    return T.task_mask(m, on, "src", "dst").select("seq")


@query("SELECT event_id AS seq, CASE WHEN c BETWEEN 0 AND 999 THEN 'low' WHEN c BETWEEN 500 AND 5000 THEN 'mid' ELSE NULL END AS handler FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events)")
def handler_dispatch(spark, d):
    return T.dispatch(events(spark, d), [(0, 999, "low"), (500, 5000, "mid")], "cents").select("seq", "handler")


# intervals ----------------------------------------------------------------------------------------------------------

ALLOC = EV + ", a AS (SELECT task % 8 AS core, seq, CASE WHEN type IN ('click', 'view') THEN 'alloc' ELSE 'free' END AS kind, (cents // 50) * 50 AS address, 40 AS size FROM e), l AS (SELECT core, address AS lo, address + size AS hi, seq AS alloc_seq, kind, lead(seq) OVER (PARTITION BY core, address ORDER BY seq) AS free_seq FROM a), r AS (SELECT core, lo, hi, alloc_seq, free_seq FROM l WHERE kind = 'alloc')"


def _regions(spark, d):
    a = events(spark, d).select((F.col("task") % 8).alias("core"), "seq", F.when(is_("click") | is_("view"), "alloc").otherwise("free").alias("kind"), (F.expr("cents div 50") * 50).alias("address"), F.lit(40).alias("size"))
    return T.lifetimes(a, ["core"])


@query(ALLOC + " SELECT core, lo, hi, alloc_seq, free_seq FROM r")
def alloc_lifetimes(spark, d):
    return _regions(spark, d)


@query(ALLOC + ", q AS (SELECT task % 8 AS core, seq, cents + 50 AS address FROM e WHERE type = 'purchase') SELECT q.seq, min(r.alloc_seq) AS alloc_seq FROM q JOIN r ON q.core = r.core AND q.address BETWEEN r.lo AND r.hi AND q.seq > r.alloc_seq AND (r.free_seq IS NULL OR q.seq < r.free_seq) GROUP BY q.seq")
def alloc_lookup(spark, d):
    acc = events(spark, d).where(is_("purchase")).select((F.col("task") % 8).alias("core"), "seq", (F.col("cents") + 50).alias("address"))
    return T.live_region(acc, _regions(spark, d), ["core"], 64).select("seq", "alloc_seq")


@query("WITH m AS (SELECT DISTINCT p_size * 100 AS lo, p_size * 100 + 99 AS hi, 'm' || p_size AS module FROM part) SELECT event_id AS seq, module FROM events JOIN m ON CAST(round(value * 100) AS BIGINT) BETWEEN lo AND hi")
def symbol_lookup(spark, d):
    m = table(spark, d, "part").select((F.col("p_size") * 100).alias("lo"), (F.col("p_size") * 100 + 99).alias("hi"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("module")).distinct()
    return T.range_join(events(spark, d), m, "cents", "lo", "hi", 128).select("seq", "module")


# bursts and phases --------------------------------------------------------------------------------------------------

BURSTS = EV + ", l AS (SELECT *, lag(CASE WHEN type = 'click' THEN time END) OVER (PARTITION BY task ORDER BY time, seq) AS b FROM e), b AS (SELECT task, b AS ts, time - b AS dur FROM l WHERE type <> 'click' AND b IS NOT NULL)"


def _bursts(spark, d):
    return T.bursts(events(spark, d), ["task"], is_("click"), ~is_("click"))


@query(BURSTS + " SELECT task, ts, dur FROM b")
def burst_extract(spark, d):
    return _bursts(spark, d)


@query(BURSTS + ", r AS (SELECT task, dur, sum(dur) OVER (PARTITION BY task ORDER BY dur, ts ROWS UNBOUNDED PRECEDING) AS run, sum(dur) OVER (PARTITION BY task) AS whole FROM b) SELECT task, min(dur) FILTER (run * 100 > whole * 20) AS threshold FROM r GROUP BY task")
def burst_threshold(spark, d):
    return T.share_threshold(_bursts(spark, d), 80, ["task"])


@query(BURSTS + ", i AS (SELECT *, count(*) FILTER (dur >= 86400000000) OVER (PARTITION BY task ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM b) SELECT task, island, min(ts) AS ts, count(*) AS merged, CAST(sum(dur) AS BIGINT) AS dur FROM i GROUP BY task, island")
def burst_merge(spark, d):
    return T.merge_short(_bursts(spark, d), ["task"], 86_400_000_000)


@query("{EV} SELECT time // 86400000000 AS day, count(*) FILTER (type IN ('click', 'view')) AS p2p_count, CAST(coalesce(sum(cents) FILTER (type IN ('click', 'view')), 0) AS BIGINT) AS p2p_bytes, CAST(coalesce(sum(seq) FILTER (type IN ('click', 'view')), 0) AS BIGINT) AS p2p_time, count(*) FILTER (type = 'purchase') AS coll_count, CAST(coalesce(sum(cents) FILTER (type = 'purchase'), 0) AS BIGINT) AS coll_bytes, CAST(coalesce(sum(seq) FILTER (type = 'purchase'), 0) AS BIGINT) AS coll_time FROM e GROUP BY 1")
def phase_stats(spark, d):
    e = events(spark, d).withColumn("day", F.expr("time div 86400000000"))
    return T.phase_stats(e, ["day"], {"p2p": F.col("type").isin("click", "view"), "coll": is_("purchase")}, "cents", "seq")


@query("{EV} SELECT time // 86400000000 AS day, type AS counter, CAST(sum(cents) AS BIGINT) AS n FROM e GROUP BY ALL")
def counter_sums(spark, d):
    r = events(spark, d).select(F.expr("time div 86400000000").alias("day"), F.create_map("type", "cents").alias("counters"))
    return T.counter_sums(r, ["day"])


@query("{EV}, g AS (SELECT task, min(seq) FILTER (type = 'purchase') AS first FROM e GROUP BY task) SELECT e.seq FROM e JOIN g USING (task) WHERE e.seq >= g.first")
def after_first_global(spark, d):
    return T.after_first_global(events(spark, d), ["task"], is_("purchase")).select("seq")


@query(INTERVALS + ", r AS (SELECT task, t0 FROM v WHERE state = 'view') SELECT e.seq, (SELECT max(r.t0) FROM r WHERE r.task = e.task AND r.t0 <= e.time) AS chopped FROM e WHERE e.type = 'error'")
def running_chop(spark, d):
    e = events(spark, d)
    running = T.next_event_intervals(e, ["task"], "time", "seq", "type").where("state = 'view'")
    return T.chop(e.where(is_("error")).select("task", "time", "seq"), running, ["task"]).select("seq", "chopped")


@query(BURSTS + ", s AS (SELECT ts AS time, 1 AS d FROM b UNION ALL SELECT ts + dur, -1 FROM b), g AS (SELECT time, sum(d) AS d FROM s GROUP BY time) SELECT time, CAST(sum(d) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM g")
def signal_sum(spark, d):
    return signals.sum_signals(_bursts(spark, d).withColumn("value", F.lit(1).cast("long"))).select("time", "value")


@query("{EV} SELECT seq, CASE WHEN d THEN 1.0 ELSE 1.5 END AS frequency FROM (SELECT seq, type = 'click' AS d FROM e)")
def phase_frequency(spark, d):
    return events(spark, d).select("seq", signals.next_frequency(F.lit(1.0), is_("click")).alias("frequency"))


# dictionaries -------------------------------------------------------------------------------------------------------


@query("SELECT source, row_number() OVER (ORDER BY source) AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def file_dictionary(spark, d):
    return T.dictionary(table(spark, d, "documents"), "source")


@query("WITH m AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1), f AS (SELECT members, min(l_orderkey) AS first FROM m GROUP BY 1) SELECT members, row_number() OVER (ORDER BY first) AS comm_id FROM f")
def comm_dedup(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("members"))
    return T.communicators(lists, "members", "l_orderkey")


@query("WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) // nullif(gcd(l_partkey, l_suppkey), 0) AS norm_tokens, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_quantity AS BIGINT) // nullif(gcd(l_partkey, l_suppkey), 0) NULLS FIRST, l_partkey, l_suppkey) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, norm_tokens FROM n WHERE k = 1")
def binding_channel(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("tokens"), F.col("l_partkey").alias("production"), F.col("l_suppkey").alias("consumption"))
    return T.binding_channel(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "norm_tokens")


@query("SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS owner FROM lineitem GROUP BY 1")
def distinct_first(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("owner"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("at"))
    return T.distinct_first(li, ["l_partkey"], "owner", "at")


@query("SELECT l_orderkey, gcd(max(l_partkey), max(l_suppkey)) AS g, lcm(max(l_partkey), max(l_suppkey)) AS m, (1 - max(l_partkey) - ((1 - max(l_partkey)) % nullif(max(l_suppkey), 0) + max(l_suppkey)) % nullif(max(l_suppkey), 0)) // nullif(max(l_suppkey), 0) AS f FROM lineitem GROUP BY 1")
def gcd_lcm_floor(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return x.select("l_orderkey", X.gcd(F.col("p"), F.col("s")).alias("g"), X.lcm(F.col("p"), F.col("s")).alias("m"), X.floor_div(1 - F.col("p"), F.col("s")).alias("f"))


# scopes -------------------------------------------------------------------------------------------------------------

SCOPES = "WITH s AS (SELECT 'f' || (p_partkey % 20) AS file, CAST(p_partkey AS INTEGER) AS scope_id, CAST(p_partkey // 20 * 3 AS INTEGER) AS lstart, CAST(p_partkey // 20 * 3 + p_size AS INTEGER) AS lend FROM part), l AS (SELECT DISTINCT 'f' || (p_partkey % 20) AS file, CAST(floor(p_retailprice) AS INTEGER) % 300 AS line FROM part)"


def _scopes(spark, d):
    p = table(spark, d, "part")
    file = F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("file")
    base = F.expr("p_partkey div 20 * 3").cast("int")
    s = p.select(file, F.col("p_partkey").cast("int").alias("scope_id"), base.alias("lstart"), (base + F.col("p_size")).alias("lend"))
    return s, p.select(file, (F.floor("p_retailprice").cast("int") % 300).alias("line")).distinct()


@query(SCOPES + " SELECT l.file, l.line, arg_min(s.scope_id, (s.lend - s.lstart, s.scope_id)) AS scope_id FROM l JOIN s ON l.file = s.file AND l.line BETWEEN s.lstart AND s.lend GROUP BY 1, 2")
def scope_innermost(spark, d):
    s, lines = _scopes(spark, d)
    return scopes.innermost(lines, s)


@query(SCOPES + " SELECT l.file, l.line, (SELECT arg_min(s.scope_id, (s.lstart, s.scope_id)) FROM s WHERE s.file = l.file AND s.lstart > l.line) AS scope_id FROM l")
def scope_next(spark, d):
    s, lines = _scopes(spark, d)
    return scopes.next_scope(lines, s)


@query(SCOPES + ", c AS (SELECT a.file, a.scope_id AS parent, b.scope_id AS child, a.lstart AS a0, a.lend AS a1 FROM s a JOIN s b ON a.file = b.file AND a.lstart < b.lstart AND a.lend >= b.lend) SELECT file, parent, child FROM c WHERE NOT EXISTS (SELECT 1 FROM c m WHERE m.file = c.file AND m.child = c.child AND c.a0 < m.a0 AND c.a1 >= m.a1)")
def scope_children(spark, d):
    return scopes.children(_scopes(spark, d)[0])


@query(SCOPES + ", n AS (SELECT file, line, line % 7 + 1 AS n FROM l), i AS (SELECT n.file, n.line, n.n, arg_min(s.scope_id, (s.lend - s.lstart, s.scope_id)) AS scope_id FROM n JOIN s ON n.file = s.file AND n.line BETWEEN s.lstart AND s.lend GROUP BY 1, 2, 3) SELECT s.file, s.scope_id, CAST(coalesce(sum(i.n), 0) AS BIGINT) AS weight FROM s LEFT JOIN i USING (file, scope_id) GROUP BY 1, 2")
def scope_weight(spark, d):
    s, lines = _scopes(spark, d)
    return scopes.weights(lines.withColumn("n", F.col("line") % 7 + 1), s)


@query("WITH u AS (SELECT conv_id, role AS var, turn AS pos, turn % 2 = 0 AS writes, turn % 3 <> 1 AS reads FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL) SELECT r.conv_id, r.var, w.pos AS src, r.pos AS dst FROM u r JOIN u w ON r.conv_id = w.conv_id AND r.var = w.var AND r.reads AND w.writes AND w.pos < r.pos WHERE NOT EXISTS (SELECT 1 FROM u m WHERE m.conv_id = r.conv_id AND m.var = r.var AND m.writes AND m.pos > w.pos AND m.pos < r.pos)")
def sibling_dataflow(spark, d):
    u = table(spark, d, "conversations").where("conv_id is not null and turn is not null and role is not null").select("conv_id", F.col("role").alias("var"), F.col("turn").alias("pos"), (F.col("turn") % 2 == 0).alias("writes"), (F.col("turn") % 3 != 1).alias("reads"))
    return scopes.sibling_edges(u, ["conv_id"])


@query("WITH o AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS r, list(DISTINCT l_suppkey) AS w FROM lineitem GROUP BY 1) SELECT l_orderkey, NOT list_has_any(r, w) AS independent, len(list_filter(r, lambda x: NOT list_contains(w, x))) AS invariant FROM o")
def access_sets(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("reads"), F.collect_set("l_suppkey").alias("writes"))
    return o.select("l_orderkey", scopes.independent().alias("independent"), scopes.invariant_counts("reads", "writes")[0].cast("long").alias("invariant"))


@query("WITH l AS (SELECT user_id, event_id AS ln, CASE WHEN event_type = 'signup' THEN event_id % 50 END AS marker, event_type <> 'signup' AS ins FROM events), m AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS line, max(CASE WHEN marker IS NOT NULL THEN ln END) OVER (PARTITION BY user_id) AS later FROM l) SELECT CAST(user_id AS VARCHAR) AS file, line, count(*) AS n FROM m WHERE ins AND line IS NOT NULL AND ln < later GROUP BY 1, 2")
def instruction_counts(spark, d):
    e = events(spark, d)
    rows = e.select(F.col("task").cast("string").alias("file"), F.col("seq").alias("ln"), F.when(is_("signup"), F.col("seq") % 50).alias("marker"), (~is_("signup")).alias("is_instruction"))
    return scopes.line_counts(rows)


@query(fixtures.ROLL_UP_SQL)
def scope_roll_up(spark, d):
    out = scopes.roll_up(spark.createDataFrame(fixtures.ROLL_UP, fixtures.ROLL_UP_SCHEMA))
    return out.select("file", "scope_id", F.explode("total").alias("term", "c"))


# energy -------------------------------------------------------------------------------------------------------------


@query("{EV}, s AS (SELECT task, time // 1000 AS ms, max(cents) AS w FROM e GROUP BY ALL), x AS (SELECT *, coalesce((ms - lag(ms) OVER (PARTITION BY task ORDER BY ms)) / 1000.0, 0) AS dt FROM s) SELECT task, round(sum(w * dt), 3) AS energy_j, round(sum(dt), 3) AS seconds, round(CASE WHEN sum(dt) > 0 THEN sum(w * dt) / sum(dt) ELSE 0 END, 3) AS power_w FROM x GROUP BY task")
def energy_integral(spark, d):
    s = events(spark, d).groupBy("task", F.expr("time div 1000").alias("ms")).agg(F.max("cents").cast("double").alias("w"))
    out = energy.integral(s, ["task"], "ms", ["w"])
    return out.select("task", *[F.round(c, 3).alias(c) for c in ("energy_j", "seconds", "power_w")])


@query("SELECT user_id AS task, CAST(max(event_id) - min(event_id) AS BIGINT) AS delta FROM events GROUP BY 1")
def energy_since_reset(spark, d):
    return energy.since_reset(events(spark, d), ["task"], "seq")


@query("{EV}, c AS (SELECT task, seq, sum(cents % 7) OVER w AS u, sum(cents % 3) OVER w AS s, sum(cents % 11) OVER w AS i FROM e WINDOW w AS (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING)), x AS (SELECT task, seq, u - lag(u) OVER v AS du, s - lag(s) OVER v AS ds, i - lag(i) OVER v AS di FROM c WINDOW v AS (PARTITION BY task ORDER BY seq)) SELECT seq, CAST(CASE WHEN du IS NULL THEN NULL WHEN du + ds + di = 0 THEN 0 ELSE (100 * du) // (du + ds + di) END AS BIGINT) AS usage FROM x")
def cpu_usage(spark, d):
    w = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = events(spark, d).select("task", "seq", *[F.sum(F.col("cents") % n).over(w).alias(c) for c, n in (("user", 7), ("system", 3), ("idle", 11))])
    return energy.cpu_usage(s, ["task"], "seq").select("seq", "usage")


# graphs -------------------------------------------------------------------------------------------------------------


@query(fixtures.golden_sql("graph_id, actor, consistent, q, tpi", fixtures.REPETITION))
def sdf_repetition(spark, d):
    return graph.repetition(*fixtures.graphs(spark)).select("graph_id", "actor", "consistent", F.col("q").cast("long").alias("q"), F.col("tpi").cast("long").alias("tpi"))


@query(fixtures.golden_sql("graph_id, nodes, edges", fixtures.EXPANSION))
def sdf_hsdf_size(spark, d):
    e = graph.hsdf_edges(*fixtures.graphs(spark))
    ends = e.select("graph_id", "src", "src_firing").union(e.select("graph_id", "dst", "dst_firing")).distinct().groupBy("graph_id").agg(F.count("*").alias("nodes"))
    return ends.join(e.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id")


@query(fixtures.golden_sql("graph_id, num, den, deadlock", fixtures.PERIODS))
def sdf_throughput(spark, d):
    return graph.throughput(*fixtures.graphs(spark)).drop("cycle_length")


@query(fixtures.golden_sql("graph_id, num, den, deadlock", fixtures.RATIOS))
def max_cycle_ratio(spark, d):
    return graph.max_cycle_ratios(fixtures.weighted(spark))


@query(fixtures.golden_sql("graph_id, src, dst, s", fixtures.SCALES))
def sdf_channel_scale(spark, d):
    return graph.channel_scale(*fixtures.graphs(spark))


@query(fixtures.golden_sql("graph_id, live", [(g, True) for g in ("csdf", "cycle3", "hsdf", "mrsdf")]))
def sdf_liveness(spark, d):
    return graph.liveness(*fixtures.graphs(spark))


LINKS = "WITH l AS (SELECT DISTINCT c_nationkey % 12 AS src, c_custkey % 12 AS dst, CAST((c_nationkey * 7 + c_custkey % 12) % 17 + 1 AS BIGINT) AS weight FROM customer WHERE c_nationkey % 12 <> c_custkey % 12 AND c_custkey % 12 - c_nationkey % 12 <= 2)"


def _links(spark, d):
    c = table(spark, d, "customer")
    src, dst = (F.col("c_nationkey") % 12).cast("long"), F.col("c_custkey") % 12
    return c.select(src.alias("src"), dst.alias("dst"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 12) % 17 + 1).cast("long").alias("weight")).where("src <> dst and dst - src <= 2").distinct()


@query(LINKS.replace("WITH l", "WITH RECURSIVE l") + ", p AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n UNION SELECT l.dst, min(p.dist + l.weight), p.n + 1 FROM p JOIN l ON l.src = p.node WHERE p.n < 12 GROUP BY l.dst, p.n) SELECT node, CAST(min(dist) AS BIGINT) AS dist FROM p GROUP BY node")
def sssp(spark, d):
    return graph.distances(_links(spark, d), 0)[0]


@query("SELECT true AS negative_cycle")
def sssp_negative_cycle(spark, d):
    bad = spark.createDataFrame([(1, 2, 3), (2, 3, -5), (3, 1, 1), (3, 4, 1)], "src long, dst long, weight long")
    return spark.createDataFrame([(graph.distances(bad)[1],)], "negative_cycle boolean")


@query("SELECT CAST(0 AS BIGINT) AS n")
def sssp_verified(spark, d):
    links = _links(spark, d)
    return graph.relaxable(links, graph.distances(links, 0)[0]).agg(F.count("*").alias("n"))


DAG = "l AS (SELECT DISTINCT c_nationkey AS src, c_custkey % 30 AS dst FROM customer WHERE c_custkey % 5 = 0)"


@query("WITH RECURSIVE " + DAG + ", r AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src), n AS (SELECT src AS node FROM l UNION SELECT dst FROM l) SELECT n.node, least(n.node, coalesce((SELECT min(a.dst) FROM r a WHERE a.src = n.node AND EXISTS (SELECT 1 FROM r b WHERE b.src = a.dst AND b.dst = n.node)), n.node)) AS component FROM n")
def scc_components(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 30).alias("dst")).distinct()
    return graph.strong_components(c)


COO = "WITH a AS (SELECT c_nationkey AS r, c_custkey % 20 AS c, CAST(max(round(c_acctbal)) AS BIGINT) AS v FROM customer GROUP BY ALL)"


def _matrix(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("r"), (F.col("c_custkey") % 20).alias("c")).agg(F.max(F.round("c_acctbal")).cast("long").alias("v"))


@query(COO + " SELECT x.r, y.c, max(x.v + y.v) AS v FROM a x JOIN a y ON x.c = y.r GROUP BY 1, 2")
def maxplus_product(spark, d):
    a = _matrix(spark, d)
    return graph.mp_product(a, a)


@query(COO + ", p AS (SELECT x.r, y.c, max(x.v + y.v) AS v FROM a x JOIN a y ON x.c = y.r GROUP BY 1, 2) SELECT x.r, y.c, max(x.v + y.v) AS v FROM p x JOIN a y ON x.c = y.r GROUP BY 1, 2")
def maxplus_power(spark, d):
    return graph.mp_power(_matrix(spark, d), 3)


@query("WITH RECURSIVE a AS (SELECT DISTINCT n_nationkey AS r, n_regionkey AS c, CAST(n_nationkey + 1 AS BIGINT) AS v FROM nation WHERE n_nationkey > n_regionkey), s AS (SELECT x AS r, x AS c, CAST(0 AS BIGINT) AS v FROM (SELECT r AS x FROM a UNION SELECT c FROM a) UNION ALL SELECT a.r, s.c, a.v + s.v FROM s JOIN a ON a.c = s.r) SELECT r, c, max(v) AS v FROM s GROUP BY 1, 2")
def maxplus_star(spark, d):
    a = table(spark, d, "nation").where("n_nationkey > n_regionkey").select(F.col("n_nationkey").alias("r"), F.col("n_regionkey").alias("c"), (F.col("n_nationkey") + 1).cast("long").alias("v")).distinct()
    return graph.mp_star(a)


@query("WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(l_quantity AS BIGINT)) AS t FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, p // nullif(gcd(p, s), 0) AS production, s // nullif(gcd(p, s), 0) AS consumption, t // nullif(gcd(p, s), 0) AS tokens FROM c")
def normalise_channels(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array(F.min("l_partkey")).alias("production"), F.array(F.min("l_suppkey")).alias("consumption"), F.min(F.col("l_quantity").cast("long")).alias("tokens"))
    return graph.normalise(c).select("l_orderkey", "l_linenumber", F.get("production", F.lit(0)).alias("production"), F.get("consumption", F.lit(0)).alias("consumption"), "tokens")


@query("SELECT l_orderkey, l_linenumber, floor((CAST(l_partkey % 7 + 1 AS BIGINT) * k - 1 - l_suppkey % 5) / (l_orderkey % 4 + 1)) + 1 AS pred FROM lineitem, (SELECT 5 AS k)".replace("floor(", "CAST(floor(").replace(") + 1 AS pred", ") AS BIGINT) + 1 AS pred"))
def predecessor_firing(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.predecessor(F.col("l_suppkey") % 5, F.array((F.col("l_orderkey") % 4 + 1).cast("long")), F.array((F.col("l_partkey") % 7 + 1).cast("long")), F.lit(5)).alias("pred"))


# features and policies ----------------------------------------------------------------------------------------------


@query(fixtures.golden_sql("file, idx, expected, found", [("test09", 15, 0, 3)]))
def feature_vector_check(spark, d):
    rows = spark.createDataFrame(fixtures.HEADERS, "file string, feat array<int>, test array<int>")
    return features.mismatches(rows)


@query("{EV} SELECT coalesce(lag(type) OVER (PARTITION BY task ORDER BY seq), 'start') AS prev_state, cents % 5 AS rule, type AS state FROM e")
def transition_moves(spark, d):
    s = events(spark, d).withColumn("rule", F.col("cents") % 5).withColumn("start", F.lit("start"))
    return features.transitions(s, "task", "seq", "type", "rule", "start")


@query(fixtures.golden_sql("state, action, next_state", [(s, a, s + 1) for s, a in enumerate(fixtures.GREEDY)]))
def greedy_policy(spark, d):
    t = fixtures.transition_table(spark)
    return features.greedy(t, features.value_iteration(t, [22]), [22])


@query(fixtures.golden_sql("rule, candidates, lines", [("inlining", 2, 1), ("roll_up", 1, 1)]))
def change_coverage(spark, d):
    from tracewright.sources.texts import change_coverage as coverage
    from tracewright.sources.texts import changes

    return coverage(changes(spark.createDataFrame([(fixtures.CHANGES,)], "value string")))


@query(fixtures.golden_sql("phase, representative, seen, traced", [(0, 0, 1, True), (1, 0, 2, False), (2, 1, 1, True), (3, 0, 3, False), (4, 1, 2, False)]))
def period_representatives(spark, d):
    rows = spark.createDataFrame([(0, [10.0, 1.0]), (1, [10.2, 1.0]), (2, [1.0, 9.0]), (3, [10.0, 1.1]), (4, [1.0, 9.1])], "phase long, vector array<double>")
    return signals.representatives(rows)


def _register() -> None:
    from tracewright.plans import large, more, tables  # noqa: F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in every().items() if n not in _golden()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in every_sql().items() if n not in _golden()}


def _golden() -> set[str]:
    from tracewright.plans.tables import GOLDEN

    return GOLDEN


def every() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Also the queries over small fixtures, which only the unit tests run."""
    _register()
    return dict(QUERIES)


def every_sql() -> dict[str, str]:
    _register()
    return dict(SQL)
