"""Registered queries over one thread, one key or one graph that holds all rows of a table, and over trace files as a data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import graph, large_graphs
from tracewright.operators import trace as T
from tracewright.plans.queries import events, is_, query, table
from tracewright.session import scratch
from tracewright.sources.datasource import read_records, register, write_records

# trace files as a data source -----------------------------------------------------------------------------------------

FILES = "{EV}, r AS (SELECT 'T.' || lpad(CAST(task % 50 AS VARCHAR), 6, '0') || '000000.mpit' AS file, CAST(task % 50 + 1 AS INT) AS task, time, CAST(length(type) AS INT) AS type, cents AS value, seq AS param, row_number() OVER (PARTITION BY task % 50 ORDER BY time, seq) - 1 AS seq FROM e)"


def _trace_files(spark, d) -> str:
    e = events(spark, d)
    path = scratch(spark, "traces")
    rows = e.select(F.format_string("T.%06d000000.mpit", F.col("task") % 50).alias("file"), F.struct("time", "seq").alias("seq"), "time", F.length("type").alias("type"), F.col("cents").cast("decimal(20)").alias("value"), F.col("seq").cast("decimal(20)").alias("param"))
    write_records(rows, path)
    return path


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("file", "task", "seq", "time", "type", F.col("value").cast("long").alias("value"), F.col("param").cast("long").alias("param"))


@query(FILES + " SELECT file, task, seq, time, type, value, param FROM r WHERE task IN (3, 7, 20, 44) AND time >= 1704900000000000 AND time < 1706000000000000 AND type <> 6")
def trace_source(spark, d):
    """Events written as tracer files and read by format("trace"): the tasks choose files, the times are searched for in each."""
    rows = read_records(spark, _trace_files(spark, d), ordered="true")
    return _plain(rows.where("task in (3, 7, 20, 44) and time >= 1704900000000000 and time < 1706000000000000 and type <> 6"))


@query(FILES + " SELECT task, type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM r GROUP BY ALL")
def trace_source_totals(spark, d):
    """Three columns of all files; a file is read by as many tasks as it has ranges."""
    rows = read_records(spark, _trace_files(spark, d), "task int, type int, value decimal(20)", rangeBytes="65536")
    return rows.groupBy("task", "type").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@query(FILES + " SELECT file, task, seq, time, type, value, param FROM r")
def trace_source_stream(spark, d):
    """The files as a stream, written as a stream of tracer files and read again."""
    register(spark)
    first, second = _trace_files(spark, d), scratch(spark, "traces")
    stream = spark.readStream.format("trace").option("rangeBytes", str(1 << 30)).load(first)
    stream.writeStream.format("trace").option("path", second).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return _plain(read_records(spark, second))


# one thread -----------------------------------------------------------------------------------------------------------


@query("{EV}, a AS (SELECT time, seq, count(*) FILTER (type = 'error') OVER w AS part, CASE WHEN type IN ('click', 'view') THEN 1 WHEN type = 'purchase' THEN -1 ELSE 0 END AS d FROM e WHERE type <> 'signup' WINDOW w AS (ORDER BY time, seq ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, sum(d) OVER w AS s FROM a WINDOW w AS (PARTITION BY part ORDER BY time, seq ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY part ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) AS depth FROM b), x AS (SELECT time, seq, CASE WHEN depth = 0 THEN 2 ELSE 3 END AS state FROM c), y AS (SELECT *, lag(state) OVER (ORDER BY time, seq) AS prev FROM x), z AS (SELECT time AS t0, coalesce(lead(time) OVER (ORDER BY time, seq), 2000000000000000) AS t1, state FROM y WHERE prev IS DISTINCT FROM state) SELECT t0, t1, CAST(state AS INT) AS state FROM z WHERE t0 < t1 AND state <> 2")
def state_stack_one_thread(spark, d):
    """All events are one thread's, whose ranges are reduced and replayed by many tasks."""
    e = events(spark, d).where(~is_("signup"))
    action = F.when(is_("error"), "reset").when(is_("purchase"), "pop").otherwise("push")
    acts = e.select(F.lit(0).alias("thread"), "time", "seq", action.alias("action"), F.when(is_("error"), 2).otherwise(3).alias("state"))
    return T.state_intervals(acts, ["thread"], end_time=2_000_000_000_000_000, drop=(0, 2)).select("t0", "t1", "state")


@query("{EV}, f AS (SELECT time, seq, cents % 3 AS v, sum(CASE WHEN cents % 3 > 0 THEN 1 ELSE -1 END) OVER (ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS s FROM e), g AS (SELECT *, s - least(0, min(s) OVER (ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) AS depth FROM f) SELECT seq, CASE WHEN depth = 0 THEN 0 ELSE last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY depth ORDER BY time, seq ROWS UNBOUNDED PRECEDING) END AS top FROM g")
def stacked_one_thread(spark, d):
    """The same for a stack of values."""
    e = events(spark, d).select(F.lit(0).alias("thread"), F.lit(1).alias("type"), "time", "seq", (F.col("cents") % 3).alias("value"))
    return T.stacked_types(e, ["thread"]).select("seq", "top")


# one key --------------------------------------------------------------------------------------------------------------

ONE_KEY = "{EV}, s AS (SELECT seq, row_number() OVER (ORDER BY time, seq) AS k FROM e WHERE type = 'click'), r AS (SELECT seq, row_number() OVER (ORDER BY time, seq) AS k FROM e WHERE type = 'purchase') SELECT s.seq AS send_seq, r.seq AS recv_seq FROM s JOIN r USING (k)"
ONE_KEY_TAGS = "{EV}, s AS (SELECT seq, task % 5 AS tag, row_number() OVER (PARTITION BY task % 5 ORDER BY time, seq) AS k FROM e WHERE type = 'click'), r AS (SELECT seq, task % 5 AS tag, row_number() OVER (PARTITION BY task % 5 ORDER BY time, seq) AS k FROM e WHERE type = 'purchase') SELECT s.seq AS send_seq, r.seq AS recv_seq FROM s JOIN r USING (tag, k)"


def _one_key(spark, d, send_tag, recv_tag) -> DataFrame:
    e = events(spark, d).where(is_("click") | is_("purchase"))
    ends = e.select(F.lit(0).alias("pair"), "time", "seq", F.when(is_("click"), "send").otherwise("recv").alias("kind"), F.when(is_("click"), send_tag).otherwise(recv_tag).cast("int").alias("tag"))
    return T.match_wildcard(ends, ["pair"]).select("send_seq", "recv_seq")


@query(ONE_KEY)
def message_one_key_any_tag(spark, d):
    """All messages between one pair of tasks, received with any tag."""
    return _one_key(spark, d, F.col("task") % 5, F.lit(T.ANY_TAG))


@query(ONE_KEY_TAGS)
def message_one_key_tags(spark, d):
    """The same, each received by its tag."""
    return _one_key(spark, d, F.col("task") % 5, F.col("task") % 5)


@query(ONE_KEY)
def message_one_key_both(spark, d):
    """Receives by tag and of any tag mixed, of sends of one tag, so that SQL can tell the matches too."""
    return _one_key(spark, d, F.lit(7), F.when(F.col("seq") % 3 == 0, T.ANY_TAG).otherwise(7))


# one graph ------------------------------------------------------------------------------------------------------------

#: The lines of an order are a ring; the first line of order k is also reached from that of order k div 16: all of lineitem is one graph.
RINGS = "o AS (SELECT l_orderkey AS k, l_orderkey * 8 + l_linenumber AS node, l_linenumber AS line, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY l_orderkey, l_linenumber), n AS (SELECT k, node AS src, coalesce(lead(node) OVER (PARTITION BY k ORDER BY node), min(node) OVER (PARTITION BY k)) AS dst, weight, 1 + line % 2 AS tokens FROM o), f AS (SELECT k, min(node) AS node FROM o GROUP BY k)"


def _rings(spark, d) -> tuple[DataFrame, DataFrame]:
    """(src, dst, weight, tokens) of the rings, and of the edges between orders."""
    o = table(spark, d, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    o = o.withColumn("node", F.col("k") * 8 + F.col("line"))
    w = Window.partitionBy("k")
    ring = o.select(F.col("node").alias("src"), F.coalesce(F.lead("node").over(w.orderBy("node")), F.min("node").over(w)).alias("dst"), "weight", (1 + F.col("line") % 2).cast("long").alias("tokens"))
    first = o.groupBy("k").agg(F.min("node").alias("dst"))
    above = first.select(F.col("k").alias("up"), F.col("dst").alias("src"))
    return ring, first.where("k > 0").withColumn("up", F.expr("k div 16")).join(above, "up").select("src", "dst", F.lit(0).cast("long").alias("weight"), F.lit(1).cast("long").alias("tokens"))


@query("WITH RECURSIVE " + RINGS + ", up AS (SELECT k, k AS a FROM f UNION ALL SELECT up.k, up.a // 16 FROM up JOIN f ON f.k = up.a // 16 WHERE up.a > 0), r AS (SELECT k, sum(weight) AS w, sum(tokens) AS t FROM n GROUP BY k), b AS (SELECT up.a AS k, arg_max(r.w // gcd(r.w, r.t), r.w / r.t) AS num, arg_max(r.t // gcd(r.w, r.t), r.w / r.t) AS den FROM up JOIN r ON r.k = up.k GROUP BY up.a) SELECT o.node, CAST(b.num AS BIGINT) AS num, CAST(b.den AS BIGINT) AS den FROM o JOIN b ON b.k = o.k")
def cycle_ratios_one_graph(spark, d):
    """The largest cycle ratio that each line of the graph can reach."""
    ring, between = _rings(spark, d)
    return large_graphs.reachable_ratio(ring.union(between))


@query("WITH " + RINGS + " SELECT o.node, f.node AS component FROM o JOIN f USING (k)")
def strong_components_one_graph(spark, d):
    """G3."""
    ring, between = _rings(spark, d)
    return graph.strong_components(ring.union(between).select("src", "dst"))


@query("WITH " + RINGS + " SELECT src, dst FROM n")
def cycle_edges_one_graph(spark, d):
    """the edges that lie on cycles."""
    ring, between = _rings(spark, d)
    return graph.inside_components(ring.union(between).select("src", "dst"))


@query("WITH a AS (SELECT DISTINCT 'p' || l_partkey AS actor, l_partkey % 12 + 1 AS q FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, l_suppkey % 10 + 1 FROM lineitem), w AS (SELECT list_reduce(list(q), lambda x, y: gcd(x, y)) AS g, min(actor) AS component FROM a) SELECT actor, component, true AS consistent, CAST(q // g AS BIGINT) AS q FROM a, w")
def repetition_one_graph(spark, d):
    """Parts and suppliers as actors, each line of an order a channel; the graph is connected in all given tables."""
    p, s = F.col("l_partkey") % 12 + 1, F.col("l_suppkey") % 10 + 1
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), s.alias("production"), p.alias("consumption"))
    return large_graphs.repetition_of_one(lines).withColumn("q", F.col("q").cast("long"))


@query("WITH p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1) SELECT 1 AS length, CAST(src AS VARCHAR) AS nodes FROM e WHERE src = dst UNION ALL SELECT 2, a.src || ',' || a.dst FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT 3, a.src || ',' || a.dst || ',' || b.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def short_cycles_one_graph(spark, d):
    """Cycles of three parts at most, of the graph of parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return large_graphs.short_cycles(e, 3).select("length", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


# streams with state -----------------------------------------------------------------------------------------------------


def _in_turns(spark, d, make, order) -> DataFrame:
    """What a stream of the events, four files in this order, has appended; it is stopped half way and started again from its checkpoint."""
    given = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, path, progress = scratch(spark, "source"), scratch(spark, "stream"), scratch(spark, "progress")
    edges = given.select(order.cast("double").alias("o")).stat.approxQuantile("o", [0.25, 0.5, 0.75], 0.001)  # files need not be equal; 0 would hold all values in the driver
    bounds = [(order > a) & (order <= b) for a, b in zip([float("-inf"), *edges], [*edges, float("inf")], strict=True)]
    for half in (bounds[:2], bounds[2:]):
        for b in half:
            given.where(b).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(given.schema).option("maxFilesPerTrigger", "1").parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


def _flushed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("task"), F.col("event_id").alias("time"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("flush"))


@query("WITH r AS (SELECT user_id AS task, event_id AS seq, event_type = 'error' AS flush, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY task, part ORDER BY seq DESC) AS back FROM r WHERE NOT flush), k AS (SELECT *, row_number() OVER (PARTITION BY task, part ORDER BY back DESC) - 1 AS place FROM n WHERE back <= 5) SELECT k.task, f.seq AS flush_seq, k.place, k.seq FROM k JOIN r f ON f.task = k.task AND f.part = k.part AND f.flush")
def streamed_ring(spark, d):
    """The five newest events of each task at each of its errors, from a stream that is stopped and started again."""
    from tracewright.streaming import state

    return _in_turns(spark, d, lambda rows: state.stream_ring(_flushed(rows), "task", 5), F.col("event_id"))


@query("WITH m AS (SELECT max(epoch_us(ts)) AS last FROM events), g AS (SELECT user_id AS task, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY task ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT task, min(t) AS began, max(t) + 21600000000 AS ended, count(*) AS n FROM s GROUP BY task, run HAVING max(t) + 21600000000 <= (SELECT last - 86400001000 FROM m)")
def streamed_sessions(spark, d):
    """Each task's sessions with gaps of under six hours, from a stream with events up to 16 hours late; those that a day before its end were over."""
    from tracewright.streaming import state

    closed = table(spark, d, "events").agg(F.unix_micros(F.max("ts").cast("timestamp")) - 86_400_000_000).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 5 * 14_400_000_000
    stream = _in_turns(spark, d, lambda rows: state.sessions(rows.withColumnRenamed("user_id", "task"), ["task"], "6 hours", "1 day"), late)
    return stream.where(F.col("ended") <= closed - 1000)


# one signal -----------------------------------------------------------------------------------------------------------


@query("{EV}, x AS (SELECT row_number() OVER (ORDER BY time, seq) AS i, CASE WHEN seq % 24 < 5 THEN 100.0 ELSE 0.0 END + cents % 50 AS v FROM e), m AS (SELECT avg(v) AS m, count(*) AS n FROM x), y AS (SELECT i, v - m AS y FROM x, m), r AS (SELECT k, coalesce((SELECT sum(a.y * b.y) FROM y a JOIN y b ON b.i = a.i + k), 0) / (any_value(n) - k) AS r FROM range(61) t(k), m GROUP BY k), q AS (SELECT k, r / first_value(r) OVER (ORDER BY k) AS r, lag(r) OVER (ORDER BY k) / first_value(r) OVER (ORDER BY k) AS p, lead(r) OVER (ORDER BY k) / first_value(r) OVER (ORDER BY k) AS f FROM r), z AS (SELECT k, r FROM q WHERE k BETWEEN 2 AND 59 AND r >= p AND r > f), b AS (SELECT min(k) AS period FROM z WHERE r >= 0.9 * (SELECT max(r) FROM z)) SELECT 0 AS app, b.period, round(z.r, 6) AS goodness, m.n // b.period AS iterations FROM b JOIN z ON z.k = b.period, m")
def long_period_one_signal(spark, d):
    """T4: the period of all events as one signal, correlated in blocks."""
    from tracewright.streaming import signals

    e = events(spark, d)
    s = e.select(F.lit(0).alias("app"), F.struct("time", "seq").alias("time"), (F.when(F.col("seq") % 24 < 5, 100.0).otherwise(0.0) + F.col("cents") % 50).alias("value"))
    return signals.long_periods(s, "app", 60, 512).withColumn("goodness", F.round("goodness", 6))


# one application ------------------------------------------------------------------------------------------------------


@query("WITH x AS (SELECT event_id AS phase, user_id % 7 AS k FROM events), r AS (SELECT k, row_number() OVER (ORDER BY min(phase)) - 1 AS representative FROM x GROUP BY k), s AS (SELECT phase, representative, row_number() OVER (PARTITION BY k ORDER BY phase) AS seen FROM x JOIN r USING (k)) SELECT phase, representative, seen, coalesce(seen = 3 AND phase IN (SELECT phase FROM s WHERE seen = 3 ORDER BY phase LIMIT 4), false) AS traced FROM s")
def representatives_one_app(spark, d):
    """All events as the phases of one application, of seven kinds that lie apart by a factor of two."""
    from tracewright.streaming import signals

    size = F.pow(F.lit(2.0), F.col("user_id") % 7) * 100 * (1 + F.col("event_id") % 3 / 100)
    phases = table(spark, d, "events").select(F.col("event_id").alias("phase"), F.array(size, size / 2).alias("vector"))
    return signals.representatives_in_rounds(phases, min_seen=2, max_traced=4)
