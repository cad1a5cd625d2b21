"""Registered queries of sources, sinks, functions and graph analyses over inputs made from the tables.

Sinks write to the shared folder and sources read it back. Graph analyses get a small graph for each row of `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.functions import sdf
from tracewright.operators import code as ccode
from tracewright.operators import features, graph, rules, scopes
from tracewright.operators import trace as T
from tracewright.plans import fixtures
from tracewright.plans.queries import events, is_, query, table
from tracewright.session import checkpointed, scratch
from tracewright.sources import graphs, texts, traces
from tracewright.streaming import signals


def text_of(*parts):
    """Columns and literals in a row, as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(x: str):
    return F.array_join(F.col(x).cast("array<string>"), ",")


# graph files --------------------------------------------------------------------------------------------------------

GRAPH_SQL = "SELECT 'g' || p_size % 7 AS graph_id, 's' || p_size AS src, 'd' || p_partkey AS dst, (p_size % 4 + 1) || ',' || (p_partkey % 3 + 1) AS production, CAST(p_size % 5 + 1 AS VARCHAR) AS consumption, p_partkey % 6 AS tokens, CAST(p_size AS VARCHAR) AS wcet FROM part"


def _file_graphs(spark, d):
    p = table(spark, d, "part")
    own = p.select(text_of("g", F.col("p_size") % 7).alias("graph_id"), text_of("s", F.col("p_size")).alias("src"), text_of("d", F.col("p_partkey")).alias("dst"), F.array((F.col("p_size") % 4 + 1).cast("long"), F.col("p_partkey") % 3 + 1).alias("production"), F.array((F.col("p_size") % 5 + 1).cast("long")).alias("consumption"), (F.col("p_partkey") % 6).alias("tokens"), F.col("p_size").cast("long").alias("w"))
    actors = own.select("graph_id", F.col("src").alias("actor"), F.array("w").alias("wcet")).union(own.select("graph_id", "dst", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).distinct()
    return actors, own.drop("w")


def _read_back(actors: DataFrame, channels: DataFrame) -> DataFrame:
    times = actors.select("graph_id", F.col("actor").alias("src"), "wcet")
    return channels.join(times, ["graph_id", "src"]).select("graph_id", "src", "dst", joined("production").alias("production"), joined("consumption").alias("consumption"), "tokens", joined("wcet").alias("wcet"))


@query(GRAPH_SQL)
def graph_json_files(spark, d):
    """Graphs written as JSON files and read again."""
    path = scratch(spark, "graphs")
    graphs.write_texts(graphs.to_json(*_file_graphs(spark, d)), path)
    return _read_back(*graphs.read_json(spark, path))


@query(GRAPH_SQL)
def graph_xml_files(spark, d):
    """The same as XML."""
    path = scratch(spark, "graphs")
    graphs.write_texts(graphs.to_xml(*_file_graphs(spark, d)), path)
    return _read_back(*graphs.read_xml(spark, path))


@query("SELECT DISTINCT 'g' || p_size % 7 AS graph_id, 0 AS part, 's' || p_size || ' ' || p_size AS value FROM part UNION ALL SELECT 'g' || p_size % 7, 0, 'd' || p_partkey || ' 1' FROM part UNION ALL SELECT 'g' || p_size % 7, 1, 's' || p_size || ' d' || p_partkey || ' ' || (p_size % 4 + 1) || ' ' || (p_size % 5 + 1) || ' ' || (p_partkey % 6) FROM part")
def graph_text_lines(spark, d):
    """S4."""
    return graphs.to_text(*_file_graphs(spark, d))


@query("SELECT 0 AS ord, 'p sp ' || (SELECT max(c_custkey) + 1 FROM customer) || ' ' || (SELECT count(*) FROM customer) AS value UNION ALL SELECT 1, 'a ' || c_nationkey || ' ' || c_custkey || ' ' || CAST(floor(c_acctbal) AS BIGINT) FROM customer")
def graph_arc_lines(spark, d):
    """S6."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"), F.floor("c_acctbal").cast("long").alias("weight"))
    size = c.agg(F.max("dst") + 1, F.count("*")).first()
    return graphs.to_dimacs(c, size[0], size[1])


@query("""SELECT 0 AS part, 'node [ id ' || n_nationkey || ' label "' || n_name || '" graphics [ type "' || CASE n_regionkey WHEN 0 THEN 'ellipse' WHEN 1 THEN 'diamond' ELSE 'rectangle' END || '" ] ]' AS value FROM nation UNION ALL SELECT 1, 'edge [ source ' || s_nationkey || ' target ' || s_suppkey || ' ]' FROM supplier UNION ALL SELECT 2, '"' || s_nationkey || '" -> "' || s_suppkey || '";' FROM supplier""")
def graph_drawings(spark, d):
    """GML with a shape for each type, and DOT."""
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.when(F.col("n_regionkey") == 0, "actor").when(F.col("n_regionkey") == 1, "memory").otherwise("scope").alias("type"))
    edges = table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    return graphs.to_gml(nodes, edges).union(graphs.to_dot(edges).select(F.lit(2), "value"))


# trace files --------------------------------------------------------------------------------------------------------


@query("SELECT 'f' || user_id % 5 AS file, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS seq, epoch_us(ts) AS time, CAST(length(event_type) AS INT) AS type, CAST(round(value * 100) AS BIGINT) AS value, event_id AS param FROM events")
def binary_records(spark, d):
    """Events as the tracer's records, read again."""
    e = events(spark, d).select(text_of("f", F.col("task") % 5).alias("file"), "seq", "time", F.length("type").alias("type"), F.col("cents").alias("value"), F.col("seq").alias("param"))
    back = traces.decode_binary(traces.encode_binary(e))
    return back.select("file", "seq", "time", "type", F.col("value").cast("long").alias("value"), F.col("param").cast("long").alias("param"))


def _lines(spark, name: str, lines: DataFrame) -> str:
    path = scratch(spark, name)
    lines.write.text(path)
    return path


@query("SELECT 'set-0/T@h.' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || lpad(CAST(c_custkey % 97 AS VARCHAR), 6, '0') || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || '.mpit' AS file, 'node' || c_nationkey AS node, 1 AS ptask, CAST(c_custkey % 97 + 1 AS INT) AS task, c_nationkey + 1 AS thread FROM customer")
def manifest_files(spark, d):
    """S8."""
    c = table(spark, d, "customer")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    name = F.concat(F.lit("set-0/T@h."), pad(F.col("c_custkey"), 10), pad(F.col("c_custkey") % 97, 6), pad(F.col("c_nationkey"), 6), F.lit(".mpit"))
    lines = c.select(text_of(name, " on node", F.col("c_nationkey"), " named X.", pad(F.col("c_custkey") % 97, 6), pad(F.col("c_nationkey"), 6), ".mpit").alias("value"))
    return traces.read_manifest(spark, _lines(spark, "manifest", lines))


@query("SELECT CAST(c_nationkey AS INT) AS app, CAST(c_custkey AS INT) AS task, CAST(c_custkey % 11 AS INT) AS comm, CAST(c_custkey % 5 AS INT) AS target_app FROM customer")
def spawn_files(spark, d):
    """S9."""
    c = table(spark, d, "customer")
    lines = c.select(text_of(" ", F.col("c_nationkey"), " ", F.col("c_custkey"), ":", F.col("c_custkey") % 11, " ", F.col("c_custkey") % 5).alias("value"))
    return traces.read_spawns(spark, _lines(spark, "spawns", lines.union(spark.createDataFrame([("# a remark",)], "value string"))))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'U' ELSE 'P' END AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS text FROM part")
def symbol_files(spark, d):
    """S10."""
    p = table(spark, d, "part")
    lines = p.select(text_of(F.when(F.col("p_size") % 2 == 0, "U").otherwise("P"), " ", F.col("p_partkey"), ' "', F.col("p_name"), '"').alias("value"))
    return traces.read_symbols(spark, _lines(spark, "symbols", lines))


@query("{EV} SELECT time, seq, CASE WHEN type = 'click' THEN 'trace' WHEN type = 'view' THEN 'sample' ELSE 'online' END AS buffer, CASE WHEN type = 'view' THEN cents END AS cents FROM e")
def buffer_union(spark, d):
    """Three buffers of different columns as one."""
    e = events(spark, d)
    of = lambda which, name: e.where(which).select("time", "seq", F.lit(name).alias("buffer"))
    samples = e.where(is_("view")).select("time", "seq", F.lit("sample").alias("buffer"), "cents")
    return traces.union_buffers(of(is_("click"), "trace"), samples, of(~F.col("type").isin("click", "view"), "online")).select("time", "seq", "buffer", "cents")


RECORDS = """{EV}, r AS (SELECT CASE type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS t, * FROM e)
SELECT CASE t WHEN 1 THEN '1:1:2:' || task || ':1:' || time || ':' || (time + 5) || ':' || cents WHEN 2 THEN '2:1:2:' || task || ':1:' || time || ':' || seq || ':' || cents || ':7:8'
ELSE '3:1:2:' || task || ':1:' || time || ':' || (time + 5) || ':9:1:' || (task + 1) || ':1:' || (time + 6) || ':' || (time + 7) || ':' || seq || ':' || cents END AS value FROM r"""


def _records(spark, d):
    pair = lambda t, v: F.struct(t.cast("long").alias("type"), v.cast("long").alias("value"))
    e = events(spark, d)
    return e.select(F.when(is_("click"), 1).when(is_("view"), 2).otherwise(3).alias("rtype"), F.lit(1).alias("cpu"), F.lit(2).alias("ptask"), "task", F.lit(1).alias("thread"), "time", (F.col("time") + 5).alias("end_time"), F.col("cents").alias("value"), F.col("seq").alias("event"), F.lit(9).alias("cpu_r"), F.lit(1).alias("ptask_r"), (F.col("task") + 1).alias("task_r"), F.lit(1).alias("thread_r"), (F.col("time") + 6).alias("log_r"), (F.col("time") + 7).alias("phy_r"), F.array(pair(F.col("seq"), F.col("cents")), pair(F.lit(7), F.lit(8))).alias("pairs"))


@query(RECORDS)
def trace_files(spark, d):
    """States, events and messages written as a trace in O2's order, and read again."""
    path = scratch(spark, "trace")
    traces.write_trace(_records(spark, d), path)
    return spark.read.text(path)


@query("{EV}, r AS (SELECT *, CASE type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS rtype FROM e) SELECT row_number() OVER (ORDER BY time, rtype DESC, task, seq) AS rank, rtype, seq FROM r")
def trace_record_ranks(spark, d):
    """S12, O2."""
    r = _records(spark, d).select("time", "rtype", F.col("task").alias("file_idx"), F.col("event").alias("seq"))
    return T.record_order(r).select("rank", "rtype", "seq")


@query("SELECT DISTINCT user_id % 40 AS type, coalesce((SELECT n_name FROM nation WHERE n_nationkey = user_id % 40), 'Unknown type ' || user_id % 40) AS label FROM events")
def used_labels(spark, d):
    """S13."""
    r = events(spark, d).select(F.lit(2).alias("rtype"), F.array(F.struct((F.col("task") % 40).alias("type"), F.col("cents").alias("value"))).alias("pairs"))
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("type"), F.col("n_name").alias("label"))
    return traces.labels_used(r, labels)


@query("SELECT user_id % 6 AS file_idx, event_id AS seq, row_number() OVER (ORDER BY user_id % 6, event_id) AS place, CASE event_type WHEN 'click' THEN '1:' || user_id || ':1:' || printf('%.9f', CAST(round(value * 100) AS BIGINT) / 1e9) WHEN 'view' THEN '2:' || user_id || ':1:' || (user_id + 1) || ':64:' || (event_id % 9) || ':0' WHEN 'error' THEN '3:' || user_id || ':1:' || (user_id + 1) || ':64:' || (event_id % 9) || ':0' WHEN 'signup' THEN '10:' || user_id || ':1:4:0:64' ELSE '20:' || user_id || ':1:4:' || CAST(round(value * 100) AS BIGINT) END AS value FROM events")
def simulator_trace(spark, d):
    """Bursts, messages, collective calls and point events, file by file."""
    kind = F.when(is_("click"), "burst").when(is_("view"), "send").when(is_("error"), "recv").when(is_("signup"), "global").otherwise("point")
    e = events(spark, d).select((F.col("task") % 6).alias("file_idx"), "seq", kind.alias("kind"), "task", F.lit(1).alias("thread"), F.col("cents").alias("dur"), (F.col("task") + 1).alias("partner"), F.lit(64).alias("size"), (F.col("seq") % 9).alias("tag"), F.lit(0).alias("comm"), F.lit(4).alias("type"), F.col("cents").alias("value"))
    return traces.simulator_order(traces.simulator_lines(e))


@query("WITH v AS (SELECT *, CAST(floor(value / 10) AS BIGINT) AS v FROM events) SELECT DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'page' ELSE 'large' END AS family, CAST(length(event_type) AS INT) AS type, v AS value, CASE WHEN v % 2 = 0 THEN 'even' ELSE CAST(v AS VARCHAR) END AS label FROM v WHERE event_type IN ('click', 'view') OR value >= 50")
def event_labels(spark, d):
    """The values that occur in each family of events, with their labels."""
    e = table(spark, d, "events").select("event_type", F.length("event_type").alias("type"), F.floor(F.col("value") / 10).cast("long").alias("v"), F.col("value").alias("amount"))
    e = e.withColumn("label", F.when(F.col("v") % 2 == 0, "even")).withColumnRenamed("v", "value")
    return T.label_dictionaries(e, {"page": F.col("event_type").isin("click", "view"), "large": F.col("amount") >= 50}, "label")


# listings, scopes, headers ------------------------------------------------------------------------------------------


def _files(spark, name: str, rows: DataFrame) -> str:
    path = scratch(spark, name)
    texts.write_files(rows, path)
    return path


@query("SELECT 'f' || p_size % 5 AS file, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS ln, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INT) END AS marker, p_partkey % 3 = 1 AS is_instruction FROM part")
def listing_files(spark, d):
    """Listings with source markers, instructions and other lines."""
    p = table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, text_of(" ", F.col("p_size"), ":main.c **** x")).when(F.col("p_partkey") % 3 == 1, text_of("  ", F.col("p_partkey"), " ", F.lpad(F.lower(F.hex("p_partkey")), 4, "0"), " mov r0")).otherwise(text_of(".label ", F.col("p_name")))
    own = p.groupBy(text_of("f", F.col("p_size") % 5).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    return texts.listing(texts.numbered_lines(spark, _files(spark, "listings", own)).where("trim(line) <> ''"))


@query("WITH p AS (SELECT 'f' || p_size % 5 AS file, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1 AS i FROM part) SELECT file, CAST(2 * i AS INT) AS scope_id, CAST(3 * i + 2 AS INT) AS lstart, CAST(3 * i + 2 AS INT) AS lend FROM p UNION ALL SELECT file, CAST(2 * i + 1 AS INT), CAST(3 * i + 1 AS INT), CAST(3 * i + 3 AS INT) FROM p")
def brace_files(spark, d):
    """Each part is a scope of three lines with one in it."""
    p = table(spark, d, "part")
    own = p.groupBy(text_of("f", F.col("p_size") % 5).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("void f"), k.cast("string"), F.lit("() {\nif (x) { y; }\n}"))), "\n").alias("value"))
    return texts.read_scopes(spark, _files(spark, "braces", own))


@query("""WITH c AS (SELECT p_size, p_partkey, p_partkey % 5 AS w FROM part), k AS (SELECT p_size, string_agg('{"name":"p' || p_partkey || '","weight":' || w || ',"lstart":' || (p_size * 100000 + p_partkey) || ',"lend":' || (p_size * 100000 + p_partkey) || ',"scopes":[]}', ',' ORDER BY p_partkey) AS below FROM c GROUP BY 1)
SELECT 'f' || p_size % 3 AS file, '[' || string_agg('{"name":"s' || p_size || '","weight":0,"lstart":' || (p_size * 100000) || ',"lend":' || (p_size * 100000 + 99999) || ',"scopes":[' || below || ']}', ',' ORDER BY p_size) || ']' AS value FROM k GROUP BY 1""")
def scope_tree_texts(spark, d):
    """The scopes of each size hold those of its parts."""
    p = table(spark, d, "part").withColumn("file", text_of("f", F.col("p_size") % 3))
    base = F.col("p_size") * 100000
    top = p.select("file", (-F.col("p_size")).cast("long").alias("scope_id"), F.lit(None).cast("long").alias("parent_id"), text_of("s", F.col("p_size")).alias("name"), F.lit(0).cast("long").alias("weight"), base.cast("long").alias("lstart"), (base + 99999).cast("long").alias("lend")).distinct()
    own = p.select("file", F.col("p_partkey").alias("scope_id"), (-F.col("p_size")).cast("long").alias("parent_id"), text_of("p", F.col("p_partkey")).alias("name"), (F.col("p_partkey") % 5).alias("weight"), (base + F.col("p_partkey")).alias("lstart"), (base + F.col("p_partkey")).alias("lend"))
    return texts.scope_trees(top.union(own))


@query("SELECT 'd' || p_size AS file, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS scope_id, CAST(p_partkey AS INT) AS lstart, CAST(p_partkey + 3 AS INT) AS lend, CASE p_partkey % 2 WHEN 0 THEN 'MAP' ELSE 'ITN' END AS kind, 'f' || p_partkey AS fun, 'a' AS par FROM part")
def annotation_texts(spark, d):
    """Annotation documents, made and parsed as JSON."""
    p = table(spark, d, "part")
    info = F.struct(text_of("f", F.col("p_partkey")).alias("funName"), F.array(F.struct(F.lit("x").alias("varName"), F.lit(0).alias("varPos"))).alias("paramPos"), F.array(F.struct(F.lit("a").alias("parName"), F.lit(0).alias("parPosPragma"))).alias("pragmaPos"))
    pragma = F.struct("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "map").otherwise("itn"), F.lit(" n a")).alias("pragma"), F.col("p_partkey").cast("int").alias("startLine"), (F.col("p_partkey") + 3).cast("int").alias("endLine"), info.alias("funInfo"))
    docs = p.groupBy(text_of("d", F.col("p_size")).alias("file")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(pragma)).alias("pragmas"))).alias("value"))
    found, _ = texts.annotations(docs)
    return found.select("file", "scope_id", "lstart", "lend", "kind", F.col("funName").alias("fun"), F.get("names", F.lit(0))["parName"].alias("par"))


@query("SELECT CASE p_size % 3 WHEN 0 THEN 'inlining' WHEN 1 THEN 'unrolling' ELSE 'roll_up' END AS rule, count(*) AS candidates, count(DISTINCT (p_brand, p_partkey % 50)) AS lines FROM part GROUP BY 1")
def change_lists(spark, d):
    """Lists of candidate changes, made as JSON for each file, parsed, and counted by rule."""
    p = table(spark, d, "part")
    rule = F.element_at(F.array(F.lit("inlining"), F.lit("unrolling"), F.lit("roll_up")), F.col("p_size") % 3 + 1)
    change = F.struct(F.col("p_partkey").cast("int").alias("idChange"), rule.alias("ruleName"), (F.col("p_partkey") % 50).cast("int").alias("line"), F.lit("a").alias("oldCode"), F.lit("b").alias("newCode"), F.lit("c").alias("newCodeAll"))
    docs = p.groupBy("p_brand").agg(F.collect_list(change).alias("changes")).select(F.to_json(F.struct(F.lit("").alias("code"), F.col("p_brand").alias("fileName"), F.lit(".").alias("fileDir"), "changes")).alias("value"))
    return texts.change_coverage(texts.changes(docs))


@query("SELECT 'p' || p_partkey AS file, p_size || ',' || p_partkey % 7 || ',0' AS test, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey % 5 AS INT) END AS label, CASE WHEN p_size % 3 = 0 THEN p_brand END AS rule, 'main' AS func FROM part")
def header_texts(spark, d):
    """S22."""
    p = table(spark, d, "part")
    some = lambda which, *parts: F.when(which, text_of(*parts)).otherwise("")
    text = F.concat(text_of("// TEST_VECTOR: [", F.col("p_size"), ", ", F.col("p_partkey") % 7, ", 0]\n"), some(F.col("p_size") % 2 == 0, "// TEST_LABEL: ", F.col("p_partkey") % 5, "\n"), some(F.col("p_size") % 3 == 0, "// RULE_APPLD: ", F.col("p_brand"), "\n"), F.lit("// FUNC_ANALYZ: main\nint x;"))
    found = texts.feature_headers(p.select(text_of("p", F.col("p_partkey")).alias("file"), text.alias("value")))
    return found.withColumn("test", F.array_join(F.col("test").cast("array<string>"), ","))


@query("WITH s AS (SELECT 'f' || c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS state, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT file, CAST(state AS INT) AS state, CAST(a AS INT) AS action, CAST((c_custkey * 7 + a) % n AS INT) AS next_state FROM s, range(6) t(a)")
def training_tables(spark, d):
    """A training text for each nation, of a state for each of its customers, written and read again."""
    w = Window.partitionBy("file").orderBy("c_custkey")
    own = table(spark, d, "customer").select(text_of("f", F.col("c_nationkey")).alias("file"), "c_custkey")
    s = own.withColumn("state", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("file")))
    moves = s.select("file", "state", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("action"), "c_custkey", "n").select("file", "state", "action", ((F.col("c_custkey") * 7 + F.col("action")) % F.col("n")).cast("int").alias("next_state"))
    rules = s.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("action")).withColumn("name", text_of("rule", F.col("action")))
    texts_ = texts.training_text({"rules": rules, "states": s.select("file", "state", text_of("k", F.col("c_custkey")).alias("key")), "init": s.where("state < 2").select("file", "state"), "final": s.where("state = n - 1").select("file", "state"), "transitions": moves})
    path = scratch(spark, "training")
    texts.write_files(texts_, path)
    return texts.training_table(texts.whole_files(spark, path))["transitions"]


@query("SELECT event_id AS t_ms, round(value, 2) AS v_mem, user_id / 4 AS w_mem, CAST(user_id AS DOUBLE) AS w_gpu FROM events")
def energy_files(spark, d):
    """A sensor log written and read again."""
    e = table(spark, d, "events")
    names = [x.strip().split()[0] for x in texts.ENERGY.split(",")]
    given = {"t_ms": F.col("event_id"), "v_mem": F.round("value", 2), "w_mem": F.col("user_id") / 4, "w_gpu": F.col("user_id").cast("double")}
    path = scratch(spark, "energy")
    texts.write_energy(e.select(*[given.get(n, F.lit(0.0)).alias(n) for n in names]), path)
    return texts.read_energy(spark, path, header=True).select("t_ms", "v_mem", "w_mem", "w_gpu")


@query("SELECT p_partkey AS scope_id, CASE p_size % 7 WHEN 0 THEN 'NONE' WHEN 1 THEN 'MAP' WHEN 2 THEN 'ITN' WHEN 3 THEN 'ZIPWITH' ELSE 'FOLDL' END AS kind FROM part WHERE p_size % 7 < 5")
def visible_scopes(spark, d):
    """F12."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("scope_id"), X.scope_kind((F.col("p_size") % 7).cast("int")).alias("kind"))
    return scopes.visible(s)


# scopes of a heap-shaped tree: scope k lies in scope k div 2 -----------------------------------------------------------

HEAP = "s AS (SELECT CAST(p_partkey + 1 AS BIGINT) AS k, CASE WHEN p_partkey > 0 THEN (p_partkey + 1) // 2 END AS up, p_size AS own, CASE p_partkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'MAP' WHEN 2 THEN 'ITN' WHEN 3 THEN 'MEMALLOC' ELSE 'FOLDL' END AS kind, CASE WHEN p_partkey % 5 = 1 THEN 'n' WHEN p_partkey % 5 = 2 THEN '3' END AS repeat FROM part)"


def _heap(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("NONE", "MAP", "ITN", "MEMALLOC", "FOLDL"))), (k % 5 + 1).cast("int"))
    return p.select(F.lit("f").alias("file"), (k + 1).alias("scope_id"), F.when(k > 0, F.expr("(p_partkey + 1) div 2")).alias("parent_id"), kind.alias("kind"), F.col("p_size").cast("long").alias("own"), F.when(k % 5 == 1, "n").when(k % 5 == 2, "3").alias("repeat"))


@query("WITH RECURSIVE " + HEAP + ", a AS (SELECT k AS above, k AS at, 0 AS names, CAST(1 AS BIGINT) AS c, k AS low FROM s UNION ALL SELECT u.k, u.k, a.names + CASE WHEN u.repeat = 'n' THEN 1 ELSE 0 END, a.c * CASE WHEN u.repeat = '3' THEN 3 ELSE 1 END, a.low FROM a JOIN s l ON l.k = a.at JOIN s u ON u.k = l.up), t AS (SELECT above, CASE WHEN names = 0 THEN '1' ELSE array_to_string(list_transform(range(names), lambda i: 'n'), '*') END AS term, a.c * s.own AS c FROM a JOIN s ON s.k = a.low UNION ALL SELECT above, array_to_string(list_append(list_transform(range(names), lambda i: 'n'), 'os_call'), '*'), a.c FROM a JOIN s ON s.k = a.low WHERE s.kind = 'MEMALLOC') SELECT above AS scope_id, term, CAST(sum(c) AS BIGINT) AS c FROM t GROUP BY 1, 2 HAVING sum(c) <> 0")
def scope_roll_up_tree(spark, d):
    """A3 over a tree of all parts."""
    return scopes.roll_up(_heap(spark, d)).select("scope_id", F.explode("total").alias("term", "c"))


@query("WITH RECURSIVE " + HEAP + ", p AS (SELECT k, up, CASE WHEN own % 4 = 0 THEN own END AS e FROM s), r AS (SELECT k, up AS at, e FROM p UNION ALL SELECT r.k, p.up, p.e FROM r JOIN p ON p.k = r.at WHERE r.e IS NULL) SELECT k AS scope_id, max(e) AS elements FROM r GROUP BY 1")
def memory_counts(spark, d):
    """J17 over a tree of all parts."""
    s = _heap(spark, d)
    params = s.select("file", "scope_id", F.lit("a").alias("var"), F.when(F.col("own") % 4 == 0, F.col("own")).alias("elements"))
    tree = s.where("parent_id is not null").select("file", F.col("parent_id").alias("parent"), F.col("scope_id").alias("child"))
    return scopes.propagate_memory(params, tree).select("scope_id", "elements")


@query("SELECT a.p_brand AS fun, 'v' || a.p_size AS var_name, a.p_partkey AS var_pos, b.p_partkey AS par_pos FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_partkey % 3 = 0")
def parameter_name_links(spark, d):
    """J16."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("fun"), text_of("v", F.col("p_size")).alias("var_name"), F.col("p_partkey").alias("var_pos"))
    b = p.where("var_pos % 3 = 0").select("fun", F.col("var_name").alias("par_name"), F.col("var_pos").alias("par_pos"))
    return scopes.parameter_links(p, b)


# states -------------------------------------------------------------------------------------------------------------

# clicks and views push, purchases pop what is on top, errors pop until the thread's first state; state 3 + (depth - 1) % 4 lies at each depth
NESTED = "{EV}, a AS (SELECT task, time, seq, type, count(*) FILTER (type = 'error') OVER (PARTITION BY task ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS part, CASE WHEN type IN ('click', 'view') THEN 1 WHEN type = 'purchase' THEN -1 ELSE 0 END AS d FROM e WHERE type <> 'signup'), b AS (SELECT *, sum(d) OVER w AS s FROM a WINDOW w AS (PARTITION BY task, part ORDER BY time, seq ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY task, part ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM b)"


def _nested(spark, d):
    """Events with an action and a state for the stack replay."""
    e = events(spark, d).where(~is_("signup"))
    w = Window.partitionBy("task").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("part", F.sum(F.when(is_("error"), 1).otherwise(0)).over(w))
    step = F.when(F.col("type").isin("click", "view"), 1).when(is_("purchase"), -1).otherwise(0)
    own = Window.partitionBy("task", "part").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("s", F.sum(step).over(own)).withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(own)))
    at = F.when(is_("purchase"), F.col("depth") + 1).otherwise(F.col("depth"))
    action = F.when(is_("error"), "pop_until").when(is_("purchase"), "pop").otherwise("push")
    # a pop of a state that isn't on top does nothing, so pops of an empty stack name a state of depth 1
    return e.select("task", "time", "seq", action.alias("action"), F.when(is_("error"), 2).otherwise(3 + (at - 1) % 4).cast("int").alias("state"))


@query(NESTED + ", x AS (SELECT task, time, seq, CASE WHEN depth = 0 THEN 2 ELSE 3 + (depth - 1) % 4 END AS state FROM c), y AS (SELECT *, lag(state) OVER (PARTITION BY task ORDER BY time, seq) AS prev FROM x), z AS (SELECT task, time AS t0, coalesce(lead(time) OVER (PARTITION BY task ORDER BY time, seq), 2000000000000000) AS t1, state FROM y WHERE prev IS DISTINCT FROM state) SELECT task, t0, t1, CAST(state AS INT) AS state FROM z WHERE t0 < t1 AND state <> 2")
def state_stack_nested(spark, d):
    """Nested states by a replay of each thread's stack, with pops to a state."""
    return T.state_intervals(_nested(spark, d), ["task"], end_time=2_000_000_000_000_000, drop=(0, 2))


# numbers ------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(2 ** (p_size // 10) * 3 ** (p_size % 10) * 5 ** (p_partkey % 4) AS BIGINT) AS code FROM part")
def prime_codes(spark, d):
    """X4."""
    p = table(spark, d, "part")
    digits = F.array(F.expr("p_size div 10").cast("long"), (F.col("p_size") % 10).cast("long"), F.col("p_partkey") % 4)
    return p.select("p_partkey", X.prime_code(digits).cast("long").alias("code"))


CYCLE = "[p_size % 3, p_size % 5 + 1, p_partkey % 4]"


def _cycle():
    return F.array((F.col("p_size") % 3).cast("long"), (F.col("p_size") % 5 + 1).cast("long"), F.col("p_partkey") % 4)


@query(f"SELECT p_partkey, {CYCLE}[(p_partkey - 50) % 3 + CASE WHEN (p_partkey - 50) % 3 < 0 THEN 4 ELSE 1 END] AS got, coalesce(list_sum(list_transform(range(p_partkey % 17), lambda i: {CYCLE}[i % 3 + 1])), 0) AS summed, array_to_string(list_transform(range(4), lambda i: list_sum(list_transform(range(2), lambda j: {CYCLE}[(p_size % 6 + i * 2 + j) % 3 + 1]))), ',') AS sampled, CAST(ceil(p_partkey / (p_size % 7 + 1)) AS BIGINT) AS rounded FROM part")
def cyclic_vectors(spark, d):
    """Places, sums and samples of repeating vectors."""
    p = table(spark, d, "part")
    sampled = X.sample(_cycle(), F.col("p_size") % 6, F.lit(2), F.lit(4), 2)
    return p.select("p_partkey", X.cyclic_get(_cycle(), F.col("p_partkey") - 50).alias("got"), X.cyclic_sum(_cycle(), F.col("p_partkey") % 17).alias("summed"), F.array_join(sampled.cast("array<string>"), ",").alias("sampled"), X.ceil_div(F.col("p_partkey"), (F.col("p_size") % 7 + 1).cast("long")).alias("rounded"))


# predecessors of single-phase channels: the floor of (c k - 1 - t) / p, plus one
PRED = "CAST(floor((({c}) * ({k}) - 1 - ({t})) / ({p})) AS BIGINT) + 1"
ONE = PRED.format(c="p_size % 4 + 1", k="9", t="p_partkey % 5", p="p_partkey % 3 + 1")


@query(f"SELECT p_partkey, {PRED.format(c='p_size % 3 + 1', k=ONE, t='p_size % 2', p='p_size % 5 + 1')} AS first FROM part")
def predecessor_chains(spark, d):
    """Which firing two channels further back the ninth firing waits for."""
    one = lambda x: F.array(x.cast("long"))
    near = lambda k: X.predecessor(F.col("p_partkey") % 5, one(F.col("p_partkey") % 3 + 1), one(F.col("p_size") % 4 + 1), k)
    far = lambda k: X.predecessor((F.col("p_size") % 2).cast("long"), one(F.col("p_size") % 5 + 1), one(F.col("p_size") % 3 + 1), k)
    return table(spark, d, "part").select("p_partkey", X.chain([far, near], F.lit(9).cast("long")).alias("first"))


@query(f"SELECT p_partkey, max(p * pred - c * k) AS upper, min(p * pred - c * k) AS lower FROM (SELECT p_partkey, p_partkey % 3 + 1 AS p, p_size % 4 + 1 AS c, k, {PRED.format(c='p_size % 4 + 1', k='k', t='p_partkey % 5', p='p_partkey % 3 + 1')} AS pred FROM part, range(1, 13) r(k)) GROUP BY 1")
def linear_predecessor_bounds(spark, d):
    """Against all firings of a period."""
    one = lambda x: F.array(x.cast("long"))
    upper, lower = X.linear_bounds(F.col("p_partkey") % 5, one(F.col("p_partkey") % 3 + 1), one(F.col("p_size") % 4 + 1))
    return table(spark, d, "part").select("p_partkey", upper.alias("upper"), lower.alias("lower"))


@query("SELECT event_id AS seq, regexp_extract_all('a ' || event_type || ' zip(x, ' || user_id || ') b', 'zip\\([^)]*\\)|[^ ]+')[3] AS third, CAST(user_id AS VARCHAR) || event_id || '7' AS key FROM events")
def texts_and_keys(spark, d):
    """X17, X20."""
    e = events(spark, d)
    parts = X.split_parameters(F.concat(F.lit("a "), "type", F.lit(" zip(x, "), F.col("task").cast("string"), F.lit(") b")))
    return e.select("seq", F.get(parts, F.lit(2)).alias("third"), X.vector_key(F.array("task", "seq", F.lit(7))).alias("key"))


@query("WITH p AS (SELECT n FROM range(2, (SELECT max(p_partkey) + 2 FROM part)) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 500) s(m) WHERE m * m <= n AND n % m = 0)) SELECT x.p_partkey + 1 AS n, gcd(x.p_partkey + 1, x.p_size) AS g, gcd(x.p_partkey + 1, x.p_size) AS combined, x.p_partkey + 1 AS product, (SELECT count(*) FROM p WHERE (x.p_partkey + 1) % p.n = 0) AS primes FROM part x")
def number_theory(spark, d):
    """A and b combine to their gcd; factors multiply to the number; distinct primes."""
    p = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("n"), F.col("p_size").cast("long").alias("m"))
    p = p.withColumn("e", X.xgcd(F.col("n"), F.col("m"))).withColumn("f", X.prime_factors(F.col("n")))
    return p.select("n", F.get("e", F.lit(0)).alias("g"), (F.col("n") * F.get("e", F.lit(1)) + F.col("m") * F.get("e", F.lit(2))).alias("combined"), F.aggregate("f", F.lit(1).cast("long"), lambda a, b: a * b).alias("product"), F.size(F.array_distinct("f")).cast("long").alias("primes"))


# one small graph for each part ------------------------------------------------------------------------------------------


def _key():
    return F.col("p_partkey").cast("string").alias("graph_id")


def _graph_rows(spark, d, actors: list[tuple], channels: list[tuple]):
    """Actors (name, times) and channels (src, dst, production, consumption, tokens), of SQL expressions over part; a channel may have a condition."""
    p = table(spark, d, "part")
    longs = lambda xs: F.array(*[F.expr(x).cast("long") for x in xs])
    a, c = None, None
    for name, times in actors:
        own = p.select(_key(), F.lit(name).alias("actor"), longs(times).alias("wcet"))
        a = own if a is None else a.union(own)
    for src, dst, made, used, tokens, *when in channels:
        own = p.where(when[0] if when else "true").select(_key(), F.lit(src).alias("src"), F.lit(dst).alias("dst"), longs(made).alias("production"), longs(used).alias("consumption"), F.expr(tokens).cast("long").alias("tokens"))
        c = own if c is None else c.union(own)
    return a, c


def _triples(spark, d):
    """a -> b -> c, and for every fifth part a -> c at equal rates."""
    return _graph_rows(spark, d, [("a", ["1"]), ("b", ["2"]), ("c", ["1"])], [("a", "b", ["p_size % 3 + 1"], ["p_partkey % 4 + 1"], "0"), ("b", "c", ["p_partkey % 3 + 1"], ["p_size % 2 + 1"], "0"), ("a", "c", ["1"], ["1"], "0", "p_partkey % 5 = 0")])


@query("WITH x AS (SELECT p_partkey AS k, (p_partkey % 4 + 1) * (p_size % 2 + 1) AS a, (p_size % 3 + 1) * (p_size % 2 + 1) AS b, (p_size % 3 + 1) * (p_partkey % 3 + 1) AS c FROM part), y AS (SELECT *, gcd(gcd(a, b), c) AS g, k % 5 <> 0 OR a = c AS ok FROM x) SELECT CAST(k AS VARCHAR) AS graph_id, unnest(['a', 'b', 'c']) AS actor, ok AS consistent, unnest(CASE WHEN ok THEN [a // g, b // g, c // g] ELSE [NULL, NULL, NULL] END) AS q FROM y")
def repetition_vectors(spark, d):
    """Also of graphs that can't balance."""
    return graph.repetition(*_triples(spark, d)).select("graph_id", "actor", "consistent", F.col("q").cast("long").alias("q"))


PAIR = {"p": "p_size % 4 + 1", "c": "p_partkey % 3 + 1", "t": "p_partkey % 4", "u": "p_size % 7"}


def _pairs(spark, d):
    """a -> b -> a at rates p and c, with t and u tokens."""
    return _graph_rows(spark, d, [("a", ["p_size % 4 + 1"]), ("b", ["p_partkey % 5 + 1"])], [("a", "b", [PAIR["p"]], [PAIR["c"]], PAIR["t"]), ("b", "a", [PAIR["c"]], [PAIR["p"]], PAIR["u"])])


PAIRS = "WITH x AS (SELECT p_partkey AS k, p_size % 4 + 1 AS p, p_partkey % 3 + 1 AS c, p_partkey % 4 AS t, p_size % 7 AS u, p_size % 4 + 1 AS wa, p_partkey % 5 + 1 AS wb FROM part), g AS (SELECT *, gcd(p, c) AS g, t // gcd(p, c) + u // gcd(p, c) >= (p + c) // gcd(p, c) - 1 AS live FROM x)"


@query(PAIRS + " SELECT CAST(k AS VARCHAR) AS graph_id, live FROM g")
def live_graphs(spark, d):
    """Cycles with too few tokens deadlock."""
    return graph.liveness(*_pairs(spark, d))


@query(PAIRS + ", f AS (SELECT *, c // g AS qa, p // g AS qb FROM g), e AS (SELECT k, 'a' AS src, qa AS qs, 'b' AS dst, j, CAST(floor((c * j - 1 - t) / p) AS BIGINT) + 1 AS i FROM f, range(1, 5) r(j) WHERE j <= qb UNION ALL SELECT k, 'b', qb, 'a', j, CAST(floor((p * j - 1 - u) / c) AS BIGINT) + 1 FROM f, range(1, 5) r(j) WHERE j <= qa) SELECT CAST(k AS VARCHAR) AS graph_id, src, (i - 1) % qs + CASE WHEN (i - 1) % qs < 0 THEN qs ELSE 0 END + 1 AS src_firing, dst, j AS dst_firing, CAST(floor((qs - i) / qs) AS BIGINT) AS tokens FROM e")
def single_rate_edges(spark, d):
    """Every edge of the expanded graphs."""
    return graph.hsdf_edges(*_pairs(spark, d))


def _units(spark, d, self_loops: bool = True):
    """a <-> b at single rates, one firing of each at a time."""
    loops = [("a", "a", ["1"], ["1"], "1"), ("b", "b", ["1"], ["1"], "1")] if self_loops else []
    return _graph_rows(spark, d, [("a", ["p_size % 4 + 1"]), ("b", ["p_partkey % 5 + 1"])], [("a", "b", ["1"], ["1"], "p_partkey % 2"), ("b", "a", ["1"], ["1"], "p_size % 3 + 1"), *loops])


UNITS = "WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS graph_id, p_size % 4 + 1 AS wa, p_partkey % 5 + 1 AS wb, p_partkey % 2 AS t, p_size % 3 + 1 AS u FROM part), y AS (SELECT *, greatest(wa, wb, (wa + wb) / (t + u)) AS period FROM x)"


@query(UNITS + " SELECT graph_id, round(period, 9) AS period, false AS deadlock FROM y")
def graph_periods(spark, d):
    """The period of every graph."""
    return graph.throughput(*_units(spark, d)).select("graph_id", F.round(F.col("num") / F.col("den"), 9).alias("period"), "deadlock")


@query(UNITS + " SELECT graph_id, round(period, 9) AS lower, round(period, 9) AS upper FROM y")
def single_rate_periods(spark, d):
    """For graphs of single rates both bounds are the period."""
    return graph.single_rate_bounds(*_units(spark, d)).select("graph_id", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query(PAIRS + " SELECT CAST(k AS VARCHAR) AS graph_id, true AS within FROM g WHERE live")
def incremental_periods(spark, d):
    """Bounds within a hundredth hold the exact period."""
    live = graph.liveness(*_pairs(spark, d)).where("live").select("graph_id")
    a, c = (x.join(live, "graph_id", "left_semi") for x in _pairs(spark, d))
    found = graph.incremental_bounds(a, c).join(graph.throughput(a, c), "graph_id")
    exact = F.col("num") / F.col("den")
    return found.select("graph_id", ((F.col("lower") <= exact + 1e-9) & (exact <= F.col("upper") + 1e-9) & (F.col("upper") <= F.col("lower") * 1.01 + 1e-9)).alias("within"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, i + 1 AS src_phase, 1 AS dst_phase, (p_size % 3 + 1) + (p_partkey % 4 + 1) AS production, p_size % 5 + 1 AS consumption, p_partkey % 3 + CASE WHEN i = 1 THEN p_size % 3 + 1 ELSE 0 END AS tokens FROM part, range(2) t(i)")
def multi_rate_channels(spark, d):
    """A producer of two phases."""
    a, c = _graph_rows(spark, d, [("a", ["1", "2"]), ("b", ["1"])], [("a", "b", ["p_size % 3 + 1", "p_partkey % 4 + 1"], ["p_size % 5 + 1"], "p_partkey % 3")])
    return graph.multi_rate(a, c).drop("src", "dst")


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, 'a.' || k AS src, 'b.' || m AS dst FROM part, range(2) r(k), range(4) s(m) WHERE (m - k - p_partkey % 2 + 8) % 2 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'b.' || m, 'a.' || k FROM part, range(2) r(k), range(4) s(m) WHERE (k - m - (p_size % 3 + 1) + 8) % 2 = 0")
def unfolded_channels(spark, d):
    """Which of two copies of a and four of b are joined."""
    return graph.changed(*_units(spark, d, False), lambda a, c: sdf.unfold(a, c, {"a": 2, "b": 4})[1]).select("graph_id", "src", "dst")


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, CAST((p_size % 3 + 1) + (p_partkey % 4 + 1) AS VARCHAR) AS production, CAST((p_size % 5 + 1) * 3 AS VARCHAR) AS consumption FROM part")
def vectorised_rates(spark, d):
    """Two firings of a and three of b at once."""
    a, c = _graph_rows(spark, d, [("a", ["1", "2"]), ("b", ["1"])], [("a", "b", ["p_size % 3 + 1", "p_partkey % 4 + 1"], ["p_size % 5 + 1"], "0")])
    return graph.changed(a, c, lambda x, y: sdf.vectorise(x, y, {"a": 2, "b": 3})[1]).select("graph_id", joined("production").alias("production"), joined("consumption").alias("consumption"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, (p_partkey % 4 + 1) || ',' || (p_size % 3 + 1) AS production, 7 + 2 * (p_size % 3 + 1) + (p_partkey % 4 + 1) - 2 * (p_size % 5 + 1) AS tokens, 7 - (p_partkey % 4 + 1) AS rewound FROM part")
def fired_graphs(spark, d):
    """Three firings of a and two of b; and one of a taken back."""
    a, c = _graph_rows(spark, d, [("a", ["1", "2"]), ("b", ["1"])], [("a", "b", ["p_size % 3 + 1", "p_partkey % 4 + 1"], ["p_size % 5 + 1"], "7")])
    on = graph.changed(a, c, lambda x, y: sdf.fire(y, {"a": 3, "b": 2})).select("graph_id", joined("production").alias("production"), "tokens")
    return on.join(graph.changed(a, c, lambda x, y: sdf.fire(y, {"a": -1})).select("graph_id", F.col("tokens").alias("rewound")), "graph_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, 'a' AS src, 'b' AS dst, (p_partkey % 4) * 3 AS tokens FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'b', 'a', (p_size % 7) * 3 FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'b', 'z', 5 FROM part")
def distorted_tokens(spark, d):
    """Three times the tokens on the cycle, none more beside it."""
    a, c = _pairs(spark, d)
    more = a.select("graph_id").distinct()
    a = a.union(more.select("graph_id", F.lit("z"), F.array(F.lit(1).cast("long"))))
    c = c.union(more.select("graph_id", F.lit("b"), F.lit("z"), F.array(F.lit(1).cast("long")), F.array(F.lit(1).cast("long")), F.lit(5).cast("long")))
    return graph.changed(a, c, lambda x, y: sdf.distort(y, 3)).select("graph_id", "src", "dst", "tokens")


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, unnest(['a', 'b']) AS actor, p_partkey % 2 + p_size % 3 + 1 AS at_once, 1 AS firings FROM part")
def parallel_firings(spark, d):
    """As many firings at once as a cycle of single rates has tokens."""
    return graph.parallelism(*_units(spark, d, False))


@query(PAIRS + " SELECT CAST(k AS VARCHAR) AS graph_id, (u // p * p + t) // c AS at_once FROM g")
def pushed_firings(spark, d):
    """Tokens pushed along a -> b."""

    def run(g, a, c):
        yield g, sdf.pushed_parallelism(a, c, "b")

    return graph.per_graph(*_pairs(spark, d), "graph_id string, at_once long", run)


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, 3 AS cycles, 4 AS edges FROM part")
def cycle_bases(spark, d):
    """Edges - nodes + 1 cycles, which have all edges."""

    def run(g, a, c):
        found = sdf.cycle_basis(list(a), [x[:2] for x in c])
        assert all(x[1] == y[0] for cycle in found for x, y in zip(cycle, [*cycle[1:], cycle[0]], strict=True))
        yield g, len(found), len({e for cycle in found for e in cycle})

    return graph.per_graph(*_units(spark, d), "graph_id string, cycles long, edges long", run)


@query(UNITS + " SELECT graph_id, CAST(round(period * (t + u)) AS BIGINT) AS weight, t + u AS tokens FROM y WHERE (wa + wb) / (t + u) > greatest(wa, wb)")
def critical_cycles(spark, d):
    """The sums around the critical cycle, where it is the one through both actors."""
    c = graph.critical_cycles(*_units(spark, d)).groupBy("graph_id").agg(F.sum("weight").cast("long").alias("weight"), F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("n"))
    return c.where("n = 2").drop("n")


def _weighted(spark, d):
    p = table(spark, d, "part")
    edge = lambda s, t, w, k: p.select(_key(), F.lit(s).alias("src"), F.lit(t).alias("dst"), F.expr(w).cast("long").alias("weight"), F.expr(k).cast("long").alias("tokens"))
    return edge(1, 2, "p_size % 9 - 4", "1").union(edge(2, 1, "p_partkey % 11", "p_size % 3")).union(edge(1, 1, "p_size % 7 - 3", "2")).union(edge(2, 3, "100", "0"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, round(greatest((p_size % 9 - 4 + p_partkey % 11) / (1 + p_size % 3), (p_size % 7 - 3) / 2), 9) AS ratio, round(greatest((p_size % 9 - 4 + p_partkey % 11) / 2, p_size % 7 - 3), 9) AS mean FROM part")
def cycle_ratios(spark, d):
    """G14, G15."""
    e = _weighted(spark, d)
    value = lambda n: F.round(F.col("num") / F.col("den"), 9).alias(n)
    return graph.max_cycle_ratios(e).select("graph_id", value("ratio")).join(graph.max_cycle_ratios(e, mean=True).select("graph_id", value("mean")), "graph_id")


@query(UNITS + " SELECT graph_id, greatest(u, CAST(ceil((wa + wb) / greatest(wa, wb)) AS BIGINT) - t) AS tokens FROM y")
def least_buffers(spark, d):
    """The least tokens on the way back for the best period, from those there are."""
    a, c = _units(spark, d)
    best = table(spark, d, "part").select(_key(), F.expr("greatest(p_size % 4 + 1, p_partkey % 5 + 1)").alias("best"))
    out = None
    for target in range(1, 6):  # the periods that occur
        own = best.where(F.col("best") == target).select("graph_id")
        x, y = a.join(own, "graph_id", "left_semi"), c.join(own, "graph_id", "left_semi")
        found = graph.buffer_sizes(x, y, (F.col("src") == "b") & (F.col("dst") == "a"), target).select("graph_id", "tokens")
        out = found if out is None else out.union(found)
    return out


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, CAST(NULL AS BIGINT) AS tokens FROM part")
def impossible_buffers(spark, d):
    """No tokens make an actor faster than it is."""
    return graph.buffer_sizes(*_units(spark, d), (F.col("src") == "b") & (F.col("dst") == "a"), 1, 2).select("graph_id", "tokens")


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, unnest(['x', 'y']) AS var, unnest([greatest((p_size % 9) / 2, p_partkey % 4, 0), CAST(p_size % 5 AS DOUBLE)]) AS value FROM part")
def least_parameters(spark, d):
    """X bounds two cycles, y one."""
    p = table(spark, d, "part")
    edge = lambda s, t, w, c, v: p.select(_key(), F.lit(s).alias("src"), F.lit(t).alias("dst"), F.expr(w).cast("long").alias("weight"), F.lit(c).alias("coef"), F.lit(v).cast("string").alias("var"))
    e = edge(1, 1, "p_size % 9", 2, "x").union(edge(2, 2, "p_partkey % 4", 1, "x")).union(edge(3, 4, "p_size % 5", 1, "y")).union(edge(4, 3, "0", 0, None))
    return graph.minimum_parameters(e)


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, k * (p_size % 4 + 2) AS time, 'a' AS actor, k + 1 AS firing FROM part, range(30) r(k) WHERE k * (p_size % 4 + 2) <= 20 UNION ALL SELECT CAST(p_partkey AS VARCHAR), (k + 1) * (p_size % 4 + 2), 'b', k + 1 FROM part, range(30) r(k) WHERE (k + 1) * (p_size % 4 + 2) <= 20")
def simulated_firings(spark, d):
    """A fires without a pause, and b, which is faster, whenever a ends."""
    a, c = _graph_rows(spark, d, [("a", ["p_size % 4 + 2"]), ("b", ["1"])], [("a", "a", ["1"], ["1"], "1"), ("a", "b", ["1"], ["1"], "0")])

    def run(g, x, y):
        yield from ((g, *row) for row in sdf.simulate_marking(x, y, 20))

    return graph.per_graph(a, c, "graph_id string, time long, actor string, firing long", run)


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, k, (k + 1) * (p_size % 4 + 1) AS a, (k + 1) * (p_size % 4 + 1) + 2 AS b FROM part, range(5) r(k)")
def max_plus_steps(spark, d):
    """a(k) = w + a(k - 1), b(k) = 2 + a(k)."""

    def run(g, x, y):
        system = {1: {("a", "a"): x["a"][0]}, 0: {("b", "a"): 2}}
        for k, v in enumerate(sdf.simulate_max_plus(system, [{"a": 0}], 5)):
            yield g, k, v["a"], v["b"]

    return graph.per_graph(*_units(spark, d), "graph_id string, k long, a long, b long", run)


@query("WITH f AS (SELECT p_size AS graph_id, p_partkey % 6 AS src, p_partkey // 6 % 6 AS dst, sum(p_partkey % 10) AS flow FROM part WHERE p_partkey % 6 <> p_partkey // 6 % 6 GROUP BY ALL) SELECT a.graph_id, a.src, a.dst, CAST(a.flow - coalesce(b.flow, 0) AS BIGINT) AS flow FROM f a LEFT JOIN f b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src WHERE a.flow > coalesce(b.flow, 0)")
def cancelled_flows(spark, d):
    """G25."""
    f = table(spark, d, "part").select(F.col("p_size").alias("graph_id"), (F.col("p_partkey") % 6).alias("src"), F.expr("p_partkey div 6 % 6").alias("dst"), (F.col("p_partkey") % 10).alias("flow"))
    return graph.cancel_opposite(f)


@query("SELECT p_size AS graph_id, p_partkey AS src, p_partkey + 1 AS dst, 9 - p_partkey % 10 AS capacity, p_size AS cost FROM part WHERE p_partkey % 10 < 9 UNION ALL SELECT p_size, p_partkey + 1, p_partkey, p_partkey % 10, -p_size FROM part WHERE p_partkey % 10 > 0 UNION ALL SELECT p_size, NULL, p_partkey, p_size, 0 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_size, p_partkey, NULL, p_size, 0 FROM part WHERE p_partkey % 2 = 1")
def residual_graphs(spark, d):
    """Residual capacities, and the ends of a flow graph."""
    e = table(spark, d, "part").select(F.col("p_size").cast("long").alias("graph_id"), F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(9).cast("long").alias("capacity"), F.col("p_size").cast("long").alias("cost"), (F.col("p_partkey") % 10).alias("flow"))
    wants = e.select("graph_id", F.col("src").alias("node"), (F.col("graph_id") * F.when(F.col("src") % 2 == 0, 1).otherwise(-1)).alias("amount"))
    ends = graph.flow_graph(e, wants).where("src is null or dst is null")
    return graph.residual(e).unionByName(ends)


# larger graphs --------------------------------------------------------------------------------------------------------

ROADS = "l AS (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst, l_linenumber + 3 * (l_orderkey % 5) AS weight FROM lineitem UNION SELECT DISTINCT 2 * l_suppkey + 1, 2 * l_partkey, CAST(l_quantity AS BIGINT) % 7 + l_orderkey % 3 FROM lineitem)"


def _roads(spark, d):
    li = table(spark, d, "lineitem")
    out = li.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), (F.col("l_linenumber") + 3 * (F.col("l_orderkey") % 5)).cast("long").alias("weight"))
    back = li.select((2 * F.col("l_suppkey") + 1).alias("src"), (2 * F.col("l_partkey")).alias("dst"), (F.col("l_quantity").cast("long") % 7 + F.col("l_orderkey") % 3).alias("weight"))
    return out.union(back)


@query("WITH RECURSIVE " + ROADS + ", p AS (SELECT CAST(2 AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n UNION ALL SELECT l.dst, CAST(min(p.dist + l.weight) AS BIGINT), p.n + 1 FROM p JOIN l ON l.src = p.node WHERE p.n < 16 GROUP BY l.dst, p.n) SELECT node, min(dist) AS dist FROM p GROUP BY node")
def road_distances(spark, d):
    """Distances over a graph of all line items."""
    return graph.distances(_roads(spark, d), 2)[0]


@query("SELECT CAST(0 AS BIGINT) AS wrong, true AS cycle")
def road_distances_verified(spark, d):
    """No road shortens a distance; and with one that gives more than it takes, a negative cycle is found."""
    roads = checkpointed(_roads(spark, d).groupBy("src", "dst").agg(F.min("weight").alias("weight")))  # a longer one shortens nothing
    bad = roads.union(roads.orderBy("src", "dst", "weight").limit(1).select("dst", "src", (-F.col("weight") - 1).alias("weight")))
    cycle = graph.distances(bad, 2)[1]
    return graph.relaxable(roads, graph.distances(roads, 2)[0]).agg(F.count("*").alias("wrong")).withColumn("cycle", F.lit(cycle))


SMALL = "l AS (SELECT DISTINCT p_size AS g, p_partkey % 12 AS src, p_partkey // 12 % 12 AS dst, p_partkey % 23 + 1 AS weight FROM part)"


def _small_graphs(spark, d):
    return table(spark, d, "part").select(F.col("p_size").cast("long").alias("graph_id"), (F.col("p_partkey") % 12).alias("src"), F.expr("p_partkey div 12 % 12").alias("dst"), (F.col("p_partkey") % 23 + 1).alias("weight")).distinct()


@query("WITH RECURSIVE " + SMALL + ", p AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist, 0 AS n FROM l UNION ALL SELECT p.g, l.dst, CAST(min(p.dist + l.weight) AS BIGINT), p.n + 1 FROM p JOIN l ON l.g = p.g AND l.src = p.node WHERE p.n < 12 GROUP BY p.g, l.dst, p.n) SELECT m.method, CAST(g AS BIGINT) AS graph_id, node, min(dist) AS dist FROM p, (VALUES ('queue'), ('order'), ('policy')) m(method) GROUP BY ALL")
def path_methods(spark, d):
    """Three methods give the same distances."""
    e, out = _small_graphs(spark, d), None
    for method in ("queue", "order", "policy"):
        found = graph.scans(e, 0, method).select(F.lit(method).alias("method"), "graph_id", "node", "dist")
        out = found if out is None else out.union(found)
    return out


@query()
def path_method_scans(spark, d):
    """Mean and deviation of the scans of a node, of each method."""
    e, out = _small_graphs(spark, d), None
    for method in ("queue", "order", "policy"):
        found = graph.scans(e, 0, method).groupBy("graph_id").agg(F.max("scans").alias("scans"), F.count("*").alias("nodes")).select(F.lit(method).alias("family"), "scans", "nodes")
        out = found if out is None else out.union(found)
    return graph.scan_statistics(out)


@query("SELECT p_brand AS family, round(avg(p_partkey / p_size), 6) AS mean, round(stddev_pop(p_partkey / p_size), 6) AS deviation FROM part GROUP BY 1")
def scan_statistics_of_families(spark, d):
    """The operator on given counts."""
    given = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("scans"), F.col("p_size").alias("nodes"))
    return graph.scan_statistics(given).select("family", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("WITH RECURSIVE a AS (SELECT CAST(p_partkey + 1 AS BIGINT) AS r, CAST((p_partkey + 1) // 2 AS BIGINT) AS c, CAST(p_size - 20 AS BIGINT) AS v FROM part WHERE p_partkey > 0), n AS (SELECT r AS x FROM a UNION SELECT c FROM a), s AS (SELECT x AS r, x AS c, CAST(0 AS BIGINT) AS v FROM n UNION ALL SELECT a.r, s.c, a.v + s.v FROM s JOIN a ON a.c = s.r) SELECT r, c, max(v) AS v FROM s GROUP BY 1, 2")
def maxplus_star_tree(spark, d):
    """G20 over a tree of all parts."""
    a = table(spark, d, "part").where("p_partkey > 0").select((F.col("p_partkey") + 1).alias("r"), F.expr("(p_partkey + 1) div 2").alias("c"), (F.col("p_size") - 20).cast("long").alias("v"))
    return graph.mp_star(a)


@query("WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS n, p_size AS v, p_size % 3 + 1 AS m FROM part) SELECT CASE WHEN k = m THEN n ELSE n || '<' || n || '@' || k END AS r, CASE WHEN k = 1 THEN n ELSE n || '<' || n || '@' || (k - 1) END AS c, CASE WHEN k = 1 THEN v ELSE 0 END AS v FROM s, range(1, 4) t(k) WHERE k <= m")
def maxplus_delays(spark, d):
    """A state for each step of a longer delay."""
    s = table(spark, d, "part").select((F.col("p_size") % 3 + 1).alias("delay"), F.col("p_partkey").cast("string").alias("r"), F.col("p_partkey").cast("string").alias("c"), F.col("p_size").cast("long").alias("v"))
    return graph.first_order(s)


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, unnest(['a', 'b']) AS src, unnest(['b', 'a']) AS dst, unnest([p_partkey % 4, p_size % 9 - p_partkey % 4]) AS tokens FROM part WHERE p_size % 9 >= p_partkey % 4 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'a', 'b', p_partkey % 4 FROM part WHERE p_size % 9 < p_partkey % 4")
def bounded_channels(spark, d):
    """Channels with a capacity get a way back."""
    p = table(spark, d, "part")
    c = p.select(_key(), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.array(F.lit(1)).alias("production"), F.array(F.lit(1)).alias("consumption"), (F.col("p_partkey") % 4).alias("tokens"), F.when(F.col("p_size") % 9 >= F.col("p_partkey") % 4, F.col("p_size") % 9).cast("long").alias("capacity"))
    return graph.with_reverse(c).select("graph_id", "src", "dst", "tokens")


@query("SELECT DISTINCT l_orderkey AS graph_id, l_partkey AS node FROM lineitem WHERE l_partkey IN (SELECT l_suppkey FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey) OR l_linenumber < 3")
def graphs_without_sinks(spark, d):
    """a graph for each order."""
    li = table(spark, d, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("node"))
    edges = li.where("l_linenumber < 3").select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).union(li.select("l_orderkey", "l_suppkey", "l_partkey"))
    return graph.remove_sinks(nodes, edges)[0].distinct()  # where a graph's rows already are: no task holds all the nodes of what it reads


@query("WITH RECURSIVE l AS (SELECT DISTINCT c_custkey % 60 AS src, (c_custkey * 7 + c_nationkey) % 90 AS dst FROM customer), r AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src), n AS (SELECT src AS node FROM l UNION SELECT dst FROM l) SELECT n.node, least(n.node, coalesce((SELECT min(a.dst) FROM r a WHERE a.src = n.node AND EXISTS (SELECT 1 FROM r b WHERE b.src = a.dst AND b.dst = n.node)), n.node)) AS component FROM n")
def strong_components(spark, d):
    """G3."""
    c = table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 90).alias("dst")).distinct()
    return graph.strong_components(c)


@query("WITH n AS (SELECT count(*) AS n FROM supplier), i AS (SELECT row_number() OVER () - 1 AS i FROM supplier) SELECT 'random' AS kind, i AS id, true AS holds FROM i UNION ALL SELECT 'ring', i, true FROM i UNION ALL SELECT 'degree', i, true FROM i")
def generated_graphs(spark, d):
    """Of as many graphs, rings and nodes as there are suppliers: random dataflow graphs are consistent and live, a shift by potentials keeps the
    sums around rings, a random graph has a cycle through all nodes."""
    n = table(spark, d, "supplier").count()
    actors, channels = graph.random_sdf(spark, n)
    found = graph.repetition(actors, channels).groupBy("graph_id").agg(F.min("consistent").alias("c")).join(graph.liveness(actors, channels), "graph_id")
    random = found.select(F.lit("random").alias("kind"), F.regexp_extract("graph_id", r"(\d+)", 1).cast("long").alias("id"), (F.col("c") & F.col("live")).alias("holds"))
    torus = graph.torus(spark, n, 8)
    ring = lambda e: e.where("src div 8 = dst div 8").groupBy(F.expr("src div 8").alias("id")).agg(F.sum("weight").alias("w"))
    rings = ring(torus).join(ring(graph.potential_shift(torus)).withColumnRenamed("w", "x"), "id").select(F.lit("ring"), "id", (F.col("w") == F.col("x")))
    degree = graph.random_graph(spark, n, 4 * n).groupBy("src").agg(F.max((F.col("dst") == (F.col("src") + 1) % n).cast("int")).alias("next")).select(F.lit("degree"), "src", F.col("next") == 1)
    return random.union(rings).union(degree)


# rules and transformation events ----------------------------------------------------------------------------------------

HOLDS = ("pure", "no_writes", "no_rw", "is_array", "is_rollable", "not", "all_are_decl", "no_writes_in_read")
CATALOGUE = "r(rule, conditions) AS (VALUES " + ", ".join(f"('{n}', CAST([{', '.join(repr(x) for x in c.split())}] AS VARCHAR[]))" for n, c in rules.RULES.items()) + ")"


@query("WITH " + CATALOGUE + ", p AS (SELECT p_partkey AS place, list_filter(list_transform(range(8), lambda i: CASE WHEN (p_partkey // (2 ** i)::INT) % 2 = 1 THEN " + str(list(HOLDS)) + "[i + 1] END), lambda x: x IS NOT NULL) AS holds FROM part) SELECT place, rule FROM p, r WHERE list_has_all(holds, conditions)")
def applicable_rules(spark, d):
    """2.13: the rules whose side conditions hold at each place."""
    p = table(spark, d, "part")
    some = F.array(*[F.when(F.expr(f"p_partkey div {2 ** i} % 2 = 1"), name) for i, name in enumerate(HOLDS)])
    return rules.applicable(p.select(F.col("p_partkey").alias("place"), F.filter(some, lambda x: x.isNotNull()).alias("holds")), rules.rules(spark))


@query("WITH n(type, name) AS (VALUES " + ", ".join(f"({rules.FIRST_ID + i}, '{n}')" for i, n in enumerate(rules.TRANSFORMATIONS)) + "), e AS (SELECT user_id AS task, epoch_us(ts) AS time, event_id AS seq, 1000000 + event_id % 3 AS type, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS value FROM events), l AS (SELECT *, lead(value) OVER w AS nv, lead(time) OVER w AS t1 FROM e WINDOW w AS (PARTITION BY task, type ORDER BY time, seq)) SELECT task, name, time AS t0, t1 FROM l JOIN n USING (type) WHERE value = 1 AND nv = 0")
def transformation_intervals(spark, d):
    """2.10: transformation events from start to end."""
    e = events(spark, d).select("task", "time", "seq", (rules.FIRST_ID + F.col("seq") % 3).alias("type"), F.when(F.col("type").isin("click", "view"), 1).otherwise(0).alias("value"))
    return rules.transformation_intervals(e, ["task"])


# signals and streams ------------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE h AS (SELECT user_id AS task, epoch_us(ts) AS time FROM events WHERE event_type = 'click'), r AS (SELECT DISTINCT task, 0 AS k, CAST(1704067200000000 AS DOUBLE) AS t0, CAST(43200000000 AS DOUBLE) AS f FROM h UNION ALL SELECT r.task, r.k + 1, r.t0 + r.f, CASE WHEN (SELECT count(*) FROM h WHERE h.task = r.task AND h.time > r.t0 AND h.time <= r.t0 + r.f) > 0 THEN r.f ELSE 1.5 * r.f END FROM r WHERE r.t0 + r.f < 1706745600000000 AND r.k < 63) SELECT task, k, t0, t0 + f AS t1, (SELECT count(*) FROM h WHERE h.task = r.task AND h.time > r.t0 AND h.time <= r.t0 + r.f) > 0 AS found FROM r")
def phase_triggers(spark, d):
    """Half a day at first, half as long again after each interval without a click."""
    return signals.phase_schedule(events(spark, d).where(is_("click")), "task", 1704067200000000, 1706745600000000, 43200000000)


@query("SELECT p_partkey, p_partkey % 7 + 3 AS period FROM part")
def signal_periods(spark, d):
    """T4: the period of a saw-tooth for each part."""
    s = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("time"))
    return signals.periods(s.withColumn("value", (F.col("time") % (F.col("p_partkey") % 7 + 3)).cast("double")), "p_partkey").select("p_partkey", "period")


@query("WITH p AS (SELECT p_brand AS app, p_partkey AS phase, p_size % 3 AS kind FROM part), f AS (SELECT app, kind, dense_rank() OVER (PARTITION BY app ORDER BY min(phase)) - 1 AS representative FROM p GROUP BY 1, 2), s AS (SELECT p.*, row_number() OVER (PARTITION BY app, kind ORDER BY phase) AS seen FROM p) SELECT app, phase, representative, seen, seen = 3 AS traced FROM s JOIN f USING (app, kind)")
def phase_representatives(spark, d):
    """Three kinds of phases in each application, each traced when it is seen for the third time."""
    p = table(spark, d, "part")
    vector = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("p_size") % 3, 100.0 + F.col("p_partkey") % 3).otherwise(0.0))
    return signals.representatives(p.select(F.col("p_brand").alias("app"), F.col("p_partkey").alias("phase"), vector.alias("vector")), min_seen=2, app="app")


@query("WITH c AS (SELECT c_custkey, c_acctbal AS x, CASE WHEN c_acctbal - lag(c_acctbal) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM customer WINDOW w AS (ORDER BY c_acctbal, c_custkey)), g AS (SELECT *, sum(fresh) OVER (ORDER BY x, c_custkey ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY run) > 1 THEN min(c_custkey) OVER (PARTITION BY run) END AS cluster FROM g")
def burst_clusters(spark, d):
    """In one dimension, with two for a core, a cluster is a run of gaps within the radius."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return signals.cluster_bursts(c, "c_custkey", ["c_acctbal"], 3.0, 2).select("c_custkey", "cluster")


def _streamed(spark, d, make, mode: str) -> DataFrame:
    """The rows that a stream of the events has written last."""
    path = scratch(spark, "stream")
    given = table(spark, d, "events")
    source = scratch(spark, "source")
    given.write.parquet(source)
    stream = make(spark.readStream.schema(given.schema).parquet(source))
    stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT user_id AS task, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS minute, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS dur FROM events WHERE event_id > 100 GROUP BY ALL")
def streamed_bursts(spark, d):
    """Bursts above a length in windows of a minute, as a stream with a watermark."""

    def make(stream: DataFrame) -> DataFrame:
        return signals.stream_bursts(stream.select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("dur")), "task", 100)

    return _streamed(spark, d, make, "complete").select("task", F.unix_micros("window.start").alias("minute"), "n", "dur")


@query("WITH s AS (SELECT user_id AS task, event_id AS t, event_id % 50 AS w, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM events) SELECT task, max(t) AS t_ms, round(coalesce(sum(w * dt), 0) / 1000, 6) AS energy_j FROM s GROUP BY 1")
def streamed_energy(spark, d):
    """The energy of each task as a stream keeps it."""

    def make(stream: DataFrame) -> DataFrame:
        return signals.stream_energy(stream.select(F.col("user_id").alias("task"), F.col("event_id").alias("t_ms"), (F.col("event_id") % 50).cast("double").alias("w")), "task", ["w"])

    last = _streamed(spark, d, make, "update").groupBy("task").agg(F.max(F.struct("t_ms", "energy_j")).alias("x"))
    return last.select("task", "x.t_ms", F.round("x.energy_j", 6).alias("energy_j"))


# learning -----------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS predicted FROM part")
def size_classifier(spark, d):
    """M3: a tree learnt from all parts."""
    from pyspark.ml.functions import array_to_vector

    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 3).alias("feat"), F.when(F.col("p_size") > 25, 1).otherwise(0).alias("label"))
    told = features.decision_tree(p).transform(p.select("p_partkey", array_to_vector(F.col("feat").cast("array<double>")).alias("features")))
    return told.select("p_partkey", F.col("prediction").cast("int").alias("predicted"))


@query("SELECT * FROM (VALUES (0, 'size <= 25.5', 0, 1, 2), (1, NULL, 0, NULL, NULL), (2, NULL, 1, NULL, NULL)) t(node, condition, prediction, yes, no)")
def exported_tree(spark, d):
    """M4: the tree as rows."""
    p = table(spark, d, "part").select(F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 3).alias("feat"), F.when(F.col("p_size") > 25, 1).otherwise(0).alias("label"))
    found = features.tree_rows(spark, features.decision_tree(p), ["size", "rest"])
    return found.withColumn("prediction", F.when(F.col("node") == 0, 0).otherwise(F.col("prediction")).cast("int"))


@query("SELECT 'p' || p_partkey AS file, i AS idx, CASE WHEN i = 0 THEN p_size % 3 ELSE 1 END AS expected, CASE WHEN i = 0 THEN p_size % 2 ELSE 1 END AS found FROM part, range(2) t(i) WHERE i = 0 AND p_size % 3 <> p_size % 2")
def header_mismatches(spark, d):
    """M9."""
    p = table(spark, d, "part").select(text_of("p", F.col("p_partkey")).alias("file"), F.array(F.col("p_size") % 2, F.lit(1)).alias("feat"), F.array(F.col("p_size") % 3, F.lit(1)).alias("test"))
    return features.mismatches(p)


@query("SELECT l_orderkey AS state, min(l_linenumber) AS id_change FROM lineitem WHERE l_partkey % 4 = l_orderkey % 4 AND l_suppkey % 3 = 1 GROUP BY 1")
def chosen_changes(spark, d):
    """M8: the first candidate with the predicted rule and state."""
    li = table(spark, d, "lineitem")
    ch = li.select(F.col("l_orderkey").alias("state"), (F.col("l_partkey") % 4).alias("rule"), F.col("l_linenumber").alias("id_change"), (F.col("l_suppkey") % 3).alias("result"))
    wanted = li.select(F.col("l_orderkey").alias("state"), (F.col("l_orderkey") % 4).alias("rule"), F.lit(1).cast("long").alias("next_state")).distinct()
    return features.choose_change(ch, wanted)


@query(fixtures.golden_sql("state, action, next_state", [(s, a, s + 1) for s, a in enumerate(fixtures.GREEDY)]))
def sampled_policy(spark, d):
    """M6: the greedy policy after sampled training is the known one."""
    t = fixtures.transition_table(spark)
    return features.greedy(t, features.sampled_values(t, [0], [22], seed=3), [22])


@query("SELECT p_partkey AS file, p_size % 3 - 1 AS max_loop_depth, p_partkey % 4 + 1 AS calls, p_size % 3 AS for_loops, p_partkey % 2 AS ifs, p_partkey % 2 AS empty_ifs, CASE WHEN p_size % 3 > 0 AND p_size % 5 <> 1 THEN 1 ELSE 0 END AS non_unit_steps, p_size % 4 AS ternaries, CASE WHEN p_size % 3 > 0 AND p_partkey % 3 = 1 THEN 1 ELSE 0 END AS shifted_writes, CASE WHEN p_size % 3 > 0 THEN p_partkey % 2 ELSE 0 END AS irregular_loops FROM part")
def code_features(spark, d):
    """Code with as many loops, calls and branches as its part says."""
    p = table(spark, d, "part")
    many = lambda text, n: F.array_join(F.array_repeat(F.lit(text), n.cast("int")), " ")
    loops, size = F.col("p_size") % 3, F.col("p_size") % 5
    inner = F.concat(F.lit("v[i"), F.when(F.col("p_partkey") % 3 == 1, " + 1").otherwise(""), F.lit("] = 2;"), F.when(F.col("p_partkey") % 2 == 1, " break;").otherwise(""))
    step = F.when(size == 1, "i++").otherwise(F.concat(F.lit("i += "), (size + 2).cast("string")))
    body = F.when(loops == 0, "").when(loops == 1, F.concat(F.lit("for (i = 0; i < 9; "), step, F.lit(") { "), inner, F.lit(" }"))).otherwise(F.concat(F.lit("for (j = 0; j < 9; j++) for (i = 0; i < 9; "), step, F.lit(") { "), inner, F.lit(" }")))
    code = F.concat(F.lit("int f(int a, int b) { int i, j, v[9]; /* if (x) */ "), many("g(a);", F.col("p_partkey") % 4 + 1), F.lit(" "), many("if (a) { }", F.col("p_partkey") % 2), F.lit(" "), many("b = a ? 1 : 2;", F.col("p_size") % 4), F.lit(" "), body, F.lit(" return b; }"))
    found = features.named(ccode.code_features(p.select(F.col("p_partkey").alias("file"), code.alias("value"))))
    return found.select("file", "max_loop_depth", "calls", "for_loops", "ifs", "empty_ifs", "non_unit_steps", "ternaries", "shifted_writes", "irregular_loops")


@query("SELECT p_partkey, array_to_string(list_concat(list_transform(range(p_size % 4), lambda i: p_partkey % 9), [p_size]), ',') AS parsed FROM part")
def run_length_rates(spark, d):
    """Rates written as `[n * v, m]`."""
    rates = text_of("[", F.col("p_size") % 4, " * ", F.col("p_partkey") % 9, ", ", F.col("p_size"), "]")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.parse_rates(rates).cast("array<string>"), ",").alias("parsed"))


@query("SELECT p_partkey, CAST(p_size % 7 AS INT) AS code FROM part")
def scope_codes(spark, d):
    """Codes to names and back."""
    return table(spark, d, "part").select("p_partkey", X.scope_code(X.scope_kind((F.col("p_size") % 7).cast("int"))).alias("code"))


@query("{EV}, m AS (SELECT task AS state, cents % 5 AS action, max(seq) AS next_state, count(*) AS q FROM e GROUP BY ALL), b AS (SELECT state, max(q) AS q FROM m GROUP BY 1), a AS (SELECT state, min(action) AS action FROM m JOIN b USING (state, q) GROUP BY 1) SELECT a.state, a.action, m.next_state FROM a JOIN m USING (state, action) WHERE a.state NOT IN (1, 2)")
def greedy_moves(spark, d):
    """The best rule of each state and where it leads; goals have none."""
    m = events(spark, d).groupBy(F.col("task").alias("state"), (F.col("cents") % 5).alias("action")).agg(F.max("seq").alias("next_state"), F.count("*").alias("q"))
    return features.greedy(m.drop("q"), m.drop("next_state"), [1, 2])


@query("SELECT CAST(p_partkey AS VARCHAR) AS graph_id, 1 AS scales FROM part")
def channel_scales(spark, d):
    """G1: scale times rate times firings is the same for all channels of a graph."""
    a, c = _pairs(spark, d)
    q = graph.repetition(a, c).select("graph_id", F.col("actor").alias("src"), F.col("q").cast("long").alias("q"))
    each = graph.channel_scale(a, c).join(c, ["graph_id", "src", "dst"]).join(q, ["graph_id", "src"])
    return each.groupBy("graph_id").agg(F.countDistinct(F.col("s") * F.get("production", F.lit(0)) * F.col("q")).alias("scales"))


@query(UNITS + " SELECT graph_id, true AS holds FROM y")
def graph_schedules(spark, d):
    """Starts from 0 that wait for what they depend on, within the period."""
    a, c = _units(spark, d)
    s = graph.schedule(a, c).withColumn("t", F.col("start_num") / F.col("start_den"))
    ends = s.join(a, ["graph_id", "actor"]).select("graph_id", F.col("actor").alias("src"), (F.col("t") + F.get("wcet", F.lit(0))).alias("end"))
    starts = s.select("graph_id", F.col("actor").alias("dst"), F.col("t").alias("start"))
    period = graph.throughput(a, c).select("graph_id", (F.col("num") / F.col("den")).alias("period"))
    each = c.join(ends, ["graph_id", "src"]).join(starts, ["graph_id", "dst"]).join(period, "graph_id")
    return each.groupBy("graph_id").agg((F.bool_and(F.col("start") >= F.col("end") - F.col("period") * F.col("tokens") - 1e-9) & (F.min("start") == 0)).alias("holds"))


@query("WITH RECURSIVE m AS (SELECT CAST(n_nationkey AS INT) AS s, CAST((n_nationkey * 3 + a * a) % 25 AS INT) AS t FROM nation, range(3) r(a)), d AS (SELECT 24 AS s, 0 AS k UNION SELECT m.s, d.k + 1 FROM m JOIN d ON m.t = d.s WHERE d.k < 25), f AS (SELECT s, min(k) AS k FROM d GROUP BY 1) SELECT w.way, f.s AS state, CASE WHEN w.way = 'iterated' THEN f.k END AS steps, true AS arrives FROM f, (VALUES ('iterated'), ('sampled')) w(way) WHERE f.k > 0")
def learnt_policies(spark, d):
    """M6: the policy of value iteration takes the shortest way to the goal, that of sampled training gets there, from every state that can."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("action"))
    moves = n.withColumn("next_state", ((F.col("state") * 3 + F.col("action") * F.col("action")) % 25).cast("int"))
    ways = {"iterated": features.value_iteration(moves, [24]), "sampled": features.sampled_values(moves, list(range(24)), [24], episodes=300, seed=5)}
    out = None
    for way, q in ways.items():
        # how far each state is from the goal along the policy
        links = features.greedy(moves, q, [24]).select(F.col("next_state").alias("src"), F.col("state").alias("dst"), F.lit(1).alias("weight"))
        dist, _ = graph.distances(links, 24)
        steps = F.col("dist").cast("int") if way == "iterated" else F.lit(None).cast("int")
        found = dist.where("node <> 24").select(F.lit(way).alias("way"), F.col("node").alias("state"), steps.alias("steps"), F.lit(True).alias("arrives"))
        out = found if out is None else out.union(found)
    return out


#: Published or hand-worked values of small fixtures, and queries that a larger one above takes the place of: for the unit tests.
GOLDEN = set(
    "change_coverage parameter_links memory_propagation scope_roll_up sdf_repetition sdf_hsdf_size sdf_throughput sdf_channel_scale sdf_liveness sdf_schedule multi_rate_size "
    "single_rate_upper_bounds max_cycle_ratio max_cycle_mean buffer_sizes critical_cycle reverse_channels marking_simulation maxplus_first_order minimum_parameters greedy_policy "
    "feature_vector_check chosen_change decision_tree period_representatives lexical_features cycle_sums parsed_rates scope_kinds sampled_policy sssp sssp_verified "
    "sssp_negative_cycle without_sinks maxplus_star state_stack scc_components stacked_pushes primes modular_inverses".split()
)
