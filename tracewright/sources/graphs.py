"""Dataflow graphs from and to JSON, XML, text and arc lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.exprs import parse_rates

_RATE = "string"  # an integer, a list or a run-length text; read as text and parsed
SCHEMA = f"type string, actors array<struct<name:string,wcet:{_RATE}>>, channels array<struct<from:string,to:string,production:{_RATE},consumption:{_RATE},tokens:long,capacity:long,var:string>>"


def _graph_id(rows: DataFrame) -> Column:
    """The graph of a row of files: the folder graph_id=... that write_texts makes, else the file's name."""
    return F.col("graph_id").cast("string") if "graph_id" in rows.columns else F.element_at(F.split(F.input_file_name(), "/"), -1)


def write_texts(texts: DataFrame, path: str) -> None:
    """A file for each (graph_id, value), in a folder of its own."""
    texts.write.partitionBy("graph_id").option("lineSep", "\n").text(path)


def _rates(x: Column) -> Column:
    return F.when(x.isNull(), F.array(F.lit(1).cast("long"))).otherwise(parse_rates(x))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(actors, channels) of graph files; the graph_id is the file's name. Missing rates and times are 1, missing tokens 0."""
    rows = spark.read.text(path, wholetext=True)
    files = rows.select(_graph_id(rows).alias("graph_id"), F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("g"))
    actors = files.select("graph_id", F.explode("g.actors").alias("a")).select("graph_id", F.col("a.name").alias("actor"), _rates(F.col("a.wcet")).alias("wcet"))
    c = files.select("graph_id", F.explode("g.channels").alias("c"))
    name = lambda k: F.when(F.col(f"c.{k}").isNull(), F.raise_error(F.lit(f"channel without {k}"))).otherwise(F.col(f"c.{k}"))
    channels = c.select("graph_id", name("from").alias("src"), name("to").alias("dst"), _rates(F.col("c.production")).alias("production"), _rates(F.col("c.consumption")).alias("consumption"), F.coalesce("c.tokens", F.lit(0)).cast("long").alias("tokens"), "c.capacity", "c.var")
    return actors, channels


def unknown_actors(actors: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels whose ends are no actors of the graph."""
    names = actors.select("graph_id", "actor")
    src = channels.join(names.withColumnRenamed("actor", "src"), ["graph_id", "src"], "left_anti")
    return src.unionByName(channels.join(names.withColumnRenamed("actor", "dst"), ["graph_id", "dst"], "left_anti")).distinct()


def to_json(actors: DataFrame, channels: DataFrame) -> DataFrame:
    """S3: (graph_id, value): one JSON text for each graph; vectors of length 1 are numbers."""

    def rates(c: str) -> Column:
        return F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("string")).otherwise(F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ","), F.lit("]")))

    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    a = actors.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("actor", F.concat(F.lit('{"name":'), quoted("actor"), F.lit(',"wcet":'), rates("wcet"), F.lit("}")).alias("t")))), lambda x: x["t"]), ",").alias("a"))
    tokens = F.when(F.col("tokens") > 0, F.concat(F.lit(',"tokens":'), F.col("tokens").cast("string"))).otherwise("")
    text = F.concat(F.lit('{"from":'), quoted("src"), F.lit(',"to":'), quoted("dst"), F.lit(',"production":'), rates("production"), F.lit(',"consumption":'), rates("consumption"), tokens, F.lit("}"))
    c = channels.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", text.alias("t")))), lambda x: x["t"]), ",").alias("c"))
    return a.join(c, "graph_id", "left").select("graph_id", F.concat(F.lit('{"type":"csdf","actors":['), "a", F.lit('],"channels":['), F.coalesce("c", F.lit("")), F.lit("]}")).alias("value"))


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from XML of `sdf` or `csdf` graphs: actors with rated ports, channels between ports, execution times in properties."""
    port = "struct<_name:string,_type:string,_rate:string>"
    schema = (
        f"sdf struct<actor:array<struct<_name:string,port:array<{port}>>>,channel:array<struct<_srcActor:string,_srcPort:string,_dstActor:string,_dstPort:string,_initialTokens:long>>>,"
        f"csdf struct<actor:array<struct<_name:string,port:array<{port}>>>,channel:array<struct<_srcActor:string,_srcPort:string,_dstActor:string,_dstPort:string,_initialTokens:long>>>,"
        "sdfProperties struct<actorProperties:array<struct<_actor:string,processor:array<struct<_default:string,executionTime:struct<_time:string>>>>>>,"
        "csdfProperties struct<actorProperties:array<struct<_actor:string,processor:array<struct<_default:string,executionTime:struct<_time:string>>>>>>"
    )
    found = spark.read.format("xml").option("rowTag", "applicationGraph").schema(schema).load(path)
    rows = found.select(_graph_id(found).alias("graph_id"), F.coalesce("sdf", "csdf").alias("g"), F.coalesce("sdfProperties", "csdfProperties").alias("p"))
    times = rows.select("graph_id", F.explode("p.actorProperties").alias("a")).select("graph_id", F.col("a._actor").alias("actor"), F.coalesce(F.get(F.filter("a.processor", lambda x: x["_default"] == "true"), F.lit(0)), F.get("a.processor", F.lit(0)))["executionTime"]["_time"].alias("t"))
    own = rows.select("graph_id", F.explode("g.actor").alias("a"))
    actors = own.select("graph_id", F.col("a._name").alias("actor")).join(times, ["graph_id", "actor"], "left").select("graph_id", "actor", _rates(F.col("t")).alias("wcet"))
    ports = own.select("graph_id", F.col("a._name").alias("actor"), F.explode("a.port").alias("q")).select("graph_id", "actor", F.col("q._name").alias("port"), F.col("q._rate").alias("rate"))
    ch = rows.select("graph_id", F.explode("g.channel").alias("c")).select("graph_id", F.col("c._srcActor").alias("src"), F.col("c._srcPort").alias("sp"), F.col("c._dstActor").alias("dst"), F.col("c._dstPort").alias("dp"), F.coalesce("c._initialTokens", F.lit(0)).alias("tokens"))
    s = ports.select("graph_id", F.col("actor").alias("src"), F.col("port").alias("sp"), F.col("rate").alias("sr"))
    d = ports.select("graph_id", F.col("actor").alias("dst"), F.col("port").alias("dp"), F.col("rate").alias("dr"))
    joined = ch.join(s, ["graph_id", "src", "sp"], "left").join(d, ["graph_id", "dst", "dp"], "left")
    return actors, joined.select("graph_id", "src", "dst", _rates(F.col("sr")).alias("production"), _rates(F.col("dr")).alias("consumption"), F.col("tokens").cast("long").alias("tokens"))


def to_xml(actors: DataFrame, channels: DataFrame) -> DataFrame:
    """(graph_id, value): an XML text for each graph, as read_xml reads it; names must not need escapes."""
    rates = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    ends = channels
    key = F.concat("src", F.lit("-"), "dst")
    ports = ends.select("graph_id", F.col("src").alias("actor"), F.concat(F.lit('<port name="o-'), key, F.lit('" type="out" rate="'), rates("production"), F.lit('"/>')).alias("p")).union(ends.select("graph_id", F.col("dst"), F.concat(F.lit('<port name="i-'), key, F.lit('" type="in" rate="'), rates("consumption"), F.lit('"/>'))))
    by = ports.groupBy("graph_id", "actor").agg(F.array_join(F.array_sort(F.collect_list("p")), "").alias("p"))
    a = actors.join(by, ["graph_id", "actor"], "left").groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<actor name="'), "actor", F.lit('" type="'), "actor", F.lit('">'), F.coalesce("p", F.lit("")), F.lit("</actor>")))), "").alias("a"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<actorProperties actor="'), "actor", F.lit('"><processor type="p" default="true"><executionTime time="'), rates("wcet"), F.lit('"/></processor></actorProperties>')))), "").alias("t"),
    )
    c = channels.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<channel name="'), key, F.lit('" srcActor="'), "src", F.lit('" srcPort="o-'), key, F.lit('" dstActor="'), "dst", F.lit('" dstPort="i-'), key, F.lit('" initialTokens="'), F.col("tokens").cast("string"), F.lit('"/>')))), "").alias("c"))
    return a.join(c, "graph_id", "left").select("graph_id", F.concat(F.lit('<sdf3 type="csdf" version="1.0"><applicationGraph><csdf>'), "a", F.coalesce("c", F.lit("")), F.lit("</csdf><csdfProperties>"), "t", F.lit("</csdfProperties></applicationGraph></sdf3>")).alias("value"))


def to_text(actors: DataFrame, channels: DataFrame) -> DataFrame:
    """(graph_id, part, value): lines of actors and first times, then of channels with first rates and tokens."""
    first = lambda c: F.get(c, F.lit(0)).cast("string")
    return actors.select("graph_id", F.lit(0).alias("part"), F.concat_ws(" ", "actor", first("wcet")).alias("value")).union(channels.select("graph_id", F.lit(1), F.concat_ws(" ", "src", "dst", first("production"), first("consumption"), F.col("tokens").cast("string"))))


def to_dimacs(edges: DataFrame, nodes: int, number: int) -> DataFrame:
    """(ord, value): a problem line and an arc line for each edge (src, dst, weight)."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, f"p sp {nodes} {number}")], "ord int, value string")
    return head.union(edges.select(F.lit(1), F.concat_ws(" ", F.lit("a"), F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string"))))


#: How a node of each type is drawn, unless the caller says otherwise.
STYLES = {"actor": "ellipse", "scope": "rectangle", "memory": "diamond"}


def to_gml(nodes: DataFrame, edges: DataFrame, styles: dict[str, str] | None = None) -> DataFrame:
    """(part, value): lines of a GML graph: nodes (id, label, type) with the shape of their type, then edges (src, dst)."""
    shape = F.lit("rectangle")
    for kind, name in (styles or STYLES).items():
        shape = F.when(F.col("type") == kind, name).otherwise(shape)
    n = F.concat(F.lit("node [ id "), F.col("id").cast("string"), F.lit(' label "'), F.regexp_replace("label", '"', "'"), F.lit('" graphics [ type "'), shape, F.lit('" ] ]'))
    e = F.concat(F.lit("edge [ source "), F.col("src").cast("string"), F.lit(" target "), F.col("dst").cast("string"), F.lit(" ]"))
    return nodes.select(F.lit(0).alias("part"), n.alias("value")).union(edges.select(F.lit(1), e))


def to_dot(edges: DataFrame) -> DataFrame:
    """(value): edge lines of a DOT graph."""
    return edges.select(F.concat(F.lit('"'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("value"))
