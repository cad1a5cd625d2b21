"""Listings, scopes, annotations, feature headers, training tables and energy logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.exprs import four_hex


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of text files; the file is the folder file=... that write_files makes, else the file's name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select((F.col("file").cast("string") if "file" in rows.columns else F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("file"), "value")


def write_files(texts: DataFrame, path: str) -> None:
    """A text file for each (file, value), in a folder of its own."""
    texts.write.partitionBy("file").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ln, line) of text files, numbered from 1."""
    return whole_files(spark, path).select("file", F.posexplode(F.split("value", "\n")).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)


def listing(lines: DataFrame) -> DataFrame:
    """(file, ln, marker, is_instruction) of assembly listings: `N:file` lines mark a source line; instructions have a four-digit
    hexadecimal address as their second word."""
    words = F.split(F.trim("line"), r"\s+")
    return lines.select("file", "ln", F.regexp_extract("line", r"^\s*(\d+):\S*", 1).try_cast("int").alias("marker"), (F.size(words) > 1).__and__(four_hex(F.coalesce(F.get(words, F.lit(1)), F.lit("")))).alias("is_instruction"))


def read_scopes(spark: SparkSession, path: str) -> DataFrame:
    """(file, scope_id, lstart, lend) of the braces of C texts, by a stack; scopes are numbered by their closing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in b[["file", "value"]].itertuples(index=False):
                stack: list[int] = []
                number = 0
                for ln, line in enumerate(text.split("\n"), 1):
                    for c in line:
                        if c == "{":
                            stack.append(ln)
                        elif c == "}" and stack:
                            rows.append((file, number, stack.pop(), ln))
                            number += 1
            yield pd.DataFrame(rows, columns=["file", "scope_id", "lstart", "lend"])

    return whole_files(spark, path).mapInPandas(run, "file string, scope_id int, lstart int, lend int")


def scope_json(scopes: list[dict]) -> list[dict]:
    """The nested tree of one file's scopes (scope_id, parent_id, name, weight, lstart, lend), in line order."""
    below: dict = {}
    for s in sorted(scopes, key=lambda s: s["lstart"]):
        below.setdefault(s["parent_id"], []).append(s)

    def tree(parent) -> list[dict]:
        return [{"name": s["name"], "weight": s["weight"], "lstart": s["lstart"], "lend": s["lend"], "scopes": tree(s["scope_id"])} for s in below.get(parent, [])]

    return tree(None)


def scope_trees(scopes: DataFrame) -> DataFrame:
    """(file, value): each file's tree as one JSON text, children in line order."""
    import json

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [{"scope_id": int(r.scope_id), "parent_id": None if pd.isna(r.parent_id) else int(r.parent_id), "name": r.name_, "weight": int(r.weight), "lstart": int(r.lstart), "lend": int(r.lend)} for r in rows.rename(columns={"name": "name_"}).sort_values(["lstart", "scope_id"]).itertuples()]
        return pd.DataFrame({"file": [key[0]], "value": [json.dumps(scope_json(own), separators=(",", ":"))]})

    return scopes.groupBy("file").applyInPandas(group, "file string, value string")


ANNOTATIONS = (
    "pragmas array<struct<code:string,endCol:int,endLine:int,len:int,pragma:string,pragmaLine:int,start:int,startCol:int,startLine:int,"
    "funInfo:struct<funName:string,paramPos:array<struct<varName:string,varPos:int>>,pragmaPos:array<struct<parName:string,parPosPragma:int>>>>>,"
    "calls array<struct<fun:string,line:int,args:array<struct<varName:string,varPos:int>>>>"
)
CHANGES = "code string, fileName string, fileDir string, changes array<struct<idChange:int,ruleName:string,line:int,oldCode:string,newCode:string,newCodeAll:string>>"


def annotations(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pragmas, calls) of annotation documents (file, value); a pragma's kind is its second word, repeat its third."""
    doc = texts.select("file", F.from_json("value", ANNOTATIONS, {"mode": "FAILFAST"}).alias("d"))
    p = doc.select("file", F.posexplode("d.pragmas").alias("scope_id", "p"))
    words = F.split(F.trim("p.pragma"), r"\s+")
    pragmas = p.select("file", "scope_id", F.col("p.startLine").alias("lstart"), F.col("p.endLine").alias("lend"), "p.pragma", F.upper(F.get(words, F.lit(0))).alias("kind"), "p.funInfo.funName", F.col("p.funInfo.paramPos").alias("params"), F.col("p.funInfo.pragmaPos").alias("names"))
    return pragmas, doc.select("file", F.explode("d.calls").alias("c")).select("file", "c.fun", "c.line", "c.args")


def changes(texts: DataFrame) -> DataFrame:
    """(file, id_change, rule, line, old_code, new_code) of candidate lists (value)."""
    return texts.select(F.from_json("value", CHANGES, {"mode": "FAILFAST"}).alias("d")).select(F.col("d.fileName").alias("file"), F.explode("d.changes").alias("c")).select("file", F.col("c.idChange").alias("id_change"), F.col("c.ruleName").alias("rule"), "c.line", F.col("c.oldCode").alias("old_code"), F.col("c.newCode").alias("new_code"))


def change_coverage(found: DataFrame) -> DataFrame:
    """Candidates and lines of each rule."""
    return found.groupBy("rule").agg(F.count("*").alias("candidates"), F.countDistinct("file", "line").alias("lines"))


def feature_headers(texts: DataFrame) -> DataFrame:
    """(file, test, label, rule, func) of source texts (file, value) with header comments; label is null where absent."""
    get = lambda key, rest: F.regexp_extract("value", rf"//\s*{key}\s*:\s*{rest}", 1)
    vector = F.transform(F.split(get("TEST_VECTOR", r"\[([^\]]*)\]"), r"\s*,\s*"), lambda x: F.trim(x).try_cast("int"))
    return texts.select("file", F.when(get("TEST_VECTOR", r"\[([^\]]*)\]") != "", vector).alias("test"), get("TEST_LABEL", r"(-?\d+)").try_cast("int").alias("label"), F.nullif(F.trim(get("RULE_APPLD", r"([^\n]*)")), F.lit("")).alias("rule"), F.nullif(F.trim(get("FUNC_ANALYZ", r"([^\n]*)")), F.lit("")).alias("func"))


HEADERS = ("Rule Names", "Abst.-State mappings", "Init. States", "Final States", "Transition Table")  # fixed values of the format


def training_table(texts: DataFrame) -> dict[str, DataFrame]:
    """Rules, states, init, final and transitions of sectioned training texts (file, value), one or many, each with its file.

    A line that is no list or map names the section of those after it; lists and maps are parsed in columns."""
    split = texts.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    own = Window.partitionBy("file").orderBy("pos")  # a file's lines
    data = F.substring("line", 1, 1).isin("[", "{")
    lines = split.withColumn("section", F.last(F.when(~data, F.col("line")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(data)

    def parsed(section: str, kind: str) -> DataFrame:
        return lines.where(F.col("section") == section).select("file", "pos", F.from_json("line", kind).alias("v"))

    rules, states, init, final = (parsed(h, k) for h, k in zip(HEADERS, ("array<string>", "map<string,int>", "array<int>", "array<int>")))
    state = (F.row_number().over(own) - 1).alias("state")
    return {
        "rules": rules.select("file", F.posexplode("v").alias("action", "name")),
        "states": states.select("file", F.explode("v").alias("key", "state")).select("file", "state", "key"),
        "init": init.select("file", F.explode("v").alias("state")),
        "final": final.select("file", F.explode("v").alias("state")),
        "transitions": parsed(HEADERS[4], "array<int>").select("file", state, "v").select("file", "state", F.posexplode("v").alias("action", "next_state")),
    }


def training_text(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, value): the texts of what training_table gives; a file's table is one text."""
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    rules = tables["rules"].groupBy("file").agg(listed(F.transform(ordered("action", quoted("name").alias("n")), lambda x: x["n"])).alias("text"))
    pair = F.concat(quoted("key"), F.lit(": "), F.col("state").cast("string")).alias("p")
    states = tables["states"].groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.transform(ordered("state", pair), lambda x: x["p"]), ", "), F.lit("}")).alias("text"))
    init, final = (tables[n].groupBy("file").agg(listed(F.array_sort(F.collect_list("state")).cast("array<string>")).alias("text")) for n in ("init", "final"))
    rows = tables["transitions"].groupBy("file", "state").agg(listed(F.transform(ordered("action", "next_state"), lambda x: x["next_state"].cast("string"))).alias("row"))
    moves = rows.groupBy("file").agg(F.array_join(F.transform(ordered("state", "row"), lambda x: x["row"]), "\n").alias("text"))
    found = None
    for i, part in enumerate((rules, states, init, final, moves)):
        part = part.select("file", F.lit(i).alias("i"), F.concat(F.lit(HEADERS[i] + "\n"), "text", F.lit("\n")).alias("text"))
        found = part if found is None else found.union(part)
    return found.groupBy("file").agg(F.array_join(F.transform(ordered("i", "text"), lambda x: x["text"]), "\n").alias("value"))


ENERGY = "t_ms long, " + ", ".join(f"{q}_{r} double" for r in ("mem", "gpu", "a7", "a15") for q in ("v", "a", "w"))


def read_energy(spark: SparkSession, path: str, schema: str = ENERGY, separator: str = ",", header: bool = False) -> DataFrame:
    """Samples of a sensor log with these columns; spark.readStream takes the same format."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).csv(path)


def write_energy(samples: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    samples.write.option("sep", separator).option("header", header).csv(path)
