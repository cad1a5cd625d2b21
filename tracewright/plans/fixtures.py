"""Small graphs, vectors and tables with known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators.graph import with_reverse

#: Example graphs: actors with times; channels with rates, tokens and capacity.
GRAPHS = {
    "csdf": ([("a", [1, 1]), ("b", [2, 3]), ("c", [3, 2, 1])], [("a", "b", [1, 2], [1, 1], 0, 3), ("b", "c", [1, 1], [1, 0, 1], 0, 2), ("c", "c", [1, 1, 1], [1, 1, 1], 1, None), ("b", "b", [1, 1], [1, 1], 1, None)]),
    "mrsdf": ([("a", [5]), ("b", [2]), ("c", [1])], [("a", "b", [2], [3], 0, 4), ("b", "c", [4], [5], 0, 60)]),
    "hsdf": ([("v0", [1]), ("v1", [2]), ("v2", [1])], [("v0", "v1", [1], [1], 0, 2), ("v0", "v2", [1], [1], 0, 2), ("v2", "v1", [1], [1], 0, 2), ("v1", "v1", [1], [1], 1, None)]),
    "cycle3": ([("1", [1]), ("2", [1]), ("3", [1])], [("1", "2", [3], [5], 0, None), ("2", "3", [5], [2], 0, None), ("3", "1", [2], [3], 17, None)]),
}
REPETITION = [("csdf", "a", True, 4, 36), ("csdf", "b", True, 6, 36), ("csdf", "c", True, 9, 36), ("mrsdf", "a", True, 15, 120), ("mrsdf", "b", True, 10, 120), ("mrsdf", "c", True, 8, 120), ("hsdf", "v0", True, 1, 1), ("hsdf", "v1", True, 1, 1), ("hsdf", "v2", True, 1, 1), ("cycle3", "1", True, 10, 30), ("cycle3", "2", True, 6, 30), ("cycle3", "3", True, 15, 30)]
EXPANSION = [("csdf", 19, 40), ("mrsdf", 33, 43), ("hsdf", 3, 7), ("cycle3", 31, 31)]
PERIODS = [("csdf", 18, 1, False), ("mrsdf", 70, 1, False), ("hsdf", 2, 1, False), ("cycle3", 6, 1, False)]
SCALES = [("csdf", "a", "b", 6), ("csdf", "b", "a", 6), ("csdf", "b", "c", 6), ("csdf", "c", "b", 6), ("csdf", "c", "c", 4), ("csdf", "b", "b", 6), ("mrsdf", "a", "b", 4), ("mrsdf", "b", "a", 4), ("mrsdf", "b", "c", 3), ("mrsdf", "c", "b", 3), ("cycle3", "1", "2", 1), ("cycle3", "2", "3", 1), ("cycle3", "3", "1", 1)] + [("hsdf", u, v, 1) for u, v in (("v0", "v1"), ("v1", "v0"), ("v0", "v2"), ("v2", "v0"), ("v2", "v1"), ("v1", "v2"), ("v1", "v1"))]

#: Weighted graphs (src, dst, weight, tokens).
WEIGHTED = {
    "m1": [(1, 2, 1, 1), (2, 4, 1, 0), (2, 6, 2, 0), (4, 1, 1, 0), (4, 6, 1, 0), (5, 3, 4, 1), (5, 4, 2, 0), (6, 5, 1, 1), (3, 1, 10, 1), (3, 4, 3, 1)],
    "m2": [(1, 2, 4, 1), (2, 3, 1, 1), (1, 1, 9, 2), (2, 2, 7, 2), (3, 3, 7, 2), (3, 2, 5, 1), (2, 1, 8, 2), (1, 3, 7, 1)],
    "m3": [(1, 2, 1, 0), (2, 3, 2, 1), (3, 4, 3, 0), (4, 5, 4, 0), (5, 6, 2, 0), (6, 7, 3, 1), (7, 1, 1, 0), (2, 7, 5, 1), (2, 8, 1, 0), (4, 8, 4, 0), (8, 6, 1, 0), (8, 3, 0, 1), (8, 7, 3, 1)],
}
WEIGHTED["m2neg"] = [(u, v, -w, t) for u, v, w, t in WEIGHTED["m2"]]
WEIGHTED["dead"] = [(1, 2, 1, 0), (2, 1, 1, 0)]
WEIGHTED["dag"] = [(1, 2, 1, 1)]
RATIOS = [("m1", 9, 2, False), ("m2", 5, 1, False), ("m2neg", -3, 1, False), ("m3", 8, 1, False), ("dead", None, None, True), ("dag", None, None, False)]

#: The greedy action of each state of the training table; the goal is state 22.
GREEDY = (4, 5, 4, 5, 4, 5, 7, 7, 7, 10, 10, 10, 13, 0, 13, 0, 13, 0, 5, 14, 5, 5)
RULES = 17

HEADERS = [("test09", [0] * 15 + [3] + [0] * 7, [0] * 23), ("same", [1] * 23, [1] * 23)]
CHANGES = '{"code": "x", "fileName": "f.c", "fileDir": ".", "changes": [{"idChange": 0, "ruleName": "inlining", "line": 3, "oldCode": "a", "newCode": "b", "newCodeAll": "b"}, {"idChange": 1, "ruleName": "inlining", "line": 3, "oldCode": "a", "newCode": "c", "newCodeAll": "c"}, {"idChange": 2, "ruleName": "roll_up", "line": 9, "oldCode": "d", "newCode": "e", "newCodeAll": "e"}]}'
ROLL_UP_SCHEMA = "file string, scope_id int, parent_id int, kind string, own long, repeat string"
ROLL_UP = [("f", 0, None, "NONE", 2, None), ("f", 1, 0, "MAP", 3, "n"), ("f", 2, 1, "ITN", 1, "10"), ("f", 3, 2, "NONE", 5, None), ("f", 4, 0, "MEMALLOC", 0, None)]
# 2 + (3 + n (1 + 10 * 5)) + os_call
ROLL_UP_SQL = "SELECT * FROM (VALUES ('f', 0, '1', 5), ('f', 0, 'n', 51), ('f', 0, 'os_call', 1), ('f', 1, '1', 3), ('f', 1, 'n', 51), ('f', 2, '1', 51), ('f', 3, '1', 5), ('f', 4, 'os_call', 1)) t(file, scope_id, term, c)"


def golden_sql(names: str, rows: list[tuple]) -> str:
    def text(x) -> str:
        return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def graphs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    actors = spark.createDataFrame([(g, a, w) for g, (own, _) in GRAPHS.items() for a, w in own], "graph_id string, actor string, wcet array<bigint>")
    channels = spark.createDataFrame([(g, *c) for g, (_, own) in GRAPHS.items() for c in own], "graph_id string, src string, dst string, production array<bigint>, consumption array<bigint>, tokens bigint, capacity bigint")
    return actors, with_reverse(channels)


def weighted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, *e) for g, own in WEIGHTED.items() for e in own], "graph_id string, src int, dst int, weight bigint, tokens bigint")


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(s, a, s + 1 if s < len(GREEDY) and GREEDY[s] == a else s) for s in range(len(GREEDY) + 1) for a in range(RULES)]
    return spark.createDataFrame(rows, "state int, action int, next_state int")
