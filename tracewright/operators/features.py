"""Feature vectors of code, transition tables and policies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import checkpointed

#: Features by place.
FEATURES = ("max_loop_depth", "calls", "shifted_writes", "irregular_loops", "globals", "ifs", "static_limits", "simd_loops", "schedules", "invariants", "hoisted", "non_1d_arrays", "aux_index_vars", "for_loops", "non_unit_steps", "roll_ups", "compounds", "ternaries", "useless_statements", "postambles", "preambles", "struct_vars", "empty_ifs")


MOST_RULES = 10_000


def named(vectors: DataFrame, column: str = "feat") -> DataFrame:
    """Vectors with a column for each feature."""
    return vectors.select("*", *[F.get(column, F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])


def mismatches(headers: DataFrame) -> DataFrame:
    """M9: (file, idx, expected, found) where the measured vector differs from the header's."""
    pairs = headers.select("file", F.posexplode(F.arrays_zip("test", "feat")).alias("idx", "p"))
    return pairs.where("not (p.test <=> p.feat)").select("file", "idx", F.col("p.test").alias("expected"), F.col("p.feat").alias("found"))


def transitions(steps: DataFrame, sequence: str, step: str, state: str, rule: str, initial: str) -> DataFrame:
    """(prev_state, rule, state) of consecutive steps; the first one's previous state is its sequence's initial state."""
    w = Window.partitionBy(sequence).orderBy(step)
    return steps.select(F.coalesce(F.lag(state).over(w), F.col(initial)).alias("prev_state"), F.col(rule).alias("rule"), F.col(state).alias("state"))


def transition_table(moves: DataFrame, states: DataFrame, rules: DataFrame) -> DataFrame:
    """M5: (state, action, next_state) for every state and rule, the state itself where no move is known. states x rules is the
    table's own size; the rules are a fixed catalogue of MOST_RULES at most."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = moves.groupBy(F.col("prev_state").alias("state"), F.col("rule").alias("action")).agg(F.max("state").alias("next_state"))
    return states.select("state").crossJoin(F.broadcast(rules.select("action"))).join(known, ["state", "action"], "left").withColumn("next_state", F.coalesce("next_state", "state"))


def first_argmax(q: DataFrame, key: str, action: str, value: str) -> DataFrame:
    """The first action among those of the largest value."""
    return q.groupBy(key).agg(F.max_by(action, F.struct(F.col(value), -F.col(action))).alias(action))


def greedy(table: DataFrame, q: DataFrame, goals: Sequence[int], applicable: DataFrame | None = None) -> DataFrame:
    """(state, action, next_state): the best applicable rule by q; goal states have none."""
    own = q.where(~F.col("state").isin(list(goals)))
    if applicable is not None:
        own = own.join(applicable.select("state", "action"), ["state", "action"], "left_semi")
    return first_argmax(own, "state", "action", "q").join(table, ["state", "action"])


def value_iteration(table: DataFrame, goals: Sequence[int], reward: float = 100000.0, discount: float = 0.9, most_rounds: int = 200) -> DataFrame:
    """M6: (state, action, q) by rounds of q = [next is goal] * reward + discount * max q(next), a deterministic stand-in for sampled
    training with the same greedy policy. Stops when no q changes."""
    goal = F.col("next_state").isin(list(goals))
    gain = F.when(goal & ~F.col("state").isin(list(goals)), reward).otherwise(0.0)
    q = checkpointed(table.withColumn("q", gain))
    for i in range(most_rounds):
        best = q.groupBy("state").agg(F.max("q").alias("v")).withColumnRenamed("state", "next_state")
        new = q.drop("v").join(best, "next_state", "left").withColumn("new", gain + F.when(goal, 0.0).otherwise(discount * F.coalesce("v", F.lit(0.0))))
        new = checkpointed(new.select("state", "action", "next_state", "q", "new")) if i % 5 == 4 else new.select("state", "action", "next_state", "q", "new")
        if i % 5 == 4 and new.where("abs(new - q) > 1e-9").isEmpty():
            return new.select("state", "action", F.col("new").alias("q"))
        q = new.select("state", "action", "next_state", F.col("new").alias("q"))
    raise RuntimeError(f"values did not settle in {most_rounds} rounds")


def sampled_values(table: DataFrame, init: Sequence[int], goals: Sequence[int], episodes: int = 1500, interactions: int = 600, reward: float = 100000.0, discount: float = 0.9, rate: float = 0.2, explore: float = 0.2, seed: int = 0) -> DataFrame:
    """M6: (state, action, q) by sampled training: in each step an action is drawn (now and then any, else the best so far), and its value moves
    towards the reward and the value of the next state's drawn action; at a goal an episode goes on from a drawn initial state. Values start at 1.

    One learner follows one sequence of steps, so it is one task; its table has a row for each state and rule. Settled episodes (no best
    action changed in 50 of them) end the training."""
    schema = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("state", "action")) + ", q double"
    inits, ends = list(init), set(goals)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        states, actions = sorted(set(rows["state"]) | set(rows["next_state"])), sorted(set(rows["action"]))
        at = {s: i for i, s in enumerate(states)}
        after = np.full((len(states), len(actions)), -1)
        place = {a: i for i, a in enumerate(actions)}
        for s, a, n in rows[["state", "action", "next_state"]].itertuples(index=False):
            after[at[s], place[a]] = at[n]
        q = np.where(after >= 0, 1.0, -np.inf)
        goal = np.array([s in ends for s in states])
        starts = np.array([at[s] for s in inits])
        known = [np.flatnonzero(r >= 0) for r in after]

        def draw(s: int) -> int:
            if len(known[s]) == 0:
                return -1
            if rng.random() < explore:
                return int(known[s][rng.integers(len(known[s]))])
            best = np.flatnonzero(q[s] == q[s].max())
            return int(best[rng.integers(len(best))])

        same, was = 0, None
        for _ in range(episodes):
            s = int(starts[rng.integers(len(starts))])
            a = draw(s)
            for _ in range(interactions):
                if a < 0:
                    break
                n = int(after[s, a])
                if goal[n]:
                    q[s, a] += rate * (reward - q[s, a])
                    s = int(starts[rng.integers(len(starts))])
                    a = draw(s)
                    continue
                b = draw(n)
                q[s, a] += rate * (discount * (q[n, b] if b >= 0 else 0.0) - q[s, a])
                s, a = n, b
            now = tuple(np.argmax(q, axis=1))
            same, was = (same + 1 if now == was else 0), now
            if same >= 50:
                break
        return pd.DataFrame([(s, a, float(q[at[s], place[a]])) for s, a in rows[["state", "action"]].itertuples(index=False)], columns=["state", "action", "q"])

    return table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, schema)


def choose_change(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """M8: the first candidate (state, rule, id_change, result) whose rule and resulting state are the predicted ones (state, rule, next_state)."""
    hit = changes.join(wanted, ["state", "rule"]).where("result = next_state")
    return hit.groupBy("state").agg(F.min("id_change").alias("id_change"))


def decision_tree(vectors: DataFrame, features: str = "feat", label: str = "label", depth: int = 30):
    """M3: a gini tree."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(rows)


def tree_rows(spark, model, names: Sequence[str]) -> DataFrame:
    """M4: (node, condition, prediction, yes, no) of a fitted tree: nodes are numbered from the root, left ways first; leaves have no condition."""
    rows = []

    def walk(node) -> int:
        own = len(rows)
        rows.append(None)
        if node.subtreeDepth() == 0:
            rows[own] = (own, None, float(node.prediction()), None, None)
            return own
        split = node.split()
        yes, no = walk(node.leftChild()), walk(node.rightChild())
        rows[own] = (own, f"{names[split.featureIndex()]} <= {split.threshold()}", float(node.prediction()), yes, no)
        return own

    walk(model._call_java("rootNode"))
    return spark.createDataFrame(rows, "node int, condition string, prediction double, yes int, no int")


def lexical_features(code: Column) -> dict[str, Column]:
    """M1 as far as text shows it, of C code without a parser: counts of loops, ifs, ternaries, compound assignments, empty ifs, steps
    other than one and arrays of more dimensions, the deepest nesting of braces, and calls."""
    plain = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/|//[^\n]*", " "), r'"(\\.|[^"\\])*"', '""')

    def count(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))

    depth = F.aggregate(F.regexp_extract_all(plain, F.lit(r"[{}]"), F.lit(0)), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct((s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("m")), lambda s: s["m"])
    return {
        "for_loops": count(r"\bfor\s*\("), "ifs": count(r"\bif\s*\("), "ternaries": count(r"\?[^:?;]*:"), "compounds": count(r"[-+*/%&|^]="),
        "empty_ifs": count(r"\bif\s*\([^(){};]*\)\s*(?:;|\{\s*\})"), "non_1d_arrays": count(r"\w\s*\[[^\[\]]*\]\s*\["), "schedules": count(r"schedule\s*\("),
        "non_unit_steps": count(r"\bfor\s*\([^;]*;[^;]*;[^;)]*[-+]=\s*(?!1\s*\))"), "struct_vars": count(r"\bstruct\s+\w+\s+\w+\s*[;=,\[]"), "brace_depth": depth,
        "calls": count(r"\b(?!(?:if|for|while|switch|return|sizeof)\b)[A-Za-z_]\w*\s*\(") - count(r"\b(?:int|void|float|double|char|long|unsigned|short)\s*\*?\s+\*?[A-Za-z_]\w*\s*\("),
    }
