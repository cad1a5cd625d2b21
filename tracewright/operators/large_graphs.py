"""Exact analyses of one dataflow graph that is as large as a table: G1, G2 repetition vectors; G14, G15 maximum cycle ratios; G4 short cycles.

Every step is a join by node and an aggregate, kept in tables of the shared folder. No node's channels are gathered."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.exprs import gcd
from tracewright.operators.graph import strong_components
from tracewright.session import broadcast_within, checkpointed

# rates as maps of prime exponents ---------------------------------------------------------------------------------------

FACTORS = "map<bigint, int>"


def factors_of(n: int) -> list[tuple[int, int]]:
    out, p = [], 2
    while p * p <= n:
        e = 0
        while n % p == 0:
            n, e = n // p, e + 1
        if e:
            out.append((p, e))
        p += 1 + (p > 2)
    return [*out, (n, 1)] if n > 1 else out


def times(a: Column, b: Column, sign: int = 1) -> Column:
    """The product (quotient, if sign is -1) of two numbers as maps of prime exponents."""
    added = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.lit(sign) * F.coalesce(y, F.lit(0)))
    return F.map_filter(added, lambda _, e: e != 0)


def inverse(a: Column) -> Column:
    return F.transform_values(a, lambda _, e: -e)


def same(a: Column, b: Column) -> Column:
    return F.size(times(a, b, -1)) == 0


def factored(rates: DataFrame) -> DataFrame:
    """(rate, factors) of distinct positive rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([factors_of(n) for n in b.column(0).to_pylist()], pa.map_(pa.int64(), pa.int32()))], ["rate", "factors"])

    return rates.select(F.col("rate").cast("long").alias("rate")).distinct().mapInArrow(run, f"rate long, factors {FACTORS}")


def written(numbers: DataFrame, column: str, name: str) -> DataFrame:
    """numbers with the whole number of a map of exponents as decimal digits, however many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for m in b.column(b.schema.get_field_index(column)).to_pylist():
                n = 1
                for p, e in m:
                    n *= p**e
                values.append(str(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], [*b.schema.names, name])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.schema)
    return numbers.mapInArrow(run, f"{kinds}, {name} string")


# repetition vectors -----------------------------------------------------------------------------------------------------


def scaled_components(edges: DataFrame, factors: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root, scale): for edges (a, b, n, d), where b is a times n / d, each node's own scale against its component's smallest node, as a map of
    exponents; factors: (rate, factors) of all n and d.

    A forest by rounds: every root hooks to its smallest neighbour if that is smaller, chains of hooks are followed by doubling, products taken on
    the way, and edges move to the roots. Which of several edges hooks two roots doesn't matter where the graph is consistent. Edges keep their own
    ends and rates; maps are made for the hooks only, of which a root has one."""
    ways = edges.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), "n", "d")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    one = F.create_map().cast(FACTORS)
    label = checkpointed(nodes.select("node", F.col("node").alias("root"), one.alias("scale")))

    def downward(rows: DataFrame) -> DataFrame:  # from the larger root to the smaller one
        turned = F.col("a") < F.col("b")
        pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        return rows.where("a <> b").select(*[pick(x, y) for x, y in (("a", "b"), ("b", "a"), ("u", "v"), ("v", "u"), ("n", "d"), ("d", "n"))])

    rate = lambda c: factors.select(F.col("rate").alias(c), F.col("factors").alias(f"_{c}"))
    at = lambda c: label.select(F.col("node").alias(c), F.col("scale").alias(f"_{c}"))
    ways = checkpointed(downward(ways))
    for _ in range(most_rounds):
        if ways.isEmpty():
            return label
        # up to one hook for each root; root = up * scale
        hook = ways.groupBy(F.col("a").alias("root")).agg(F.min_by(F.struct(F.col("b").alias("up"), "u", "v", "n", "d"), F.col("b")).alias("h")).select("root", "h.*")
        # v = u * n / d, u = root * x, v = up * y: root = up * (y / x) / (n / d)
        hook = hook.join(at("u"), "u").join(at("v"), "v").join(rate("n"), "n").join(rate("d"), "d")
        hook = checkpointed(hook.select("root", "up", times(times(F.col("_v"), F.col("_u"), -1), times(F.col("_d"), F.col("_n"), -1)).alias("scale")))
        while True:  # twice as far each time
            far = hook.select(F.col("root").alias("up"), F.col("up").alias("_up"), F.col("scale").alias("_scale"))
            moved = hook.join(far, "up", "left").select("root", F.coalesce("_up", "up").alias("up"), F.when(F.col("_up").isNull(), F.col("scale")).otherwise(times(F.col("scale"), F.col("_scale"))).alias("scale"), F.col("_up").isNotNull().alias("moved"))
            new = checkpointed(moved, None, [hook])
            hook = new
            if new.where("moved").isEmpty():
                break
            hook = new.drop("moved")
        to = hook.select(F.col("root").alias("_root"), "up", F.col("scale").alias("_scale"))
        label = checkpointed(label.join(to, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("up", "root").alias("root"), F.when(F.col("up").isNull(), F.col("scale")).otherwise(times(F.col("scale"), F.col("_scale"))).alias("scale")), None, [label])
        end = lambda c: hook.select(F.col("root").alias(c), F.col("up").alias(f"_{c}"))
        moved = ways.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "u", "v", "n", "d")
        ways = checkpointed(downward(moved), None, [ways])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def repetition_of_one(channels: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """(actor, component, consistent, q) of channels (src, dst, production, consumption), positive whole numbers.

    Actors of any number of connected components; q: the smallest whole numbers with q(src) production = q(dst) consumption on every channel, as
    digits; null in an inconsistent component. Rates are exact at any length of path: products are kept as exponents of primes."""
    rates = broadcast_within(checkpointed(factored(channels.select(F.col("production").alias("rate")).union(channels.select("consumption")))), most_broadcast)
    rates = rates.select(F.col("rate").cast("long").alias("rate"), "factors")
    edges = checkpointed(channels.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("production").cast("long").alias("n"), F.col("consumption").cast("long").alias("d")).distinct())
    label = scaled_components(edges, rates)
    # equal scales are one number, so that channels are held against each other's scales by numbers, and each case is looked at once
    key = F.array_sort(F.map_entries("scale"))
    kinds = checkpointed(label.select(key.alias("key"), "scale").groupBy("key").agg(F.any_value("scale").alias("scale")).withColumn("kind", F.monotonically_increasing_id()))
    told = checkpointed(label.select("node", "root", key.alias("key")).join(kinds, "key").select("node", "root", "kind"))
    a, b = told.select(F.col("node").alias("a"), "root", F.col("kind").alias("ka")), told.select(F.col("node").alias("b"), F.col("kind").alias("kb"))
    cases = edges.join(a, "a").join(b, "b").select("root", "ka", "kb", "n", "d").distinct()
    for c in ("ka", "kb"):
        cases = cases.join(kinds.select(F.col("kind").alias(c), F.col("scale").alias(f"_{c}")), c)
    for c in ("n", "d"):
        cases = cases.join(rates.select(F.col("rate").alias(c), F.col("factors").alias(f"_{c}")), c)
    wrong = cases.where(~same(times(F.col("_ka"), F.col("_n")), times(F.col("_kb"), F.col("_d")))).select("root").distinct()
    # an exponent is lowered by the component's least one; an actor without the prime counts as 0
    each = label.select("root", F.explode("scale").alias("prime", "e"))
    sizes = label.groupBy("root").agg(F.count("*").alias("n"))
    least = each.groupBy("root", "prime").agg(F.min("e").alias("e"), F.count("*").alias("with")).join(sizes, "root")
    least = least.select("root", "prime", F.when(F.col("with") < F.col("n"), F.least("e", F.lit(0))).otherwise(F.col("e")).alias("e")).where("e <> 0")
    least = checkpointed(least.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("prime", "e"))).alias("least")))  # primes of rates
    none = F.create_map().cast(FACTORS)
    whole = label.join(least, "root", "left").join(checkpointed(wrong.withColumn("wrong", F.lit(True))), "root", "left")
    whole = whole.select(F.col("node").alias("actor"), F.col("root").alias("component"), F.col("wrong").isNull().alias("consistent"), times(F.col("scale"), F.coalesce("least", none), -1).alias("factors"))
    return written(whole, "factors", "q").select("actor", "component", "consistent", F.when(F.col("consistent"), F.col("q")).alias("q"))


# maximum cycle ratios -----------------------------------------------------------------------------------------------------

KEY = 10**18  # ratios' keys are told apart where two denominators' product is no more than this
NEVER = Decimal(-(10**37))  # the key of what reaches no cycle


def ratio_key(w: Column, t: Column) -> Column:
    """The floor of w / t in units of 1 / KEY: different for different ratios whose t are 10^9 at most."""
    rest = F.pmod(w, F.nullif(t, F.lit(0)))
    whole = F.call_function("div", w - rest, F.nullif(t, F.lit(0))).cast("decimal(19,0)")
    part = F.call_function("div", rest.cast("decimal(18,0)") * F.lit(KEY).cast("decimal(19,0)"), F.nullif(t, F.lit(0)))
    return (whole * F.lit(KEY).cast("decimal(19,0)") + part.cast("decimal(19,0)")).cast("decimal(38,0)")


def cycles_of(policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For links (node, next, w, t), one for each node: (node, root, w, t), how far each is from the root of the cycle that it ends in, and the cycles
    (root, w, t). Roots are their cycles' smallest nodes. Steps are doubled until all have come to cycles, and then until all have seen them whole."""

    def doubled(at: DataFrame) -> DataFrame:
        ahead = at.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        return at.join(ahead, "next").select("node", F.col("_next").alias("next"), F.least("least", "_least").alias("least"))

    at = checkpointed(policy.select("node", "next", F.col("node").alias("least")))
    held, seen = None, None
    while True:
        at = checkpointed(doubled(doubled(at)), None, [at])
        ends = at.select("next").distinct()
        on = at.join(ends.withColumnRenamed("next", "node"), "node", "left_semi")
        now = on.agg(F.count("*"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)"))).first()
        held, seen = seen, tuple(now)
        if held == seen:
            break
    roots = checkpointed(on.select("node", F.col("least").alias("root")))
    cycles = checkpointed(policy.join(roots, "node").groupBy("root").agg(F.sum("w").alias("w"), F.sum("t").alias("t")))
    stop = F.col("node") == F.col("root")
    zero = F.lit(0).cast("decimal(38,0)")
    far = policy.join(roots, "node", "left").select("node", F.when(stop, F.col("node")).otherwise(F.col("next")).alias("next"), F.when(stop, zero).otherwise(F.col("w")).alias("w"), F.when(stop, zero).otherwise(F.col("t")).alias("t"), F.coalesce(stop, F.lit(False)).alias("over"))

    def farther(far: DataFrame) -> DataFrame:
        ahead = far.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("w").alias("_w"), F.col("t").alias("_t"), F.col("over").alias("_over"))
        return far.join(ahead, "next").select("node", F.col("_next").alias("next"), (F.col("w") + F.col("_w")).cast("decimal(38,0)").alias("w"), (F.col("t") + F.col("_t")).cast("decimal(38,0)").alias("t"), F.col("_over").alias("over"))

    far = checkpointed(far)
    while True:
        far = checkpointed(farther(farther(far)), None, [far])
        if far.where("not over").isEmpty():
            return far.select("node", F.col("next").alias("root"), "w", "t"), cycles


def max_cycle_ratio(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, num, den, value): for each node of edges (src, dst, weight, tokens) the largest ratio of weight to tokens among the cycles that it
    can reach, in lowest terms; null where it reaches none. Tokens of 1 make it the largest mean.

    Policy iteration, exact: each node has a link; the links' cycles and each node's way to its cycle are found by doubling; a node then takes the
    edge that leads to the best cycle, or, of equal ones, the one with the best way (den w - num t), until none is better. Then the values, of the ways
    to the cycles, prove the result: no edge has den w - num t above its source's value less its target's. A cycle without tokens is an error: nothing on it could ever start.

    A way that ends where no edge leaves is valued by its tokens: as long as a cycle has some, a node on it has an edge to a way of more tokens, until
    the links close a cycle.

    After the first round only the nodes that came to the cycle of a changed node are valued again, and only edges at them are looked at: a way
    that leaves them goes on with the value of the node that it comes to."""
    whole = "decimal(38,0)"
    own = edges.select("src", "dst", F.col("weight").cast(whole).alias("w"), F.col("tokens").cast(whole).alias("t"))
    # of parallel edges with the same tokens only the heaviest can count
    own = checkpointed(own.groupBy("src", "dst", "t").agg(F.max("w").alias("w")).select("src", "dst", "w", "t", F.lit(False).alias("stop")))
    sinks = own.select(F.col("dst").alias("node")).distinct().join(own.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    zero, one = F.lit(0).cast(whole), F.lit(1).cast(whole)
    own = checkpointed(own.union(sinks.select("node", "node", zero, one, F.lit(True))), None, [own])
    first = F.max(F.struct(F.when(F.col("t") == 0, F.col("w").cast("double")).otherwise(F.col("w").cast("double") / F.col("t")).alias("r"), "dst", "w", "t", "stop")).alias("x")
    policy = checkpointed(own.groupBy(F.col("src").alias("node")).agg(first).select("node", F.col("x.dst").alias("next"), "x.w", "x.t", "x.stop"))
    part, value, touched = policy, None, own  # links to be valued, values (node, root, num, den, key, value), edges to be looked at
    for _ in range(most_rounds):
        if value is None:
            ways, cycles = cycles_of(part.drop("stop"))
            rims = None
        else:  # nodes that ways come to and that keep their values
            ends = part.select(F.col("next").alias("node")).distinct().join(part.select("node"), "node", "left_anti")
            rims = checkpointed(value.join(ends, "node"))
            ways, cycles = cycles_of(part.drop("stop").union(rims.select("node", "node", zero, one)))
            known = rims.select(F.col("node").alias("root"))
            cycles = checkpointed(cycles.join(known, "root", "left_anti"))
        if not cycles.where("t = 0").isEmpty():
            raise ValueError("a cycle has no tokens")
        stops = part.where("stop").select(F.col("node").alias("root"), F.lit(True).alias("stop"))
        if not cycles.where(f"t > {10**9}").isEmpty():
            raise OverflowError("a cycle has too many tokens for its ratio to be told from others")
        g = gcd(F.col("w").cast("long"), F.col("t").cast("long"))
        told = cycles.join(stops, "root", "left").select("root", F.col("root").alias("home"), *[F.when(F.col("stop"), F.lit(stopped)).otherwise(F.call_function("div", F.col(c), g)).cast(whole).alias(n) for c, n, stopped in (("w", "num", -1), ("t", "den", 0))], F.when(F.col("stop"), F.lit(NEVER).cast(whole)).otherwise(ratio_key(F.col("w"), F.col("t"))).alias("key"), zero.alias("base"))
        if rims is not None:
            told = told.union(rims.select("node", "root", "num", "den", "key", "value"))
            ways = ways.join(known.withColumnRenamed("root", "node"), "node", "left_anti")
        new = ways.join(checkpointed(told), "root").select("node", F.col("home").alias("root"), "num", "den", "key", (F.col("den") * F.col("w") - F.col("num") * F.col("t") + F.col("base")).cast(whole).alias("value"))
        value = checkpointed(new if value is None else value.join(part.select("node"), "node", "left_anti").select(new.columns).union(new), None, [value] if value is not None else [])
        ahead = value.select(F.col("node").alias("dst"), F.col("key").alias("_key"), F.col("num").alias("_num"), F.col("den").alias("_den"), F.col("value").alias("_value"))
        offer = touched.join(ahead, "dst").select(F.col("src").alias("node"), "dst", "w", "t", "stop", "_key", (F.col("_den") * F.col("w") - F.col("_num") * F.col("t") + F.col("_value")).cast(whole).alias("_offer"))
        best = offer.groupBy("node").agg(F.max(F.struct("_key", "_offer", "dst", "w", "t", "stop")).alias("best"))
        better = ~F.col("best.stop") & ((F.col("best._key") > F.col("key")) | ((F.col("best._key") == F.col("key")) & (F.col("best._offer") > F.col("value"))))
        changed = checkpointed(value.join(best, "node").where(better).select("node", "root", F.col("best.dst").alias("next"), "best.w", "best.t", "best.stop"))
        if changed.isEmpty():
            reached = F.col("key") != NEVER
            return value.select("node", F.when(reached, F.col("num").cast("long")).alias("num"), F.when(reached, F.col("den").cast("long")).alias("den"), F.when(reached, F.col("value").cast("decimal(38,0)")).alias("value"))
        policy = checkpointed(policy.join(changed.select("node"), "node", "left_anti").union(changed.select(policy.columns)), None, [policy])
        stale = checkpointed(value.join(changed.select("root").distinct(), "root", "left_semi").select("node"))
        part = checkpointed(policy.join(stale, "node", "left_semi"))
        # of a node that keeps its value, the other edges were no better before
        out, into = (own.join(stale.withColumnRenamed("node", c), c, "left_semi").select(own.columns) for c in ("src", "dst"))
        touched = checkpointed(out.union(into).distinct())
    raise RuntimeError(f"policies did not settle in {most_rounds} rounds")


def reachable_ratio(edges: DataFrame, most_rounds: int = 12, block: int = 200_000) -> DataFrame:
    """(node, num, den) as of max_cycle_ratio, by strong components: all nodes of one reach the same cycles.

    A component with one edge for each node is one cycle, whose ratio is that of two sums; policies are iterated in the other ones only. Ratios then go
    from component to component against the edges between them, those that have risen only. Where components need colours to be found, or ways
    between them have more than `most_rounds` edges, policies are iterated over the whole graph, or over one node for each component."""
    whole = "decimal(38,0)"
    own = edges.select("src", "dst", F.col("weight").cast(whole).alias("weight"), F.col("tokens").cast(whole).alias("tokens"))
    # of parallel edges with the same tokens only the heaviest can count
    own = checkpointed(own.groupBy("src", "dst", "tokens").agg(F.max("weight").alias("weight")).select("src", "dst", "weight", "tokens"))
    if (found := strong_components(own, block=block, colours=False)) is None:
        return max_cycle_ratio(own).select("node", "num", "den")
    found = checkpointed(found)
    at = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    own = checkpointed(own.join(at("src", "a"), "src").join(at("dst", "b"), "dst"), None, [own])
    inside = own.where("a = b")
    parts = found.groupBy("component").agg(F.count("*").alias("nodes"))
    sums = inside.groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edges"), F.sum("weight").alias("w"), F.sum("tokens").alias("t"))
    parts = checkpointed(parts.join(sums, "component", "left"))
    cycles = parts.where("edges = nodes").withColumn("g", gcd(F.col("w").cast("long"), F.col("t").cast("long")))
    if not cycles.where("t = 0").isEmpty():
        raise ValueError("a cycle has no tokens")
    if not cycles.where(f"t > {10**9}").isEmpty():
        raise OverflowError("a cycle has too many tokens for its ratio to be told from others")

    told = cycles.select("component", F.struct(ratio_key(F.col("w"), F.col("t")).alias("key"), *[F.call_function("div", F.col(c), F.col("g")).cast(whole).alias(n) for c, n in (("w", "num"), ("t", "den"))]).alias("best"))
    many = parts.where("edges > nodes").select(F.col("component").alias("a"))
    if not many.isEmpty():
        hard = max_cycle_ratio(inside.join(many, "a", "left_semi").select("src", "dst", "weight", "tokens"))
        num, den = (F.col(c).cast(whole) for c in ("num", "den"))
        told = told.union(hard.join(found.where("node = component"), "node").select("component", F.struct(ratio_key(num, den).alias("key"), num.alias("num"), den.alias("den"))))
    best = checkpointed(parts.select("component").join(told, "component", "left"))
    between = checkpointed(own.where("a <> b").select("a", "b").distinct(), None, [own])
    risen = best.where("best is not null")
    for _ in range(most_rounds):
        offers = between.join(risen.select(F.col("component").alias("b"), F.col("best").alias("_best")), "b").groupBy(F.col("a").alias("component")).agg(F.max("_best").alias("_best"))
        better = F.col("best").isNull() | (F.col("_best.key") > F.col("best.key"))
        risen = checkpointed(best.join(offers, "component").where(better).select("component", F.col("_best").alias("best")))
        if risen.isEmpty():
            break
        best = checkpointed(best.join(risen.withColumnRenamed("best", "_best"), "component", "left").select("component", F.coalesce("_best", "best").alias("best")), None, [best])
    else:
        steps = between.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).cast(whole).alias("weight"), F.lit(1).cast(whole).alias("tokens"))
        rings = best.where("best is not null").select(F.col("component").alias("src"), F.col("component").alias("dst"), F.col("best.num").alias("weight"), F.col("best.den").alias("tokens"))
        far = max_cycle_ratio(rings.union(steps))
        best = best.select("component").join(far.where("num is not null").select(F.col("node").alias("component"), F.struct("num", "den").alias("best")), "component", "left")
    return found.join(best, "component").select("node", F.col("best.num").cast("long").alias("num"), F.col("best.den").cast("long").alias("den"))


# cycles as rows -----------------------------------------------------------------------------------------------------------


def short_cycles(edges: DataFrame, most_length: int) -> DataFrame:
    """(length, nodes) of every simple directed cycle of up to most_length edges (src, dst), from its smallest node on, each once.

    A path begins at the smallest node of its cycle and takes larger nodes only, each once; it grows by a join on its end and closes where an edge
    leads back. Rows are the paths of each length, which only such paths as could still close keep."""
    own = checkpointed(edges.select("src", "dst").distinct())
    loops = own.where("src = dst").select(F.lit(1).alias("length"), F.array("src").alias("nodes"))
    own = checkpointed(own.where("src <> dst"))
    back = own.select(F.col("src").alias("_end"), F.col("dst").alias("_first"))
    # a path's nodes are columns n1, n2, ...: its first and last ones need no columns of their own
    paths, found = own.where("src < dst").select(F.col("src").alias("n1"), F.col("dst").alias("n2")), loops
    for length in range(2, most_length + 1):
        nodes = [f"n{i}" for i in range(1, length + 1)]
        if length < most_length:
            paths = checkpointed(paths)  # read twice
        closed = paths.join(back, (F.col(nodes[-1]) == F.col("_end")) & (F.col("n1") == F.col("_first"))).select(F.lit(length).alias("length"), F.array(*nodes).alias("nodes"))
        found = found.union(closed)
        grown = paths.join(own, F.col(nodes[-1]) == F.col("src")).where(" and ".join(["dst > n1", *[f"dst <> {n}" for n in nodes[1:]]]))
        paths = grown.select(*nodes, F.col("dst").alias(f"n{length + 1}"))
    return found
