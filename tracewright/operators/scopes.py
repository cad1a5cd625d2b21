"""Code scopes: nested line intervals of files, and the cost of lines rolled up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.trace import asof, range_join
from tracewright.session import broadcast_within, checkpointed


def innermost(lines: DataFrame, scopes: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, scope_id): the shortest scope that contains each line, the first listed at ties."""
    points = lines.select("file", "line").distinct()
    hit = range_join(points, scopes.select("file", "scope_id", "lstart", "lend"), "line", "lstart", "lend", width, ["file"])
    return hit.groupBy("file", "line").agg(F.min_by("scope_id", F.struct(F.col("lend") - F.col("lstart"), "scope_id")).alias("scope_id"))


def next_scope(functions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Functions (file, line, name) with the scope that starts next after their line, the first listed at ties."""
    right = scopes.groupBy("file", F.col("lstart").alias("line")).agg(F.min("scope_id").alias("scope_id"))
    return asof(functions, right, ["file"], "line", ["scope_id"], "forward", strict=True)


def children(scopes: DataFrame) -> DataFrame:
    """(file, parent, child): a contains b iff a.lstart < b.lstart and a.lend >= b.lend; children are what nothing between contains.

    Candidates are joined by file; the parent is the candidate with the latest start, which any other one contains or
    crosses."""
    a = scopes.select("file", F.col("scope_id").alias("parent"), F.col("lstart").alias("a0"), F.col("lend").alias("a1"))
    b = scopes.select("file", F.col("scope_id").alias("child"), F.col("lstart").alias("b0"), F.col("lend").alias("b1"))
    inside = range_join(b, a, "b0", "a0", "a1", 64, ["file"]).where("a0 < b0 and a1 >= b1")
    between = inside.select("file", "child", F.col("parent").alias("p"), F.col("a0").alias("p0"), F.col("a1").alias("p1"))
    wide = inside.join(between, ["file", "child"]).where("a0 < p0 and a1 >= p1").select("file", "parent", "child").distinct()
    return inside.select("file", "parent", "child").join(wide, ["file", "parent", "child"], "left_anti")


def line_counts(listing: DataFrame, drop_trailing: bool = True) -> DataFrame:
    """A1: (file, line, n) from listing rows (file, ln, marker, is_instruction): instructions since a marker are credited to the marker
    line before the next one; the run after the last marker is dropped unless drop_trailing is off."""
    w = Window.partitionBy("file").orderBy("ln")
    seen = listing.withColumn("line", F.last("marker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("later", F.max(F.when(F.col("marker").isNotNull(), F.col("ln"))).over(Window.partitionBy("file")))
    kept = seen.where(F.col("is_instruction") & F.col("line").isNotNull())
    if drop_trailing:
        kept = kept.where(F.col("ln") < F.col("later"))
    return kept.groupBy("file", "line").agg(F.count("*").alias("n"))


def weights(counts: DataFrame, scopes: DataFrame) -> DataFrame:
    """A2: (file, scope_id, weight): line counts summed to the innermost scope; scopes without lines have 0."""
    at = counts.join(innermost(counts, scopes), ["file", "line"])
    own = at.groupBy("file", "scope_id").agg(F.sum("n").alias("weight"))
    return scopes.select("file", "scope_id").join(own, ["file", "scope_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def name_weights(scopes: DataFrame, named: DataFrame) -> DataFrame:
    """Scopes with the weight of their name; `*` has none."""
    return scopes.join(named.where("name <> '*'").select("name", "weight"), "name", "left")


def ancestors(scopes: DataFrame) -> DataFrame:
    """(file, above, scope_id, term, c): every scope with itself and all scopes above it, and what the repeats on the way down multiply
    to: a product of names (term, empty for none) and of numbers (c).

    By doubling the length of the ways, so a tree of depth d takes log2(d) rounds of two joins; its rows are those of the closure, the sum
    of all depths. Their files are a small part of their size in memory, so no join sends them through the driver. A scope whose parent isn't listed is a top one; a cycle is an error."""
    number = F.col("repeat").rlike("^[0-9]+$")
    times = F.col("kind").isin("ITN", "MAP", "ZIPWITH", "FOLDL") & F.col("repeat").isNotNull()
    by = scopes.select("file", F.col("scope_id").alias("above"), F.when(times & ~number, F.col("repeat")).otherwise("").alias("term"), F.when(times & number, F.col("repeat").try_cast("long")).otherwise(F.lit(1).cast("long")).alias("c"))
    step = checkpointed(scopes.where("parent_id is not null").select("file", F.col("parent_id").alias("above"), "scope_id").join(by.hint("merge"), ["file", "above"]).select("file", "above", "scope_id", "term", "c"))
    found = scopes.select("file", F.col("scope_id").alias("above"), "scope_id", F.lit("").alias("term"), F.lit(1).cast("long").alias("c"))

    def then(upper: DataFrame, lower: DataFrame) -> DataFrame:
        low = lower.select("file", F.col("above").alias("_at"), F.col("scope_id").alias("_to"), F.col("term").alias("_term"), F.col("c").alias("_c"))
        both = upper.withColumnRenamed("scope_id", "_at").join(low.hint("merge"), ["file", "_at"])
        return both.select("file", "above", F.col("_to").alias("scope_id"), F.concat_ws("*", F.nullif("term", F.lit("")), F.nullif("_term", F.lit(""))).alias("term"), (F.col("c") * F.col("_c")).alias("c"))

    most, length = scopes.count(), 1
    while not step.isEmpty():
        if length > most:
            raise ValueError("the scopes' parents form a cycle")
        found = checkpointed(found.union(then(step, found)))
        step, length = checkpointed(then(step, step)), 2 * length
    return found


def roll_up(scopes: DataFrame) -> DataFrame:
    """A3: scopes (file, scope_id, parent_id, kind, own, repeat) with total: a polynomial as MAP<monomial, coefficient>.

    own is the scope's weight; ITN, MAP, ZIPWITH and FOLDL repeat their children: own + repeat * sum, where repeat is a name such as
    n (or a number); MEMALLOC and MEMFREE add the term os_call; other kinds add their children up. So a scope's total is the sum over
    all scopes in it of their own terms times the repeats on the way, whatever the depth."""
    memory = F.when(F.col("kind").isin("MEMALLOC", "MEMFREE"), F.array(F.struct(F.lit("os_call").alias("t"), F.lit(1).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<t:string,n:bigint>>"))
    own = scopes.select("file", "scope_id", F.explode(F.concat(F.array(F.struct(F.lit("").alias("t"), F.col("own").cast("long").alias("n"))), memory)).alias("x")).select("file", "scope_id", "x.*")
    each = ancestors(scopes).join(own.hint("merge"), ["file", "scope_id"])
    term = F.concat_ws("*", F.nullif("term", F.lit("")), F.nullif("t", F.lit("")))
    summed = each.groupBy("file", F.col("above").alias("scope_id"), F.when(term == "", "1").otherwise(term).alias("term")).agg(F.sum(F.col("c") * F.col("n")).alias("c")).where("c <> 0")
    totals = summed.groupBy("file", "scope_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "c")))).alias("total"))
    return scopes.select("file", "scope_id").join(totals.hint("merge"), ["file", "scope_id"], "left").withColumn("total", F.coalesce("total", F.create_map().cast("map<string,bigint>")))


def sibling_edges(uses: DataFrame, keys: list[str]) -> DataFrame:
    """Uses (keys, pos, var, reads, writes) to edges (keys, var, src, dst): a writer reaches every later sibling that reads the variable,
    up to and including the next writer. By windows: each reader has one latest writer before it."""
    w = Window.partitionBy(*keys, "var").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = uses.withColumn("src", F.last(F.when(F.col("writes"), F.col("pos")), ignorenulls=True).over(w))
    return before.where("reads and src is not null").select(*keys, "var", "src", F.col("pos").alias("dst"))


def parameter_links(params: DataFrame, pragmas: DataFrame, most_pairs: int = 4_000_000) -> DataFrame:
    """Positional parameters (fun, var_name, var_pos) and pragma names (fun, par_name, par_pos) of the same name.

    A name has as many rows as its parameters times its pragmas, which says nothing of the bytes that go into the join, so tasks are cut by pairs:
    the parameters of a name with over most_pairs of them are dealt to several slices, each of which gets all the name's pragmas."""
    named = pragmas.select("fun", F.col("par_name").alias("var_name"), "par_pos")
    key = ["fun", "var_name"]
    pairs = params.groupBy(*key).agg(F.count("*").alias("a")).join(named.groupBy(*key).agg(F.count("*").alias("b")), key)
    sizes = checkpointed(pairs.select(*key, (F.col("a") * F.col("b")).alias("pairs")))
    parts = max(1, min(100_000, -(-(sizes.agg(F.sum("pairs")).first()[0] or 0) // most_pairs)))
    slices = F.ceil(F.col("pairs") / most_pairs).cast("int")
    wide = broadcast_within(sizes.where(F.col("pairs") > most_pairs).select(*key, slices.alias("_slices")), 100_000)
    many = F.coalesce("_slices", F.lit(1))
    left = params.join(wide, key, "left").withColumn("_slice", F.pmod(F.xxhash64("var_pos"), many).cast("int"))
    right = named.join(wide, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), many - 1)))
    key = [*key, "_slice"]
    return left.repartition(parts, *key).join(right.repartition(parts, *key), key).select("fun", "var_name", "var_pos", "par_pos")


def propagate_memory(params: DataFrame, tree: DataFrame) -> DataFrame:
    """Params (file, scope_id, var, elements) where a missing count comes from the parent's parameter of the same name, and so on up.

    By pointer jumping: each round doubles how far up a parameter looks, so a tree of depth d takes log2(d) rounds. A cycle is an error."""
    links = tree.select("file", F.col("parent").alias("up"), F.col("child").alias("scope_id"))
    here = params.select("file", F.col("scope_id").alias("up"), "var")
    first = params.join(links.join(here, ["file", "up"]).select("file", "scope_id", "var", "up"), ["file", "scope_id", "var"], "left")
    rows, length, most = checkpointed(first), 1, params.count()
    while not rows.where("elements is null and up is not null").isEmpty():
        if length > 2 * most:
            raise ValueError("the scopes' parents form a cycle")
        above = rows.select("file", F.col("scope_id").alias("up"), "var", F.col("elements").alias("_e"), F.col("up").alias("_up"))
        now = rows.join(above, ["file", "up", "var"], "left").withColumn("up", F.when(F.col("elements").isNull() & F.col("_e").isNull(), F.col("_up")))
        rows, length = checkpointed(now.withColumn("elements", F.coalesce("elements", "_e")).select("file", "scope_id", "var", "elements", "up")), 2 * length
    return rows.join(params.drop("elements"), ["file", "scope_id", "var"]).select(params.columns) if len(params.columns) > 4 else rows.select(params.columns)


def visible(scopes: DataFrame) -> DataFrame:
    """without memory scopes."""
    return scopes.where("kind not in ('MEMALLOC', 'MEMFREE')")


def independent(reads: str = "reads", writes: str = "writes"):
    """U4, M2: whether the read and write sets share nothing."""
    return ~F.arrays_overlap(F.col(reads), F.col(writes))


def invariant_counts(used: str, written: str):
    """How many used variables no one writes, and how many are written; lists count repeats."""
    free = F.size(F.filter(F.col(used), lambda x: ~F.array_contains(F.col(written), x)))
    return free, F.size(F.col(used)) - free
