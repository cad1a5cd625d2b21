"""URL filter: rules on host and path, and gradient-boosted trees on lexical features for the rest.

The rules' verdicts label the urls that they fit; the trees learn from these (a hash sample of at most `max_rows`
of them) and judge all others. Features: lengths, depth, digit ratio, character entropy, parameters, marks, and suffix
statistics: how often urls with this last label, these last two labels or this first path segment were blocked.
These are counted over all labelled urls by the suffix itself; only the trees' fitting is bounded by `max_rows`. A url
that the trees are fitted on has them from the other FOLDS - 1 of FOLDS hash parts of the labelled urls, so that its own
label isn't among them, as with urls without a label; those that are judged have them from all.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the trees;
with labels of one verdict only, that is the verdict of the rest, and without any labels it is allow; equal rows and null
page_ids each give a row; an empty table gives an empty result; other columns are ignored; very long urls are read in
time in proportion to their length times the number of different characters.

The table is read once: hosts, paths and features are written to the shared folder, and counts, the sample and the
verdicts are made from there. The rules are the only labels, so the trees carry the rules' verdicts over to urls that look alike
(their domain or first path segment, or their lexical shape); what no rule speaks of they can't know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpointed, parts_for, stored

#: Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MOST_BROADCAST = 200_000  # suffixes of a kind; more are joined by shuffle
FOLDS = 5
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, PARTS, 1), UPPER, LOWER), F.regexp_extract(known, PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; nulls if none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def count_of(x: Column, letters: str) -> Column:
    """How many characters of x are among the letters."""
    return (F.length(x) - F.length(F.translate(x, letters, ""))).cast("double")


def entropy(x: Column) -> Column:
    n = F.greatest(F.length(x), F.lit(1)).cast("double")

    def term(c: Column) -> Column:
        p = (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.transform(F.array_distinct(F.split(x, "")), term), F.lit(0.0), lambda a, b: a + b)


def with_features(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, known, x array<double>, s0, s1, s2)."""
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split("host", r"\.")
    x = F.array(
        F.length(url).cast("double"), F.length("host").cast("double"), F.length("path").cast("double"),
        count_of(F.col("path"), "/"), count_of(F.col("host"), "."), count_of(url, "0123456789") / n,
        count_of(F.col("host"), "0123456789"), count_of(F.col("host"), "-"), entropy(url), entropy(F.col("host")),
        count_of(url, "="), count_of(url, "&"), count_of(url, "#"), count_of(url, "%"), url.startswith("https").cast("double"),
    )
    suffixes = (F.element_at(labels, -1), F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2))), F.substring_index(F.substring_index("path", "/", 2), "/", -1))
    own = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    return own.withColumns({"rule": rule, "known": verdict, "x": x} | {f"s{i}": s for i, s in enumerate(suffixes)}).drop("url")


def fold() -> Column:
    return F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(FOLDS)).cast("int")


def suffix_counts(own: DataFrame) -> list[DataFrame]:
    """For each kind of suffix (s<i>, n<i>, blocked<i>): its labelled urls in each fold and those of them that were blocked."""
    block = (F.col("known") == "block").cast("long")
    folds = [fold() == f for f in range(FOLDS)]
    n, blocked = F.array(*[F.count_if(f) for f in folds]), F.array(*[F.sum(F.when(f, block).otherwise(0)) for f in folds])
    return [checkpointed(own.where("known is not null").groupBy(f"s{i}").agg(n.alias(f"n{i}"), blocked.alias(f"blocked{i}")), parts_for(own)) for i in range(3)]


def with_counts(own: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """own with n<i> and blocked<i> of its suffixes; nulls where none was labelled."""
    for i, c in enumerate(counts):
        if c.count() <= MOST_BROADCAST:
            own = own.join(F.broadcast(c), f"s{i}", "left")
        else:  # read from tables, both sides are shuffled for this join alone, so that Spark can split a frequent suffix
            own = (stored(own, "counted") if i else own).join(c, f"s{i}", "left")
    return own


def sample_of(own: DataFrame, n: int, max_rows: int) -> DataFrame:
    """The labelled rows, of which there are n, or a hash sample of max_rows about."""
    chosen = own.where("known is not null")
    return chosen.where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n)) if n > max_rows else chosen


def vector(share: float, but: Column | None = None) -> Column:
    """The features, with the suffixes' rates over the labelled urls of all folds but one; share: of blocked ones among all."""
    from pyspark.ml.functions import array_to_vector

    def total(name: str) -> Column:
        every = F.aggregate(F.col(name), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.coalesce(every if but is None else every - F.get(F.col(name), but), F.lit(0))

    return array_to_vector(F.concat("x", F.array(*[(total(f"blocked{i}") + share) / (total(f"n{i}") + 1) for i in range(3)])))


def fit(own: DataFrame, suffixes: list[DataFrame], share: float, n: int, max_rows: int, trees: int, depth: int):
    """The fitted trees, on at most max_rows rows."""
    from pyspark.ml.classification import GBTClassifier

    label = (F.col("known") == "block").cast("double")
    chosen = checkpointed(with_counts(sample_of(own, n, max_rows), suffixes).select(label.alias("label"), vector(share, fold()).alias("features")).repartition(8))
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(chosen)


def judge(pages: DataFrame, rules=RULES, max_rows: int = 50_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    own = stored(with_features(pages, rules), "urls", parts_for(pages.select("url")))
    counts = {r["known"]: r["n"] for r in own.where("known is not null").groupBy("known").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n = sum(counts.values())
    if len(counts) < 2:
        return own.select("page_id", "host", "path", "rule", F.coalesce("known", F.lit(next(iter(counts), "allow"))).alias("verdict"))
    share, suffixes = counts.get("block", 0) / n, suffix_counts(own)
    model = fit(own, suffixes, share, n, max_rows, trees, depth)
    told = model.transform(with_counts(own, suffixes).withColumn("features", vector(share)))
    return told.select("page_id", "host", "path", "rule", F.coalesce("known", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"))
