"""Document fingerprints: a Merkle tree of sections, paragraphs and clauses.

Sections end at blank lines, paragraphs at line breaks; every separator belongs to what it ends, so the parts join to the text. The leaves are the
clauses of a paragraph, which end at marks: of a few characters at the start of a text, of FROM characters or more (if the paragraph has them)
from its 257th on. A leaf's digest is the SHA-256 of its text, a paragraph's that of its leaves' digests, a section's that of its paragraphs', the
root that of its sections'.

A fingerprint is `root:sections`: 32 hex digits, then 8 of each section with its paragraphs in (), 8 of each paragraph with its leaves in [], and 6 of
each leaf (4 of its digest, 2 of its length). Equal texts have equal roots and so equal fingerprints. likeness() walks both trees from their roots:
branches that both have are not entered, the others are compared by their children, leaves by digest and length; it is the common share, by length, of
the larger of the two (each different branch counts once). What moves within the first 256 characters is cut otherwise there, and so is different.
changes() walks the same way and tells where a text differs.

The next document is found by one shuffle of the texts: ids are cut into ranges at approximate quantiles, and
each range's first document is also put at the end of the range before.

Defined cases: a null text is empty; an empty text is one empty paragraph, of likeness 1 to empty texts and 0 to
others; null doc_ids come first; rows with one doc_id are ordered by text; the only document of a table is its own
next; an empty table gives an empty result; other columns are ignored; a very long text is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import whole_text

MARKS = r".!?;:,|\n"
#: Up to this code point of a text, leaves have so many code points at most.
LEAVES = ((32, 6), (256, 24))
#: Then they end at the first marks after so many, or without marks at MOST.
FROM, MOST = 128, 239
#: Places in the text are counted in its first sections, and paragraphs of a section, so many; FROM and MOST hold in the others.
COUNTED = 64


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def parts(x: Column, line_breaks: int) -> Column:
    """Cut after so many line breaks, before what isn't one."""
    return F.split(x, "(?<=" + r"\n" * line_breaks + r")(?=[^\n])")


def start_of(pieces: Column, i: Column) -> Column:
    """How many code points come before the i-th piece, from 0; many from COUNTED pieces on."""
    return F.when(i < COUNTED, F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, x: n + F.char_length(x))).otherwise(LEAVES[-1][0])


def leaves(paragraph: Column, start: Column) -> Column:
    """The clauses of a paragraph that begins at a place, from 0, of the text."""
    at, out = F.lit(0), []
    for to, most in LEAVES:
        end = F.greatest(to - start, F.lit(0))
        out.append(F.regexp_extract_all(F.substring(paragraph, at + 1, end - at), F.lit(f"(?s)[^{MARKS}]{{1,{most}}}[{MARKS}]{{0,16}}|[{MARKS}]{{1,16}}"), F.lit(0)))
        at = end
    out.append(F.regexp_extract_all(F.substring(paragraph, at + 1, F.lit(2**31 - 1)), F.lit(f"(?s).{{{FROM},{MOST}}}?[{MARKS}]{{1,16}}|.{{1,{MOST}}}"), F.lit(0)))
    return F.concat(*out)


def fingerprint(text: Column) -> Column:
    """root:sections of a text that isn't null."""

    def leaf(x: Column) -> Column:
        return F.struct(digest(x).alias("d"), F.lower(F.lpad(F.hex(F.char_length(x)), 2, "0")).alias("n"))

    def branch(nodes: Column, opened: str, children: Column, closed: str) -> Column:
        """The digest of child nodes, and its short form before the children's."""
        return let(digest(F.array_join(F.transform(nodes, lambda x: x["d"]), "")), lambda d: F.struct(d.alias("d"), F.concat(F.left(d, F.lit(8)), F.lit(opened), children, F.lit(closed)).alias("s")))

    def paragraph(x: Column, start: Column) -> Column:
        return let(F.transform(leaves(x, start), leaf), lambda n: branch(n, "[", F.array_join(F.transform(n, lambda y: F.concat(F.left(y["d"], F.lit(4)), y["n"])), ""), "]"))

    def joined(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda x: x["s"]), "")

    def section(x: Column, start: Column) -> Column:
        nodes = let(parts(x, 1), lambda p: F.transform(p, lambda y, k: paragraph(y, start + start_of(p, k))))
        return let(nodes, lambda n: branch(n, "(", joined(n), ")"))

    tree = let(parts(text, 2), lambda p: F.transform(p, lambda x, i: section(x, start_of(p, i))))
    return let(tree, lambda n: F.concat(F.left(digest(F.array_join(F.transform(n, lambda x: x["d"]), "")), F.lit(32)), F.lit(":"), joined(n)))


def sections_of(fp: Column) -> Column:
    return F.regexp_extract_all(fp, F.lit(r"[0-9a-f]{8}\([^)]*\)"), F.lit(0))


def paragraphs_of(sections: Column) -> Column:
    return F.regexp_extract_all(F.array_join(sections, ""), F.lit(r"[0-9a-f]{8}\[[^\]]*\]"), F.lit(0))


def leaves_of(paragraphs: Column) -> Column:
    return F.regexp_extract_all(F.array_join(F.transform(paragraphs, lambda x: F.substring(x, F.lit(10), F.char_length(x) - 10)), ""), F.lit(".{6}"), F.lit(0))


def weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.conv(F.substring(x, 5, 2), 16, 10).cast("long"))


def descend(a: Column, b: Column, below: Callable[[Column, Column], Column], length: Callable[[Column], Column]) -> Column:
    """(common, a, b), lengths of what two lists of branches have in common and in all: branches of both are common, below() compares the others."""

    def add(same: Column, rest: Column) -> Column:
        return F.struct((same + rest["common"]).alias("common"), (same + rest["a"]).alias("a"), (same + rest["b"]).alias("b"))

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), lambda x: let(F.struct(length(F.array_intersect(x["a"], x["b"])).alias("n"), below(F.array_except(x["a"], x["b"]), F.array_except(x["b"], x["a"])).alias("r")), lambda y: add(y["n"], y["r"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints."""

    def at_leaves(x: Column, y: Column) -> Column:
        return descend(leaves_of(x), leaves_of(y), lambda p, q: F.struct(F.lit(0).cast("long").alias("common"), weight(p).alias("a"), weight(q).alias("b")), weight)

    def at_paragraphs(x: Column, y: Column) -> Column:
        return descend(paragraphs_of(x), paragraphs_of(y), at_leaves, lambda p: weight(leaves_of(p)))

    found = descend(sections_of(a), sections_of(b), at_paragraphs, lambda s: weight(leaves_of(paragraphs_of(s))))
    share = let(found, lambda x: F.when(F.greatest(x["a"], x["b"]) == 0, F.lit(0.0)).otherwise(x["common"] / F.greatest(x["a"], x["b"])))
    # texts that differ only in the order or number of equal branches are not the same
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(share, F.lit(1 - 1e-9)))


def changes(a: Column, b: Column) -> Column:
    """Where b differs from a: a struct of paragraphs, how many different ones of b's a's differing sections lack, and the first one's section and paragraph,
    from 0; null places where there is none. Sections that a has are not entered."""

    def walk(x: Column) -> Column:
        """x: the sections of both, and the paragraphs of a's that b lacks."""
        first = F.element_at(x["new"], 1)
        section = F.array_position(F.transform(x["b"], lambda s: F.contains(s, first)), True) - 1
        paragraph = F.array_position(paragraphs_of(F.array(F.get(x["b"], section.cast("int")))), first) - 1
        return F.struct(F.size(x["new"]).cast("long").alias("paragraphs"), section.alias("section"), paragraph.alias("paragraph"))

    both = F.struct(sections_of(a).alias("a"), sections_of(b).alias("b"))
    new = let(both, lambda x: F.struct(x["b"].alias("b"), F.array_except(paragraphs_of(F.array_except(x["b"], x["a"])), paragraphs_of(F.array_except(x["a"], x["b"]))).alias("new")))
    return let(new, lambda x: F.when(F.size(x["new"]) > 0, walk(x)).otherwise(F.struct(F.lit(0).cast("long").alias("paragraphs"), F.lit(None).cast("long").alias("section"), F.lit(None).cast("long").alias("paragraph"))))


def ranges(docs: DataFrame, number: int) -> Column:
    """The number of a row's range of `place` (a long), from about equal ranges of all rows' places."""
    cuts = docs.select(F.percentile_approx("place", [i / number for i in range(1, number)], 20 * number).alias("q")).first()[0] if number > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    bounds = F.lit([-(2**63), *cuts])  # as many as there are ranges; found by halving
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts) + 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.expr("0") + F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(bounds, mid) <= F.col("place")
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, start, lambda s, x: F.when(s["hi"] - s["lo"] > 1, halve(s, x)).otherwise(s), lambda s: s["lo"])


def with_next(docs: DataFrame, number: int | None = None) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) for every row."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("place"), whole_text().alias("text"))
    bucket = ranges(own, number or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = own.withColumn("bucket", bucket)
    firsts = own.groupBy("bucket").agg(F.min("place").alias("place"))  # a row for each range
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("place", F.coalesce(F.lag("bucket").over(order), last).alias("bucket"))
    ends = own.drop("bucket").join(F.broadcast(before), "place").groupBy("bucket").agg(F.min_by(F.struct("doc_id", "place", "text"), "text").alias("x"))
    rows = own.select("bucket", "doc_id", "place", "text", F.lit(0).alias("end")).union(ends.select("bucket", "x.doc_id", "x.place", "x.text", F.lit(1)))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    follow = Window.partitionBy("bucket").orderBy("end", "place", "text")
    return rows.withColumns({"next_text": F.lead("text").over(follow), "next_fingerprint": F.lead("fingerprint").over(follow)}).where("end = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def compare_edited(docs: DataFrame, number: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row, and changes() of the edited text: how many
    paragraphs it has that the text lacks, and the section and place in it of the first one."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, number).withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = [likeness(F.col("fingerprint"), F.col(f"{x}_fingerprint")).alias(f"near_{x}") for x in ("edited", "next")]
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near, changes(F.col("fingerprint"), F.col("edited_fingerprint")).alias("at"))
    return rows.select(*rows.columns[:-1], F.col("at.paragraphs").alias("changed_paragraphs"), F.col("at.section").alias("first_section"), F.col("at.paragraph").alias("first_paragraph"))
