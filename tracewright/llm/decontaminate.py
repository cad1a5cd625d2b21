"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles (powers of two). An item's sketch is its m smallest
shingle hashes, with m = floor((1 - t) u) + 1 for the upper size u of its partition: of an item that is
contained to the share t or more, at most floor((1 - t) u) shingles are missing, so at least one of the m is in the
document. A document is searched by its whole shingles, so its length doesn't dilute the sketch: banded
signatures of whole documents can't find a 40-word item in 20,000 words (their resemblance is some 0.002), which
is why the sketch is kept on the item's side. Pairs that share a sketch hash are candidates; only for these the exact
share of the item's distinct shingles that the document has is computed.

Documents are exploded into shingle hashes within one stage, where they probe the broadcast sketches; only hits
are shuffled. The sketches grow with the benchmark, not with the documents; their rows are counted, and above
`most_broadcast` they are joined by shuffle. Verification reads the candidates' texts again by an equi-join on
doc_id.

Words: `[^\\x20\\x09-\\x0D]+`, in lower case; shingles of `width` words. An item of fewer words has its whole sequence as
its only shingle, and documents are searched for runs of that many words as well, for each such length that items have.

Defined cases: an item without words has no shingles and is never matched; null texts are empty; items with equal
texts are matched each; rows with one doc_id are one document; null doc_ids are never matched by contained(), but
without_leaks() looks at texts and drops rows with or without an id; empty tables give an empty result; other
columns are ignored; a very long text's shingles are rows of one task's stream, never held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import SPACE, checkpointed, parts_for


def words(text: str) -> Column:
    """The words of a text in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")


def exploded(df: DataFrame, keep: list[str], width: int, text: bool = False) -> DataFrame:
    """keep columns and h: the hash of each shingle of the column `words`, repeats included; text: also s, the shingle."""
    at = df.where(F.size("words") >= width).select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
    own = [F.get("words", F.col("at") + i) for i in range(width)]
    return at.select(*keep, F.xxhash64(*own).alias("h"), *[F.concat_ws(" ", *own).alias("s")] * text)


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, width, h, s): the distinct shingles of each item that has any; width: their number of words."""
    own = items.select("item_id", "text").where("item_id is not null").select("item_id", words("text").alias("words"))
    size = F.least(F.size("words"), F.lit(width))
    found = None
    for k in range(1, width + 1):
        part = exploded(own.where(size == k), ["item_id"], k, True).select("item_id", F.lit(k).alias("width"), "h", "s")
        found = part if found is None else found.union(part)
    return found.distinct()


def sketches(shingles: DataFrame, share: float = 0.8) -> DataFrame:
    """(item_id, size_class, width, h): the sketch of each item by the rule of its size partition."""
    own = shingles.groupBy("item_id", "width").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("hs").cast("double")))).cast("int")
    most = F.floor((1 - F.lit(share)) * upper + 1e-9).cast("int") + 1
    return own.select("item_id", upper.alias("size_class"), "width", F.explode(F.slice("hs", F.lit(1), F.least(most, F.size("hs")))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, most_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, containment): every pair in which the document has at least this share of the item's shingles."""
    shingles = checkpointed(item_shingles(items, width), parts_for(items))
    numbers = {r["width"]: r["n"] for r in shingles.groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row for each width
    index = checkpointed(sketches(shingles, share), parts_for(items))

    def small(df: DataFrame) -> DataFrame:
        """Broadcast where the benchmark is small enough; all such tables have as many rows as it has shingles, at most."""
        return F.broadcast(df) if sum(numbers.values()) <= most_broadcast else df

    def search(own: DataFrame, of: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """The documents' shingles of each width that items have, joined with those of items."""
        found = None
        for k in sorted(numbers) or [width]:
            part = exploded(own, ["doc_id"], k, "s" in on).join(small(of.where(F.col("width") == k).drop("width")), on, how)
            found = part if found is None else found.union(part)
        return found

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    own = texts.select("doc_id", words("text").alias("words"))
    found = checkpointed(search(own, index.select("item_id", "width", "h"), ["h"]).select("doc_id", "item_id").distinct(), parts_for(texts))
    again = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words("text").alias("words"))
    have = search(again, shingles.select("width", "h", "s").distinct(), ["h", "s"], "left_semi").distinct()
    n = Window.partitionBy("item_id")
    each = shingles.select("item_id", "h", "s", F.count("*").over(n).alias("n"))
    met = found.join(small(each), "item_id").join(have, ["doc_id", "h", "s"]).groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("met"))
    return met.select("doc_id", "item_id", (F.col("met") / F.col("n")).alias("containment")).where(F.col("containment") >= share - 1e-9)


def without_leaks(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5) -> DataFrame:
    """docs without those that contain a benchmark item. Texts are told apart by their hash, so that rows without a doc_id,
    or several texts of one doc_id, are judged by their own text."""
    gone = contained(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, share, width).select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column's name can clash
    return own.join(gone, F.xxhash64("row.text") == F.col("gone"), "left_anti").select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
k AS (
  SELECT DISTINCT least(len(words), 5) AS k FROM w WHERE kind = 1 AND id IS NOT NULL AND len(words) > 0),
s AS (
  SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i+k-1], ' '))) AS s FROM w, k
  WHERE id IS NOT NULL AND CASE WHEN kind = 1 THEN k = least(len(words), 5) ELSE k <= len(words) END),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / any_value(n.n) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.k = b.k AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / any_value(n.n) >= 0.8 - 1e-9
"""
