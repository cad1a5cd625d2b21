"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds are reported whenever their pattern and check agree: email, ip (parts at most 255), card (12 to 19
digits that pass Luhn), phone (international, 9 to 15 digits). Further kinds are added where the score, raised by
a checksum and by words nearby, reaches the threshold: iban (mod 97), ssn, routing (bank routing number, weights
3 7 1), national_phone and birth_date. A span of a further kind that overlaps a base span, or one of a kind
listed before it, is left out.

Spans are in code points, end exclusive. Within a kind they are the leftmost that don't overlap; matches that
fail their check are dropped and not tried again from within.

Defined cases: a null or empty text has no spans; null or repeated doc_ids and equal rows each give a row; an
empty table gives an empty result; other columns are ignored; very long texts and long runs of digits, marks or
letters take time in proportion to their length (times the logarithm of the number of spans).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import whole_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "routing", "national_phone", "birth_date")
NEAR = 48  # code points on either side in which context words count

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits that fails from its start fails from within; linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN's check digits are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def routing(digits: str) -> bool:
    return digits != "0" * 9 and sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one @; its local part is what may stand before it, after the last match."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at += 1


def base_spans(text: str) -> list[Span]:
    found = [Span("email", i, j, 0.9) for i, j in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(Span("ip", *m.span(), 0.8))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span(), 0.8))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(Span("phone", *m.span(), 0.7))
    return found


class Further(NamedTuple):
    pattern: re.Pattern
    score: float
    check: Callable[[str], bool] | None  # on the match without separators; adds 0.5, failing drops the match
    context: re.Pattern  # adds 0.4


def words(*w: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(w) + r")\b", re.IGNORECASE)


FURTHER = {
    "iban": Further(re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.3, lambda s: 15 <= len(s) <= 34 and mod97(s), words("iban", "account", "bank", "konto", "compte", "cuenta")),
    "ssn": Further(re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), 0.4, None, words("ssn", "social", "security")),
    "routing": Further(re.compile(r"(?<![0-9.-])[0-9]{9}(?![0-9.-])"), -0.2, routing, words("routing", "aba", "bank")),
    "national_phone": Further(re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"), 0.4, None, words("phone", "tel", "telephone", "call", "mobile", "fax", "cell")),
    "birth_date": Further(re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])"), 0.25, None, words("born", "birth", "birthday", "dob", "geboren", "naissance", "nacido", "nacida")),
}


def spans(text: str, threshold: float = 0.6) -> list[Span]:
    """All spans by start, then kind as listed, end."""
    found = base_spans(text)
    if DIGIT.search(text):
        starts: list[int] = []  # of the taken spans, overlapping ones joined
        ends: list[int] = []
        for a, b in sorted((s.start, s.end) for s in found):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for kind, rule in FURTHER.items():
            for m in rule.pattern.finditer(text):
                score, plain = rule.score, re.sub(r"[\x20.-]", "", m[0])
                if rule.check:
                    if not rule.check(plain):
                        continue
                    score += 0.5
                if rule.context.search(text, max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)):
                    score += 0.4
                at = bisect_right(ends, m.start())  # the first taken span that ends after the match's start
                if score >= threshold and at == bisect_left(starts, m.end()):
                    found.append(Span(kind, *m.span(), score))
                    starts.insert(at, m.start())
                    ends.insert(at, m.end())
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_pii(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, score, match) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())]))
        for b in batches:
            found = [[s._asdict() | {"match": t[s.start : s.end]} for s in spans(t, threshold)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole_texts(rows).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double,match:string>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what find_pii gives."""

    def line(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def same(kind: str):
        return lambda s: s["kind"] == F.lit(kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", same(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def sha(found: list[Span]) -> str:
    """The digest of one text's base spans."""
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in BASE).encode()).hexdigest()
