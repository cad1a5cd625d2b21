"""The 23 features of C code, from a small parser of statements: what nests in what, what is written, read and called.

It reads a subset of C: functions, blocks, for, while, do, if, switch, declarations and expressions; the preprocessor is skipped
but for pragmas, which belong to the statement after them. Expressions are token lists, not trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.features import FEATURES

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|<<=|>>=|\+\+|--|->|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|\S")
TYPES = set("void char short int long float double signed unsigned const static extern register struct union enum size_t".split())
WORDS = TYPES | set("for while do if else switch case default return break continue goto sizeof typedef".split())
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}


@dataclass
class Statement:
    kind: str  # block, for, while, do, if, switch, break, continue, return, decl, expr, empty, function
    parts: list[list[str]] = field(default_factory=list)  # token lists: of a for its three, else the condition or the expression
    body: list[Statement] = field(default_factory=list)
    pragmas: list[str] = field(default_factory=list)


def tokens(code: str) -> list[str]:
    """Tokens without comments; a pragma line is one token."""
    plain = re.sub(r"/\*.*?\*/|//[^\n]*", " ", code.replace("\\\n", " "), flags=re.S)
    out: list[str] = []
    for line in plain.split("\n"):
        own = line.strip()
        if own.startswith("#"):
            out += [own] if own.startswith("#pragma") else []
        else:
            out += TOKEN.findall(line)
    return out


class Parser:
    def __init__(self, code: str):
        self.t, self.i = tokens(code), 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def until(self, end: str, ends: tuple[str, ...] = ()) -> list[str]:
        """Tokens up to `end` outside of brackets, which is skipped; stops before one of `ends`."""
        out, depth = [], 0
        while self.i < len(self.t):
            x = self.t[self.i]
            if not depth and (x == end or x in ends):
                self.i += x == end
                break
            depth += (x in "([{") - (x in ")]}")
            out.append(x)
            self.i += 1
        return out

    def bracket(self) -> list[str]:
        """What is in the round brackets that come next."""
        if self.peek() != "(":
            return []
        self.i += 1
        return self.until(")")

    def block(self) -> list[Statement]:
        out = []
        while self.i < len(self.t) and self.peek() != "}":
            out.append(self.statement())
        self.i += 1
        return out

    def statement(self) -> Statement:
        pragmas = []
        while self.peek().startswith("#"):
            pragmas.append(self.peek())
            self.i += 1
        out = self.plain()
        out.pragmas = pragmas
        return out

    def plain(self) -> Statement:
        x = self.peek()
        self.i += 1
        if x in ("{", ""):
            return Statement("block", body=self.block() if x else [])
        if x == ";":
            return Statement("empty")
        if x == "for":
            head, parts = self.bracket(), [[]]
            for y in head:
                parts.append([]) if y == ";" else parts[-1].append(y)
            return Statement("for", (parts + [[], [], []])[:3], [self.statement()])
        if x in ("while", "switch"):
            return Statement(x, [self.bracket()], [self.statement()])
        if x == "if":
            out = Statement("if", [self.bracket()], [self.statement()])
            if self.peek() == "else":
                self.i += 1
                out.body.append(self.statement())
            return out
        if x == "do":
            out = Statement("do", body=[self.statement()])
            out.parts = [self.until(";")]
            return out
        if x in ("case", "default"):
            self.until(":")
            return Statement("empty")
        self.i -= 1
        own = self.until(";", ("{", "}"))
        if x in ("break", "continue", "return", "goto"):
            return Statement(x, [own])
        if self.peek() == "{" and ")" in own and "=" not in own:
            self.i += 1
            return Statement("function", [own], self.block())
        if self.peek() == "{":  # an initialiser, or the fields of a struct
            own += ["{", *self.fields(), "}", *self.until(";")]
        elif self.peek() == "}" and not own:
            self.i += 1  # one bracket too many
        return Statement("decl" if x in TYPES else "expr", [own])

    def fields(self) -> list[str]:
        self.i += 1
        return self.until("}")


def names(expr: list[str]) -> list[str]:
    """Variables: names that aren't called, words of the language or fields."""
    return [x for k, x in enumerate(expr) if re.match(r"[A-Za-z_]", x) and x not in WORDS and expr[k + 1 : k + 2] != ["("] and expr[k - 1 : k] not in (["."], ["->"])]


def written(expr: list[str]) -> list[tuple[str, list[list[str]]]]:
    """(variable, its indexes) of what an expression assigns, steps or declares with a value."""
    out = []
    for k, x in enumerate(expr):
        if x in ASSIGN or x in ("++", "--"):
            j, index = k - 1, []
            while j >= 0 and expr[j] == "]":
                depth, end = 1, j
                while depth and j > 0:
                    j -= 1
                    depth += (expr[j] == "]") - (expr[j] == "[")
                index.insert(0, expr[j + 1 : end])
                j -= 1
            if j >= 0 and expr[j] not in WORDS and re.match(r"[A-Za-z_]", expr[j]):
                out.append((expr[j], index))
            elif x in ("++", "--") and k + 1 < len(expr) and re.match(r"[A-Za-z_]", expr[k + 1]):
                out.append((expr[k + 1], []))
    return out


def declared(expr: list[str]) -> list[str]:
    """The names that a declaration makes: before a comma, a value, an index or the end, outside of brackets."""
    out, depth = [], 0
    for k, x in enumerate(expr):
        after = expr[k + 1] if k + 1 < len(expr) else ","
        if not depth and re.match(r"[A-Za-z_]", x) and x not in WORDS and after in (",", "=", "[", ";") and k and expr[k - 1] not in ("=", "struct", "+", "-", "/"):
            out.append(x)
        depth += (x in "([{") - (x in ")]}")
    return out


def features(code: str) -> list[int]:
    """The vector of FEATURES of one text."""
    parser = Parser(code)
    top = []
    while parser.i < len(parser.t):
        top.append(parser.statement())
    f = dict.fromkeys(FEATURES, 0)
    f["max_loop_depth"], f["static_limits"] = -1, 1
    outer = {n for s in top if s.kind == "decl" for n in declared(s.parts[0])}
    arrays: dict[str, bool] = {}

    def expression(expr: list[str], loops: list[dict], local: set[str], decl: bool = False) -> None:
        f["calls"] += sum(x not in WORDS and re.match(r"[A-Za-z_]", x) is not None and expr[k + 1 : k + 2] == ["("] for k, x in enumerate(expr))
        f["ternaries"] += expr.count("?")
        if any(n in outer and n not in local for n in names(expr)):
            f["globals"] = 1
        for k, x in enumerate(expr):
            if x == "]" and expr[k + 1 : k + 2] == ["["]:
                j, depth = k, 1
                while depth and j > 0:
                    j -= 1
                    depth += (expr[j] == "]") - (expr[j] == "[")
                arrays.setdefault(expr[j - 1], True)
        sets = written(expr)
        for name, index in sets:
            if loops and any(any(y in ("+", "-") for y in x) for x in index):
                f["shifted_writes"] = 1
        if loops:
            own = {n for n, _ in sets}
            f["aux_index_vars"] += sum(x == "[" and expr[k + 2 : k + 3] == ["]"] and expr[k + 1] in loops[-1]["set"] and expr[k + 1] not in [y["iter"] for y in loops] for k, x in enumerate(expr))
            loops[-1]["set"] |= own
            loops[-1]["got"] |= set(names(expr)) - own
            if any(n in y["limit"] for n in own for y in loops):
                f["static_limits"] = 0
        else:
            local |= {f" {n}" for n, _ in sets}  # set before a loop

    def children(body: list[Statement]) -> None:
        """Statements before and after loops of a block."""
        before = found = 0
        for s in body:
            own = s.kind not in ("decl", "empty")
            f["postambles"] += found * own
            if s.kind == "for":
                f["preambles"] += before
                found += 1
            before += own

    def walk(s: Statement, loops: list[dict], local: set[str]) -> None:
        text = " ".join(s.pragmas)
        if s.kind == "block":
            f["compounds"] += 1
            children(s.body)
            for x in s.body:
                walk(x, loops, local)
        elif s.kind == "function":
            children(s.body)
            inside = local | set(declared(s.parts[0]))
            for x in s.body:
                walk(x, [], inside)
        elif s.kind == "for":
            first, limit, step = s.parts
            f["for_loops"] += 1
            f["schedules"] |= "schedule" in text
            f["simd_loops"] |= "simd" in text.lower() or "iteration_independent" in text
            f["roll_ups"] += "rolled-up" in text
            start = (written(first) or [("", [])])[0][0]
            steps = [int(x) for x in step if x.isdigit()]
            f["non_unit_steps"] += not (steps == [1] or not steps and any(x in ("++", "--") for x in step))
            if any(limit[k + 1 : k + 2] == ["("] and re.match(r"[A-Za-z_]", x) for k, x in enumerate(limit)):
                f["static_limits"] = 0
            local.update(declared(first))
            expression(first, [], local)
            loop = {"iter": start, "limit": set(names(limit)) - {start}, "set": set(), "got": set()}
            f["max_loop_depth"] = max(f["max_loop_depth"], len(loops))
            for x in s.body:
                walk(x, [*loops, loop], local)
            f["invariants"] += len(loop["got"] - loop["set"])
            f["hoisted"] += sum(n in y["set"] for n in loop["set"] for y in loops) + sum(f" {n}" in local for n in loop["set"] if n != start)
        elif s.kind in ("if", "while", "switch", "do"):
            for p in s.parts:
                expression(p, loops, local)
            if s.kind == "if":
                f["ifs"] += 1
                f["empty_ifs"] += s.body[0].kind == "empty" or s.body[0].kind == "block" and not s.body[0].body
            for x in s.body:
                walk(x, loops, local)
        elif s.kind in ("break", "continue"):
            f["irregular_loops"] += bool(loops)
        elif s.kind == "decl":
            own = s.parts[0]
            f["struct_vars"] += len(declared(own)) if own[:1] == ["struct"] else 0
            if s not in top:
                local.update(declared(own))
            expression(own, loops, local, True)
        elif s.parts:
            f["useless_statements"] |= len(s.parts[0]) == 1 and s.parts[0][0][0].isdigit()
            expression(s.parts[0], loops, local)

    for s in top:
        walk(s, [], set())
    f["non_1d_arrays"] = len(arrays)
    return [int(f[n]) for n in FEATURES]


def code_features(texts: DataFrame, key: str = "file", code: str = "value", most_kept: int = 4096) -> DataFrame:
    """(key, feat): the features of each text; a null text is empty. A task parses a text that comes again once, for up to most_kept texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(most_kept)(features)
        for b in batches:
            # a long text would hold memory and hardly comes again
            found = [(known if len(x) <= 4096 else features)(x) for x in (y or "" for y in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], [key, "feat"])

    return texts.select(F.col(key), F.col(code)).mapInArrow(run, f"{key} {kind}, feat array<int>")
