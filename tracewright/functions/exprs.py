"""Column functions of dataflow rates and time: exact integers, no Python on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def floor_div(a: Column, b: Column) -> Column:
    """The floor of a / b for integers and b > 0, null for b = 0; SQL's div cuts towards zero instead."""
    b = F.nullif(b, F.lit(0))
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return floor_div(a + b - 1, b)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's, over at most 92 steps that a pair of longs takes."""
    first = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), first, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise((F.abs(a) / g).cast("long") * F.abs(b))


def gcd_all(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: gcd(s, x))


def cyclic_get(values: Column, i: Column) -> Column:
    """The i-th value, from 0, of a vector that repeats for ever in both directions."""
    return F.get(values, F.pmod(i, F.size(values)).cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def cyclic_sum(values: Column, n: Column) -> Column:
    """The sum of the first n values of a repeating vector, n >= 0, in time of one period."""
    size = F.size(values)
    return floor_div(n.cast("long"), size.cast("long")) * total(values) + total(F.slice(values, F.lit(1), F.pmod(n, size).cast("int")))


def channel_tokens(tokens: Column, production: Column, consumption: Column, fired: Column, drained: Column) -> Column:
    """Tokens after the producer fired and the consumer drained so many times."""
    return tokens + cyclic_sum(production, fired) - cyclic_sum(consumption, drained)


def predecessor(tokens: Column, production: Column, consumption: Column, k: Column) -> Column:
    """The producer's firing (from 1; 0 or less: of an earlier iteration) that the consumer's k-th firing waits for."""
    need = cyclic_sum(consumption, k) - 1 - tokens
    n = F.size(production)

    def last(i: Column) -> Column:
        return floor_div(need - total(F.slice(production, F.lit(1), i)), total(production)) * n + i + 1

    return F.array_max(F.transform(F.sequence(F.lit(0), n - 1), last))


def linear_bounds(tokens: Column, production: Column, consumption: Column) -> tuple[Column, Column]:
    """(upper, lower) bounds of mean production * predecessor(k) - mean consumption * k over all k, times both periods' lengths."""
    np_, nc = F.size(production).cast("long"), F.size(consumption).cast("long")
    sp, sc = total(production), total(consumption)
    g = gcd(sp, sc)

    def row(j: Column) -> Column:
        def cell(i: Column) -> Column:
            need = total(F.slice(consumption, F.lit(1), j)) - 1 - tokens - total(F.slice(production, F.lit(1), i))
            return g * floor_div(need, g) * np_ * nc + (i + 1) * sp * nc - j * sc * np_

        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(production) - 1), cell))

    most = F.transform(F.sequence(F.lit(1), F.size(consumption)), row)
    return F.array_max(most), F.array_min(most) - (sp - g) * np_ * nc


def parse_rates(text: Column) -> Column:
    """Rates from `[n * v, m]`, `n` or a comma list; `n * v` is v, n times."""
    plain = F.regexp_replace(text, r"[\[\]\s]", "")

    def one(item: Column) -> Column:
        parts = F.split(item, r"\*")
        return F.when(F.size(parts) == 2, F.array_repeat(F.get(parts, F.lit(1)).cast("long"), F.get(parts, F.lit(0)).cast("int"))).otherwise(F.array(F.get(parts, F.lit(0)).cast("long")))

    return F.flatten(F.transform(F.split(plain, ","), one))


def sample(values: Column, start: Column, step: Column, number: Column, per: Column | int = 1) -> Column:
    """`number` sums of `per` neighbouring rates each, the first from place `start`, `step` places apart."""
    per = per if isinstance(per, Column) else F.lit(per)

    def at(i: Column) -> Column:
        first = start + i * step
        return cyclic_sum(values, first + per) - cyclic_sum(values, first)

    return F.transform(F.sequence(F.lit(0), number - 1), at)


def mp_add(a: Column, b: Column) -> Column:
    """Max-plus sum; null stands for minus infinity."""
    return F.greatest(a, b)


def mp_times(a: Column, b: Column) -> Column:
    """Max-plus product; null absorbs."""
    return a + b


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, in a session on UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def four_hex(x: Column) -> Column:
    return x.rlike("^[0-9A-Fa-f]{4}$")


def identifiers(x: Column) -> Column:
    """Distinct runs of letters and underscores."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit("[A-Za-z_]+"), F.lit(0)))


def split_parameters(x: Column) -> Column:
    """Parameters apart by spaces; a zip(...) group stays one."""
    return F.regexp_extract_all(x, F.lit(r"zip\([^)]*\)|[^ ]+"), F.lit(0))


def vector_key(x: Column) -> Column:
    """The numbers of a vector in a row. Not a key: [1,10] and [11,0] look alike; compare the arrays."""
    return F.array_join(x.cast("array<string>"), "")


#: Scope kinds by code.
SCOPE_KINDS = ("NONE", "MAP", "ITN", "ZIPWITH", "FOLDL", "MEMALLOC", "MEMFREE")


def scope_kind(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, SCOPE_KINDS)), code)


def scope_code(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, SCOPE_KINDS)), name)
    return F.when(at > 0, at - 1).cast("int")


def xgcd(a: Column, b: Column) -> Column:
    """[g, x, y] with a x + b y = g >= 0, for longs, over at most 92 steps of Euclid's."""
    names = ("a", "b", "x", "u", "y", "v")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    first = F.struct(*[x.alias(n) for n, x in zip(names, (a.cast("long"), b.cast("long"), one, zero, zero, one), strict=True)])

    def step(s: Column, _: Column) -> Column:
        q = F.call_function("div", s["a"], F.when(s["b"] == 0, one).otherwise(s["b"]))
        moved = (s["b"], s["a"] - q * s["b"], s["u"], s["x"] - q * s["u"], s["v"], s["y"] - q * s["v"])
        return F.when(s["b"] == 0, s).otherwise(F.struct(*[x.alias(n) for n, x in zip(names, moved, strict=True)]))

    def done(s: Column) -> Column:
        sign = F.when(s["a"] < 0, F.lit(-1).cast("long")).otherwise(one)
        return F.array(sign * s["a"], sign * s["x"], sign * s["y"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), first, step, done)


def modinv(a: Column, m: Column) -> Column:
    """The inverse of a modulo m, null if they share a factor."""
    found = xgcd(F.pmod(a.cast("long"), m.cast("long")), m)
    return F.when(F.get(found, F.lit(0)) == 1, F.pmod(F.get(found, F.lit(1)), m.cast("long")))


#: Enough witnesses for every number below 2^64.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, exact for 64 bits."""
    if n < 2:
        return False
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in WITNESSES:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _factors(n: int) -> list[int]:
    """Prime factors, in order: small ones by division, large ones by Pollard's rho."""
    out, todo = [], []
    for p in range(2, 1000):
        while n % p == 0:
            out.append(p)
            n //= p
    if n > 1:
        todo.append(n)
    while todo:
        n = todo.pop()
        if _is_prime(n):
            out.append(n)
            continue
        shift = 1
        while True:
            x = y = 2
            g = 1
            while g == 1:
                x = (x * x + shift) % n
                y = (y * y + shift) % n
                y = (y * y + shift) % n
                g = math.gcd(abs(x - y), n)
            if g < n:
                break
            shift += 1
        todo += [g, n // g]
    return sorted(out)


def prime_factors(n: Column) -> Column:
    """The prime factors of a positive long, in order; none for others."""

    @pandas_udf("array<long>")
    def f(n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else _factors(int(x)) if x > 0 else [] for x in n])

    return f(n)


def is_prime(n: Column) -> Column:
    @pandas_udf("boolean")
    def f(n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else _is_prime(int(x)) for x in n], dtype="boolean")

    return f(n)


def chain(predecessors: Sequence[Callable[[Column], Column]], k: Column) -> Column:
    """Predecessor functions one after the other, the last one first: the firing of the first channel's producer that the last
    channel's consumer's k-th firing waits for."""
    for f in reversed(list(predecessors)):
        k = f(k)
    return k


def prime_code(digits: Column, radix: int = 10, digits_type: str = "array<long>") -> Column:
    """The product of the i-th prime to the power of the i-th digit of a vector, as a decimal. More than 46 digits are an error, as is a
    product of more than 38 decimal digits."""
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, p))]
    many = F.raise_error(F.lit(f"a vector of more than {len(primes)} digits"))
    digits = F.when(F.size(digits) > len(primes), many.cast(digits_type)).otherwise(digits)
    pairs = F.arrays_zip(digits.alias("d"), F.slice(F.lit(primes), F.lit(1), F.size(digits)).alias("p"))
    powers = F.transform(pairs, lambda x: F.aggregate(F.array_repeat(x["p"].cast("decimal(38,0)"), (x["d"] % radix).cast("int")), F.lit(1).cast("decimal(38,0)"), lambda a, b: (a * b).cast("decimal(38,0)")))
    return F.aggregate(powers, F.lit(1).cast("decimal(38,0)"), lambda a, b: (a * b).cast("decimal(38,0)"))
