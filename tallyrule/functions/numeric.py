"""Numeric column functions with the engine's rounding, coercion and random-stream rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Step of the counter-based random stream: draw k has the state seed + (k + 1) * STEP mod 2**32.
STEP = 0x6D2B79F5
_M32 = (1 << 32) - 1


def finite(x: Column) -> Column:
    """Whether x is a number and neither NaN nor infinite (null: false)."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def round_up(x: Column, places: int = 6) -> Column:
    """Round half towards +infinity; what is not finite becomes 0. Built-in rounding goes away from zero instead."""
    x = x.cast("double")
    scale = F.lit(float(10**places))
    return F.when(finite(x), F.floor(x * scale + F.lit(0.5)) / scale).otherwise(F.lit(0.0))


def round_finite(x: Column, places: int = 6) -> Column:
    """round_up of a value that is known to be finite (null stays null): the value is named once, so nested roundings do not multiply the plan."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def round_up_py(x: float, places: int = 6) -> float:
    return math.floor(x * 10**places + 0.5) / 10**places if math.isfinite(x) else 0.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def number(x: Column) -> Column:
    """Loose coercion of text: null and blank are 0, numeric text parses, anything else is null (absent)."""
    t = F.trim(x.cast("string"))
    return F.when(x.isNull() | (t == ""), F.lit(0.0)).otherwise(t.try_cast("double"))


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit values; by halves, so nothing overflows a long."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M32))


def draw(k: Column, seed: int) -> Column:
    """Draw number k (from 0) of a seeded stream, in [0, 1). A pure function of k, so rows need no order."""
    a = (k.cast("long") * F.lit(STEP) % F.lit(1 << 32) + F.lit((seed + STEP) & _M32)).bitwiseAND(F.lit(_M32))
    t = _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_M32))
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / F.lit(4294967296.0)


def gauss(k: Column, seed: int) -> Column:
    """A normal value from draws k and k + 1 (Box-Muller)."""
    return F.sqrt(-2 * F.log(F.greatest(F.lit(1e-9), draw(k, seed)))) * F.cos(F.lit(2 * math.pi) * draw(k + 1, seed))


class Stream:
    """The same stream on the driver, for search control."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _M32

    def __call__(self) -> float:
        self.state = a = (self.state + STEP) & _M32
        t = (a ^ a >> 15) * (a | 1) & _M32
        t ^= t + ((t ^ t >> 7) * (t | 61) & _M32) & _M32
        return ((t ^ t >> 14) & _M32) / 4294967296

    def below(self, n: int) -> int:
        return int(self() * n)

    def coin(self) -> bool:
        return self() < 0.5


def seed_number(name: str) -> int:
    """A seed from 1 to 90,000 for a name."""
    h = 7
    for c in name:
        h = (h * 131 + ord(c)) & _M32
    return h % 90_000 + 1


def seed_of(name: Column) -> Column:
    """seed_number as a column; null counts as empty."""
    letters = F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(7).cast("long"), lambda h, c: (h * 131 + F.ascii(c)).bitwiseAND(F.lit(_M32))) % 90_000 + 1


def membership(x: Column, q1: Column, q3: Column, lo: Column, hi: Column) -> Column:
    """1 inside the quartiles, decaying with the distance outside; 0 for what is not finite or has no fingerprint."""
    span = F.greatest(q3 - q1, (hi - lo) * 0.5, F.lit(1e-9))
    away = F.greatest(q1 - x, x - q3, F.lit(0.0))
    return F.when(~finite(x) | q1.isNull(), 0.0).otherwise(round_finite(F.exp(-away / span)))


def confidence(score: Column, threshold: Column, spread: Column) -> Column:
    """The share of the training spread between score and threshold, at most 1."""
    return round_up(F.least(F.lit(1.0), F.abs(score - threshold) / F.coalesce(F.when(spread != 0, spread), F.lit(1.0))))


def over_years(per_year: Column, cpi: Column, years: Column) -> Column:
    """A yearly cost carried over whole years, rising by cpi after each, in money."""
    terms = F.sequence(F.lit(1), years.cast("int"))
    total = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("by")), lambda acc, _: F.struct((acc["sum"] + per_year * acc["by"]).alias("sum"), (acc["by"] * (1 + cpi)).alias("by")), lambda acc: acc["sum"])
    return round_up(total, 2)
