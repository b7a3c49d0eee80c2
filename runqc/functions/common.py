"""Small Column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(part: Column, whole: Column) -> Column:
    """Percentage with 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Ordered rules to a CASE: the first satisfied condition wins."""
    expr = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def messages(*conditional: Column) -> Column:
    """Array of the non-null messages, in order."""
    return F.filter(F.array(*conditional), lambda m: m.isNotNull())


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def is_present(c: Column | str, kind: str = "string") -> Column:
    """Truthiness of a document field: not null, not empty, not zero."""
    c = col_of(c)
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def fixed1(x: Column | str) -> Column:
    """One decimal place of 0 <= x < 200 as text, rounding the exact binary value half to even.

    This is what printf prints; Spark's own rounding works on the shortest decimal form, which
    differs for values such as 14.85. Scaling by a power of two is exact, so integers decide.
    """

    def tenths(bits: int) -> Column:
        scaled = (col_of(x) * F.lit(2.0**bits)).cast("bigint") * 10
        whole, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit(2**bits - 1))
        half = F.lit(2 ** (bits - 1))
        return whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)

    rounded = F.when(col_of(x) < 2, tenths(58)).otherwise(tenths(52))
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))
