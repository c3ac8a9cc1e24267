"""Arithmetic with the number semantics of the query language: nothing throws, NaN spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def num(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def nan() -> Column:
    return F.lit(math.nan)


def inf(sign: int = 1) -> Column:
    return F.lit(sign * math.inf)


def div(x: Column, y: Column) -> Column:
    x, y = num(x), num(y)
    by_zero = F.when(F.isnan(x) | (x == 0), nan()).when(x > 0, inf()).when(x < 0, inf(-1))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def mod(x: Column, y: Column) -> Column:
    x, y = num(x), num(y)
    return F.when(F.isnan(x) | F.isnan(y) | (y == 0) | (F.abs(x) == math.inf), nan()).when(F.abs(y) == math.inf, x).otherwise(F.try_mod(x, y))


def is_whole(x: Column) -> Column:
    """No number, or one without a fraction for its size: Spark's floor would end at the greatest long."""
    return F.isnan(x) | (F.abs(x) >= 2.0**53)


def round_half_up(x: Column) -> Column:
    x = num(x)
    return F.when(is_whole(x), x).otherwise(F.floor(x + 0.5).cast("double"))


def trunc(x: Column) -> Column:
    x = num(x)
    return F.when(is_whole(x), x).when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))


def whole(f):
    return lambda x: F.when(is_whole(num(x)), num(x)).otherwise(f(num(x)).cast("double"))


def log(x: Column, base=F.ln) -> Column:
    x = num(x)
    return F.when(F.isnan(x) | (x < 0), nan()).when(x == 0, inf(-1)).otherwise(base(x))


def sign(x: Column) -> Column:
    return F.when(F.isnan(num(x)), nan()).otherwise(F.signum(num(x)))


def least(*xs: Column) -> Column:
    return _extreme(F.least, xs, inf())


def greatest(*xs: Column) -> Column:
    return _extreme(F.greatest, xs, inf(-1))


def _extreme(f, xs, empty: Column) -> Column:
    if not xs:
        return empty
    if len(xs) == 1:
        return num(xs[0])
    bad = F.isnan(num(xs[0]))
    for x in xs[1:]:
        bad = bad | F.isnan(num(x))
    return F.when(bad, nan()).otherwise(f(*map(num, xs)))


def compare(op: str, x: Column, y: Column, numeric: bool) -> Column:
    if numeric:
        ok = ~F.isnan(num(x)) & ~F.isnan(num(y))
        x, y = num(x), num(y)
    else:
        ok = F.lit(True)
    table = {"eq": x == y, "neq": x != y, "lt": x < y, "lte": x <= y, "gr": x > y, "gre": x >= y}
    found = F.coalesce(table[op], F.lit(op == "neq"))
    return (~ok | found) if op == "neq" else (ok & found)


def truth(x: Column, kind: str) -> Column:
    if kind == "bool":
        return F.coalesce(x, F.lit(False))
    if kind == "num":
        return F.coalesce(~F.isnan(num(x)) & (num(x) != 0), F.lit(False))
    return F.coalesce(x != "", F.lit(False))
