"""Arithmetic with Python's rules: floor division, remainder with the divisor's sign, half-to-even rounding, NaN equal to nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _pair(a: Column, b: Column, test: Column) -> Column:
    """A comparison that is false where a side is NaN, which Spark would order last and equal to itself."""
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return test & ~nan


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """True division; a zero divisor raises under ANSI mode."""
    return a.cast("double") / b.cast("double")


def mod(a: Column, b: Column) -> Column:
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def idivide(a: Column, b: Column) -> Column:
    inexact = (a % b != 0) & (((a % b) < 0) != (b < 0))
    return F.call_function("div", a, b) - F.when(inexact, 1).otherwise(0)


def gt(a: Column, b: Column) -> Column:
    return _pair(a, b, a > b)


def igt(a: Column, b: Column) -> Column:
    return a > b


def eq(a: Column, b: Column) -> Column:
    return _pair(a, b, a == b)


def neq(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def conjugate(z: Column) -> Column:
    return F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))


def ipow(a: Column, b: Column) -> Column:
    """Exact power; a negative exponent raises, as the result would not be an integer."""
    exact = F.aggregate(F.array_repeat(a.cast("long"), b.cast("int")), F.lit(1).cast("long"), lambda p, x: p * x)
    return F.when(b < 0, F.raise_error(F.lit("ipow needs an exponent of 0 or more")).cast("long")).otherwise(exact)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def absolute(a: Column) -> Column:
    return F.abs(a)


def rounded(a: Column) -> Column:
    return F.bround(a, 0).cast("long")


def rand_int(low: Column, high: Column, seed: int | None = None) -> Column:
    """Uniform between both ends, which are included."""
    return F.floor(F.rand(seed) * (high - low + 1) + low).cast("long")


TASKS = {
    "iadd": add,
    "add": add,
    "isubtract": subtract,
    "subtract": subtract,
    "itimes": times,
    "times": times,
    "divide": divide,
    "idivide": idivide,
    "mod": mod,
    "igt": igt,
    "gt": gt,
    "eq": eq,
    "neq": neq,
    "conjugate": conjugate,
    "ipow": ipow,
    "pow": power,
    "abs": absolute,
    "round": rounded,
    "rand_int": rand_int,
}
