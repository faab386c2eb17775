"""Booleans, identity, pairs, and waiting."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, functions as F


def negate(a: Column) -> Column:
    return ~a


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def truthy(x: Column) -> Column:
    """Truth of a value: null, zero, and what is empty are false."""
    kind = F.typeof(x)
    text = x.cast("string")
    number = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    return F.coalesce(F.when(kind == "boolean", text == "true").when(number, text.try_cast("double") != 0).otherwise(F.length(text) > 0), F.lit(False))


def every(values: Column) -> Column:
    """True for an empty list."""
    return F.forall(values, truthy)


def some(values: Column) -> Column:
    return F.exists(values, truthy)


def identity(value: Column) -> Column:
    return value


def pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("_1"), b.alias("_2"))


def unpair(a: Column) -> dict[str, Column]:
    return {"a": a["_1"], "b": a["_2"]}


def sleep(seconds: Column) -> Column:
    """Waits once for each value and gives true back; the plan must not be retried for free."""

    @F.pandas_udf("boolean")
    def wait(delays: pd.Series) -> pd.Series:
        for d in delays:
            time.sleep(max(0.0, float(d)))
        return pd.Series([True] * len(delays))

    return wait.asNondeterministic()(seconds.cast("double"))


TASKS = {
    "neg": negate,
    "and": both,
    "or": either,
    "all": every,
    "any": some,
    "id": identity,
    "tuple": pair,
    "untuple": unpair,
    "sleep": sleep,
}
