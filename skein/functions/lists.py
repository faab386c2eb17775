"""Lists as arrays.  Positions count, so every gather sorts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _fail_if(test: Column, message: str, value: Column) -> Column:
    """``value``, unless ``test`` holds, which raises.  Both branches are typed by ``value``."""
    return F.when(~F.coalesce(test, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"), value)


def append(v: Column, a: Column) -> Column:
    return F.array_append(v, a)


def head(v: Column) -> dict[str, Column]:
    """First element and the rest; an empty list raises."""
    return {"head": _fail_if(F.size(v) == 0, "head of an empty list", F.get(v, F.lit(0))), "rest": _fail_if(F.size(v) == 0, "head of an empty list", F.slice(v, F.lit(2), F.size(v)))}


def length(v: Column) -> Column:
    return F.size(v).cast("long")


def zipped(a: Column, b: Column) -> Column:
    """Pairs up to the end of the shorter list."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def unzipped(v: Column) -> dict[str, Column]:
    empty = F.size(v) == 0
    return {"a": _fail_if(empty, "unzip of an empty list", F.transform(v, lambda p: p["_1"])), "b": _fail_if(empty, "unzip of an empty list", F.transform(v, lambda p: p["_2"]))}


def reverse(v: Column) -> Column:
    return F.reverse(v)


def extend(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def ordered(v: Column) -> Column:
    return F.array_sort(v)


def flat(v: Column) -> Column:
    return F.flatten(v)


def take(v: Column, n: Column) -> Column:
    """The first n; a negative n leaves off as many at the end."""
    count = F.when(n < 0, F.greatest(F.size(v) + n, F.lit(0))).otherwise(n)
    return F.slice(v, F.lit(1), count.cast("int"))


def drop(v: Column, n: Column) -> Column:
    """All but the first n; a negative n keeps as many at the end."""
    start = F.least(F.when(n < 0, F.greatest(F.size(v) + n, F.lit(0))).otherwise(n), F.size(v)).cast("int")
    return F.slice(v, start + 1, F.size(v) - start)


def gather(items: Column) -> Column:
    """List from (pos, v) structs in any order, as an aggregate over rows gives them."""
    return F.transform(F.array_sort(items), lambda x: x["v"])


TASKS = {
    "append": append,
    "head": head,
    "len": length,
    "zip": zipped,
    "unzip": unzipped,
    "reversed": reverse,
    "extend": extend,
    "concat_lists": extend,
    "sort_number_list": ordered,
    "sort_string_list": ordered,
    "flatten": flat,
    "take": take,
    "drop": drop,
    "fold_values": gather,
}
