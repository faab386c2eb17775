"""Reductions of a list to one value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skein.functions.lists import _fail_if


def total(v: Column) -> Column:
    """0 for an empty list.  Sums are doubles here and integers in :func:`int_total`, as a plan has one type."""
    return F.aggregate(v, F.lit(0).cast("double"), lambda acc, x: acc + x.cast("double"))


def int_total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1).cast("double"), lambda acc, x: acc * x.cast("double"))


def int_product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1).cast("long"), lambda acc, x: acc * x.cast("long"))


def mean(v: Column) -> Column:
    return _fail_if(F.size(v) == 0, "mean of an empty list", total(v) / F.greatest(F.size(v), F.lit(1)))


def largest(v: Column) -> Column:
    """Raises for a list without values."""
    return F.coalesce(F.array_max(v), F.raise_error(F.lit("largest of an empty list")))


def smallest(v: Column) -> Column:
    """Raises for a list without values."""
    return F.coalesce(F.array_min(v), F.raise_error(F.lit("smallest of an empty list")))


TASKS = {"sum_list": total, "sum_int_list": int_total, "prod_list": product, "prod_int_list": int_product, "mean": mean, "max_item": largest, "min_item": smallest}
