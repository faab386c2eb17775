"""Strings, bytes and casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def equal(a: Column, b: Column) -> Column:
    return a == b


def unequal(a: Column, b: Column) -> Column:
    return a != b


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def encode(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def decode(b: Column) -> Column:
    """Strict UTF-8: bytes that are not valid raise."""
    return F.decode(b, "UTF-8")


def _float_text(x: Column) -> Column:
    """Python's form of a double, made from the JVM's digits (before Java 19 these are not always the shortest)."""
    text = x.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(text, "^-", "")
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1)
    whole = F.regexp_extract(plain, r"^(\d+)\.", 1)
    part = F.regexp_extract(plain, r"\.(\d+)", 1)
    e = F.coalesce(exponent.try_cast("int"), F.lit(0))
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    n = F.length(digits)
    left = e + 1  # digits before the point, when there is an exponent
    positional = F.when(left >= n, F.concat(F.rpad(digits, left, "0"), F.lit(".0"))).when(left > 0, F.concat(F.substring(digits, F.lit(1), left), F.lit("."), F.substring(digits, left + 1, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -left), digits))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    shaped = F.when(exponent == "", plain).when((e >= -4) & (e < 16), positional).otherwise(scientific)
    # a long number without exponent never reaches 1e16: from 1e7 on the engine writes one
    return F.when(F.isnan(x), "nan").when(plain == "Infinity", F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, shaped))


def to_text(value: Column) -> Column:
    kind = F.typeof(value)
    return F.when(kind == "boolean", F.initcap(value.cast("string"))).when(kind == "double", _float_text(value.cast("string").try_cast("double"))).otherwise(value.cast("string"))


def to_int(value: Column) -> Column:
    """Cuts floats towards 0; text must be an integer, blanks around it aside."""
    kind = F.typeof(value)
    text = F.trim(value.cast("string"))
    bad = (kind == "string") & ~text.rlike(r"^[+-]?\d+$")
    return F.when(bad, F.raise_error(F.concat(F.lit("not an integer: "), text)).cast("long")).otherwise(value.cast("long"))


TASKS = {"str_eq": equal, "str_neq": unequal, "concat": concat, "encode": encode, "decode": decode, "str": to_text, "int": to_int}
