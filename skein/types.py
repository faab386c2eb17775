"""Python annotations as Spark types, and Python values as literals."""

from __future__ import annotations

import types
import typing
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F, types as T

COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
NDARRAY = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])

_PLAIN = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), complex: COMPLEX, type(None): T.NullType()}


@dataclass(frozen=True)
class Codec:
    """In ``Annotated[T, Codec(...)]``: how a value of a type of one's own travels in a column."""

    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]
    stored: Any = bytes


def codec_of(hint: Any) -> Codec | None:
    return next((m for m in typing.get_args(hint)[1:] if isinstance(m, Codec)), None) if typing.get_origin(hint) is typing.Annotated else None


def spark_type(hint: Any) -> T.DataType:
    """Spark type of an annotation; what has none raises TypeError (dates, UUIDs, sets, open classes)."""
    if isinstance(hint, T.DataType):
        return hint
    if hint in _PLAIN:
        return _PLAIN[hint]
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is typing.Annotated:
        codec = codec_of(hint)
        return spark_type(codec.stored if codec else args[0])
    if origin in (typing.Union, types.UnionType):
        some = [a for a in args if a is not type(None)]
        if set(some) == {int, float}:
            return T.DoubleType()
        kinds = [spark_type(a) for a in some]
        return kinds[0] if all(k == kinds[0] for k in kinds) else T.VariantType()
    if origin in (list, Sequence) or hint in (list, Sequence):
        return T.ArrayType(spark_type(args[0]) if args else T.VariantType())
    if origin is tuple:
        if len(args) == 2 and args[1] is ...:
            return T.ArrayType(spark_type(args[0]))
        return T.StructType([T.StructField(f"_{i}", spark_type(a)) for i, a in enumerate(args, 1)])
    if origin in (dict, Mapping):
        if args[0] is not str:
            raise TypeError("keys of a mapping must be strings")
        return T.MapType(T.StringType(), spark_type(args[1]))
    if isinstance(hint, type) and hasattr(hint, "_fields"):
        fields = typing.get_type_hints(hint)
        return T.StructType([T.StructField(n, spark_type(fields[n])) for n in hint._fields])
    if isinstance(hint, typing.TypeVar):
        return T.VariantType()
    raise TypeError(f"no column type for {hint!r}")


def is_admitted(hint: Any) -> bool:
    try:
        spark_type(hint)
    except TypeError:
        return False
    return True


def type_of(value: Any) -> T.DataType:
    """Spark type of a Python value; lists of unlike values are of the variant type."""
    if type(value) in _PLAIN:
        return _PLAIN[type(value)]
    if hasattr(value, "_fields"):
        return T.StructType([T.StructField(n, type_of(getattr(value, n))) for n in value._fields])
    if isinstance(value, tuple):
        return T.StructType([T.StructField(f"_{i}", type_of(x)) for i, x in enumerate(value, 1)])
    if isinstance(value, list):
        kinds = [type_of(x) for x in value if x is not None]
        if {type(k) for k in kinds} == {T.LongType, T.DoubleType}:
            kinds = [T.DoubleType()]
        return T.ArrayType(T.VariantType() if any(k != kinds[0] for k in kinds) else kinds[0] if kinds else T.LongType())
    if isinstance(value, dict):
        kinds = [type_of(x) for x in value.values()]
        return T.MapType(T.StringType(), kinds[0] if kinds and all(k == kinds[0] for k in kinds) else T.VariantType())
    raise TypeError(f"no column type for {type(value).__name__}")


def literal(value: Any) -> Column:
    """A Python value as a Column of its type."""
    kind = type_of(value)
    if isinstance(value, complex):
        return F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    if isinstance(value, (bool, str, bytes)) or value is None:
        return F.lit(value)
    if isinstance(value, (int, float)):
        return F.lit(value).cast(kind)
    if isinstance(value, list):
        if isinstance(kind.elementType, T.VariantType):
            import json

            return F.transform(F.array(*[F.lit(json.dumps(x)) for x in value]), F.parse_json)
        return F.array(*[literal(x) for x in value]).cast(kind)
    if isinstance(value, tuple):
        return F.struct(*[literal(x).alias(f.name) for x, f in zip(value, kind.fields, strict=True)])
    return F.create_map(*[c for k, v in value.items() for c in (F.lit(k), literal(v))]).cast(kind)
