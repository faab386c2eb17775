import datetime
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pytest
from pyspark.sql import types as T

from skein.types import is_admitted, literal, spark_type


class Point(NamedTuple):
    x: int
    y: float


@pytest.mark.parametrize(
    "hint, want",
    [
        (bool, T.BooleanType()),
        (int, T.LongType()),
        (int | float, T.DoubleType()),
        (str | None, T.StringType()),
        (bytes, T.BinaryType()),
        (list[int], T.ArrayType(T.LongType())),
        (Sequence[str], T.ArrayType(T.StringType())),
        (tuple[int, ...], T.ArrayType(T.LongType())),
        (dict[str, float], T.MapType(T.StringType(), T.DoubleType())),
        (Mapping[str, list[bytes]], T.MapType(T.StringType(), T.ArrayType(T.BinaryType()))),
        (int | str, T.VariantType()),
    ],
)
def test_annotations(hint, want):
    assert spark_type(hint) == want


@pytest.mark.parametrize("hint", [uuid.UUID, datetime.datetime, list[datetime.datetime], dict[int, int], set])
def test_rejected(hint):
    assert not is_admitted(hint)


def test_structs():
    assert spark_type(Point).simpleString() == "struct<x:bigint,y:double>"
    assert spark_type(tuple[int, str]).simpleString() == "struct<_1:bigint,_2:string>"
    assert spark_type(complex).simpleString() == "struct<re:double,im:double>"


@pytest.mark.parametrize("value", [True, False, 0, 1, "0", "test", 0.1, 15.2, None, [1, 2, 3], [], b"ab", {"a": 1}])
def test_literals_come_back(spark, value):
    got = spark.range(1).select(literal(value).alias("v")).collect()[0]["v"]
    assert (bytes(got) if isinstance(got, bytearray) else got) == value


def test_mixed_lists_are_variants(spark):
    row = spark.range(1).select(literal(["one", 1]).alias("v")).collect()[0]["v"]
    assert [v.toPython() for v in row] == ["one", 1]
