"""Every built-in task, with the edges of its Python meaning."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import BUILTINS as B, plain_name
from skein.types import literal


def value(spark, task, *args):
    out = B[task](*[literal(a) for a in args])
    cols = out if isinstance(out, dict) else {"value": out}
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).collect()[0].asDict()
    return row if isinstance(out, dict) else row["value"]


@pytest.mark.parametrize(
    "task, args, want",
    [
        ("iadd", (2, 3), 5),
        ("add", (1, 2), 3),
        ("add", (1.5, 2.0), 3.5),
        ("isubtract", (2, 3), -1),
        ("subtract", (2.5, 1.0), 1.5),
        ("itimes", (-2, 3), -6),
        ("times", (0.5, 4.0), 2.0),
        ("divide", (1, 2), 0.5),
        ("idivide", (-7, 2), -4),
        ("idivide", (7, -2), -4),
        ("mod", (7, -3), -2),
        ("mod", (-7, 3), 2),
        ("mod", (6, -3), 0),
        ("igt", (3, 2), True),
        ("gt", (math.nan, 1.0), False),
        ("gt", (2.0, 1.0), True),
        ("eq", (math.nan, math.nan), False),
        ("eq", (1, 1), True),
        ("neq", (math.nan, math.nan), True),
        ("ipow", (3, 20), 3**20),
        ("ipow", (-2, 3), -8),
        ("ipow", (5, 0), 1),
        ("pow", (2.0, 0.5), 2**0.5),
        ("abs", (-3,), 3),
        ("round", (2.5,), 2),
        ("round", (3.5,), 4),
        ("round", (-0.5,), 0),
        ("neg", (True,), False),
        ("and", (True, False), False),
        ("or", (True, False), True),
        ("id", ("x",), "x"),
        ("tuple", (1, "a"), (1, "a")),
        ("untuple", ((1, "a"),), {"a": 1, "b": "a"}),
        ("str_eq", ("a", "a"), True),
        ("str_neq", ("a", "A"), True),
        ("concat", ("a", "é"), "aé"),
        ("encode", ("é",), "é".encode()),
        ("decode", ("é".encode(),), "é"),
        ("str", (True,), "True"),
        ("str", (-3,), "-3"),
        ("str", (1e16,), "1e+16"),
        ("str", (1.5e-5,), "1.5e-05"),
        ("str", (12345678.9,), "12345678.9"),
        ("str", (0.0001,), "0.0001"),
        ("int", (3.9,), 3),
        ("int", (-3.9,), -3),
        ("int", (" 12 ",), 12),
        ("int", (True,), 1),
        ("append", ([1], 2), [1, 2]),
        ("head", ([1, 2, 3],), {"head": 1, "rest": [2, 3]}),
        ("head", ([1],), {"head": 1, "rest": []}),
        ("len", ([1, 2],), 2),
        ("zip", ([1, 2, 3], ["a", "b"]), [(1, "a"), (2, "b")]),
        ("zip", ([], [1]), []),
        ("unzip", ([(1, "a"), (2, "b")],), {"a": [1, 2], "b": ["a", "b"]}),
        ("reversed", ([1, 2],), [2, 1]),
        ("extend", ([1], [2, 3]), [1, 2, 3]),
        ("concat_lists", ([], [2]), [2]),
        ("sort_number_list", ([3, 1, 2],), [1, 2, 3]),
        ("sort_string_list", (["b", "B", "é", "a"],), ["B", "a", "b", "é"]),
        ("flatten", ([[1], [], [2, 3]],), [1, 2, 3]),
        ("take", ([1, 2, 3], 5), [1, 2, 3]),
        ("take", ([1, 2, 3], -1), [1, 2]),
        ("take", ([1, 2, 3], -5), []),
        ("drop", ([1, 2, 3], 5), []),
        ("drop", ([1, 2, 3], -1), [3]),
        ("drop", ([1, 2, 3], -5), [1, 2, 3]),
        ("sum_list", ([],), 0.0),
        ("sum_int_list", ([1, 2],), 3),
        ("prod_list", ([],), 1.0),
        ("prod_int_list", ([2, 3, 4],), 24),
        ("mean", ([1.0, 2.0],), 1.5),
        ("max_item", ([1, 3, 2],), 3),
        ("min_item", ([1, 3, 2],), 1),
        ("all", ([],), True),
        ("any", ([],), False),
        ("all", ([1, 0],), False),
        ("any", (["", "a"],), True),
        ("sleep", (0.0,), True),
        ("conjugate", (1 + 2j,), (1.0, -2.0)),
    ],
)
def test_value(spark, task, args, want):
    got = value(spark, task, *args)
    plain = lambda x: tuple(x) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else bytes(x) if isinstance(x, bytearray) else x
    assert ({k: plain(v) for k, v in got.items()} if isinstance(got, dict) else plain(got)) == want


@pytest.mark.parametrize(
    "task, args",
    [("divide", (1, 0)), ("idivide", (1, 0)), ("mod", (1, 0)), ("head", ([],)), ("unzip", ([],)), ("mean", ([],)), ("max_item", ([],)), ("min_item", ([],)), ("ipow", (2, -1)), ("int", ("3.9",)), ("decode", (b"\xff",)), ("iadd", (2**63 - 1, 1))],
)
def test_errors_are_raised_not_nulls(spark, task, args):
    with pytest.raises(Exception):
        value(spark, task, *args)


def test_floor_division_matches_python(spark):
    pairs = [(a, b) for a in [*range(-15, 16), 2**63 - 1, -(2**63) + 1] for b in (-7, -3, -2, 2, 3, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", B["idivide"](F.col("a"), F.col("b")).alias("q"), B["mod"](F.col("a"), F.col("b")).alias("m")).collect():
        assert (r.q, r.m) == (r.a // r.b, r.a % r.b)


def test_random_is_within_both_ends(spark):
    got = {r.x for r in spark.range(500).select(B["rand_int"](F.lit(1), F.lit(3), 5).alias("x")).collect()}
    assert got == {1, 2, 3}


def test_names_with_a_prefix():
    assert plain_name("x_abs") == "abs" and plain_name("builtins.x_and") == "and" and plain_name("iadd") == "iadd"
    assert plain_name("worker.x_abs") == "worker.x_abs"


def test_every_task_has_a_test():
    tested = {c[0] for c in test_value.pytestmark[0].args[1]} | {"rand_int"}
    assert set(B) - tested == {"fold_values"}  # gathers are tested with graphs
