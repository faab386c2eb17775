"""Graphs: golden values, laziness, errors, loops, user tasks."""

from typing import NamedTuple

import pytest

from skein.builder import Builder, Elements, script
from skein.ir import Graph, GraphError, Input, Output, from_json, kind_of, to_json
from skein.plans import graphs as G
from skein.plans.frames import run
from skein.udf import Worker

worker = Worker("t")


class Pair(NamedTuple):
    a: int
    b: str


@worker.task()
def pair(x: int) -> Pair:
    return Pair(x + 1, str(x))


@worker.task()
def only_even(x: int) -> int:
    if x % 2:
        raise ValueError("odd")
    return x // 2


@worker.task()
def hello(name: str, greeting: str = "hello") -> str:
    return f"{greeting} {name}"


def one(spark, graph, **inputs):
    return run(spark.range(1), graph, keep=[], **inputs).collect()[0].asDict()


@pytest.mark.parametrize(
    "graph, inputs, want",
    [
        (G.doubler(), {"value": 6}, {"value": 12}),
        (G.doubler_plus(), {"x": 6, "intercept": 0}, {"value": 12}),
        (G.nested(), {"value": 3, "intercept": 0}, {"value": 12}),
        (G.map_plus(), {"value": list(range(21)), "intercept": 6}, {"value": [2 * i + 6 for i in range(21)]}),
        (G.map_plus(), {"value": [], "intercept": 6}, {"value": []}),
        (G.maps_in_series(), {"value": list(range(21))}, {"value": [4 * i for i in range(21)]}),
        (G.map_two(), {"a": [1, 2], "b": [10, 20]}, {"value": [11, 22]}),
        (G.map_field(), {"value": [1, 2], "intercept": 1}, {"a": [1, 2], "value": [3, 5]}),
        (G.count_to(10), {"value": 6}, {"value": 10}),
        (G.count_to(10), {"value": 12}, {"value": 13}),
        (G.three_counters(6), {"x": 0, "y": 0, "z": 0}, {"acc1": 6, "acc2": 12, "acc3": 18}),
        (G.pick(), {"a": 7, "b": 0}, {"value": -1}),
        (G.pick(), {"a": -7, "b": 2}, {"value": -4}),
        (G.pick(eager=True), {"a": 7, "b": 0}, {"value": -1}),
        (G.factorial(), {"n": 4}, {"value": 24}),
        (G.factorial(), {"n": 5}, {"value": 120}),
        (G.factorial(), {"n": 0}, {"value": 1}),
        (G.gcd(), {"a": 1071, "b": 462}, {"value": 21}),
        (G.gcd(), {"a": 12, "b": 26}, {"value": 2}),
        (G.gcd(), {"a": 48, "b": 360}, {"value": 24}),
        (G.gcd(), {"a": 9357, "b": 5864}, {"value": 1}),
        (G.gcd(), {"a": 3, "b": 0}, {"value": 3}),
        (G.weighted_sum(), {"values": [1.0, 2.0], "weights": [3.0, 4.0]}, {"value": 11.0}),
        (G.by_name(), {"name": "double", "value": 7}, {"value": 14}),
        (G.by_name(), {"name": "square", "value": 7}, {"value": 49}),
    ],
)
def test_golden(spark, graph, inputs, want):
    assert one(spark, graph, **inputs) == want
    assert one(spark, from_json(to_json(graph)), **inputs) == want


def test_graph_checks():
    g = Graph()
    g.add(Input("a"))
    g.add(Output({"value": (0, "a")}))
    with pytest.raises(GraphError):
        g.add(Output({"value": (0, "a")}))
    with pytest.raises(GraphError):
        g.add(Output({"value": (9, "a")}))
    bound = g.bind(a=1)
    assert bound.inputs() == [] and g.inputs() == ["a"]
    with pytest.raises(GraphError):
        bound.missing({"a"})


def test_missing_input_is_an_error(spark):
    with pytest.raises(GraphError, match="intercept"):
        one(spark, G.doubler_plus(), x=1)


def test_dead_nodes_are_not_needed():
    b = Builder("a")
    b.task("t.only_even", x=b["a"])
    graph = b.outputs(value=b["a"])
    assert graph.needed() == {0, 2}
    assert [kind_of(graph.nodes[i]) for i in sorted(graph.needed())] == ["Input", "Output"]


def test_lists_of_unlike_length_raise(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, G.map_two(), a=[1, 2], b=[1])


def test_a_loop_beyond_its_bound_raises(spark):
    with pytest.raises(Exception, match="not finished"):
        one(spark, G.count_to(10_000), value=0)


def test_a_lazy_choice_keeps_user_tasks_from_other_rows(spark):
    b = Builder("x")
    even = b.task("eq", a=b.task("mod", a=b["x"], b=2), b=0)
    graph = b.outputs(value=b.ifelse(even, b.task("t.only_even", x=b["x"]), -1))
    got = run(spark.range(6), graph, keep=["id"], x="id").collect()
    assert {r.id: r.value for r in got} == {0: 0, 1: -1, 2: 1, 3: -1, 4: 2, 5: -1}
    eager = Builder("x")
    even = eager.task("eq", a=eager.task("mod", a=eager["x"], b=2), b=0)
    graph = eager.outputs(value=eager.eifelse(even, eager.task("t.only_even", x=eager["x"]), -1))
    with pytest.raises(Exception, match="odd"):
        run(spark.range(6), graph, keep=["id"], x="id").collect()


def test_user_tasks_in_maps_and_loops(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, [5])], "id long, v array<long>")
    inner = Builder("x")
    body = inner.outputs(value=inner.task("t.pair", x=inner["x"]).a)
    b = Builder("v")
    graph = b.outputs(value=b.map(body, x=Elements(b["v"])))
    got = run(df, graph, keep=["id"], keys=["id"], v="v").collect()
    assert {r.id: r.value for r in got} == {1: [4, 2], 2: [], 3: [6]}
    with pytest.raises(GraphError, match="keys"):
        run(df, graph, keep=["id"], v="v")
    body = Builder("x")
    new = body.task("t.pair", x=body["x"]).a
    loop = body.outputs(x=new, should_continue=body.task("igt", a=4, b=new))
    b = Builder("x")
    got = run(spark.range(7), b.outputs(value=b.loop(loop, x=b["x"]).x), keep=["id"], x="id").collect()
    assert {r.id: r.value for r in got} == {i: max(i + 1, 4) for i in range(7)}


def test_bundles_defaults_and_scripts(spark):
    b = Builder("x", "s")
    both = b.task("t.pair", x=b["x"])
    graph = b.outputs(a=both.a, b=both.b, hi=b.task("t.hello", name=b["s"]), up=b.task(script("tr a-z A-Z"), text=b["s"]))
    row = one(spark, graph, x=4, s="ann")
    assert row == {"a": 5, "b": "4", "hi": "hello ann", "up": "ANN"}


def test_signatures_are_checked():
    with pytest.raises(TypeError):

        @worker.task()
        def no_types(x):
            return x

    with pytest.raises(KeyError):
        from skein.udf import find

        find("t.nothing")


def test_unfold_and_gather_keep_order(spark):
    from skein.operators.relational import collect_ordered, unfold
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [5, 3, 9]), (2, [1])], "id long, v array<long>")
    back = collect_ordered(unfold(df, "v").repartition(3), ["id"], ["pos"], v=F.col("value"))
    assert {r.id: r.v for r in back.collect()} == {1: [5, 3, 9], 2: [1]}
