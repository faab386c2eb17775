from typing import Annotated

import pytest
from pyspark.sql import functions as F

from skein.builder import Builder
from skein.ir import Call, Each, GraphError, Input, Repeat
from skein.locations import Location, find
from skein.operators import relational as R, run_state as S
from skein.plans import graphs as G, library
from skein.plans.frames import run
from skein.resources import Needs, Router, profile
from skein.types import Codec
from skein.udf import Worker

worker = Worker("lib")


class Money:
    def __init__(self, cents: int):
        self.cents = cents


Cash = Annotated[Money, Codec(lambda m: str(m.cents), lambda s: Money(int(s)), str)]


@worker.task()
def twice(m: Cash) -> Cash:
    return Money(2 * m.cents)


@worker.task(capture=True)
def careful(x: int) -> int:
    return 10 // x


@worker.task()
def compiled(circuit: str) -> str:
    return circuit.upper()


@worker.task()
def shot(circuit: str, n_shots: int) -> str:
    return circuit * n_shots


@worker.table_task()
def counted(df):
    return df.groupBy("s").count()


def test_locations():
    text = "-.N1.L0.N3.L2.N0.M7.N10"
    loc = Location.parse(text)
    assert str(loc) == text and loc.last_index() == 10
    assert loc.pop_first() == (("N", 1), Location.parse("-.L0.N3.L2.N0.M7.N10"))
    assert loc.pop_last() == (("N", 10), Location.parse("-.N1.L0.N3.L2.N0.M7"))
    assert str(Location.parse("-.N1.L2").parent()) == "-.N1.L1" and str(Location.parse("-.N1.L0").parent()) == "-.N1"
    assert Location.parse("-").parent() is None
    assert str(Location().node(1).turn(0).element(3)) == "-.N1.L0.M3"
    with pytest.raises(GraphError):
        Location.parse("-.X1")


def test_nodes_by_location():
    graph = G.count_to(10)
    at = next(i for i, n in enumerate(graph.nodes) if isinstance(n, Repeat))
    node, inner = find(graph, Location.parse(f"-.N{at}.L0.N0"))
    assert node == Input("acc") and inner is not graph
    graph = G.maps_in_series()
    at = next(i for i, n in enumerate(graph.nodes) if isinstance(n, Each))
    assert isinstance(find(graph, Location.parse(f"-.N{at}.M3.N2"))[0], Call)
    for bad in ("-", "-.N99", "-.N0.L0", "-.N0.N1"):
        with pytest.raises(GraphError):
            find(graph, Location.parse(bad))


def test_codecs_and_captured_errors(spark):
    b = Builder("m", "x")
    safe = b.task("lib.careful", x=b["x"])
    graph = b.outputs(m=b.task("lib.twice", m=b["m"]), value=safe.value, error=safe.error)
    df = spark.createDataFrame([("5", 2), ("7", 0)], "m string, x long")
    got = sorted(run(df, graph, keep=[], m="m", x="x").collect())
    assert [r.m for r in got] == ["10", "14"]
    assert got[0].value == 5 and got[0].error is None
    assert got[1].value is None and got[1].error.startswith("ZeroDivisionError")


def test_table_tasks(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    assert {r["s"]: r["count"] for r in worker.on_table("counted", df).collect()} == {"a": 2, "b": 1}
    with pytest.raises(KeyError):
        worker.on_table("none", df)


def test_library_graphs(spark):
    df = spark.createDataFrame([(1, ["ab", "c"], [2, 3])], "id long, circuits array<string>, shots array<long>")
    graph = library.compile_and_run("lib.compiled", "lib.shot")
    assert run(df, graph, keep=["id"], keys=["id"], circuit="circuits", n_shots="shots").first().value == ["ABAB", "CCC"]
    chosen = library.choose_by_name({"double": G.doubler(), "quad": G.nested().bind(intercept=0), "same": _same()})
    names = spark.createDataFrame([("double", 3), ("quad", 3), ("other", 3)], "n string, v long")
    assert {r.n: r.value for r in run(names, chosen, keep=["n"], name="n", value="v").collect()} == {"double": 6, "quad": 12, "other": 3}


def _same():
    b = Builder("value")
    return b.outputs(value=b["value"])


def test_resources(spark):
    made = profile(Needs(cores=4, memory="2g", task_cores=2))
    assert made.taskResources["cpus"].amount == 2 and made.executorResources["cores"].amount == 4
    router = Router({"lib": Needs(cores=2)})
    assert router.needs("lib.twice").cores == 2
    with pytest.raises(KeyError):
        router.needs("other.task")
    assert Router({}, Needs()).needs("other.task") == Needs()


def test_arrays_and_spaces(spark):
    one = spark.range(1)
    data = F.array(*[F.lit(float(i)) for i in range(6)])
    shaped = one.select(R.reshape(F.array(F.lit(6)), data, [2, 3]).alias("a"), R.transpose(F.array(F.lit(2), F.lit(3)), data).alias("t"), R.at_point(R.pointed(data, F.lit(4))).alias("p")).first()
    assert shaped.a["shape"] == [2, 3] and shaped.t == [0, 3, 1, 4, 2, 5] and shaped.p == 4
    with pytest.raises(Exception, match="reshape"):
        one.select(R.reshape(F.array(F.lit(6)), data, [4])).collect()
    filled = spark.range(5).withColumn("g", F.lit(1)).withColumn("n", F.when(F.col("id") < 2, 2).otherwise(0))
    assert [r.space for r in R.split_space(filled, ["g"], "id", "n", 2, 2).orderBy("id").collect()] == ["core", "active", "active", "virtual", "virtual"]
    with pytest.raises(Exception, match="larger"):
        R.split_space(filled, ["g"], "id", "n", 5, 2).collect()
    found = [r.bits for r in R.configurations(spark, 4, 4, core=1, virtual=1).collect()]
    assert len(set(found)) == len(found) == 36
    assert all(b[:2] == "11" and b[-2:] == "00" and b[2:-2][0::2].count("1") == b[2:-2][1::2].count("1") == 2 for b in found)
    pool = spark.createDataFrame([(1, 10.0, 5), (2, 9.0, 3), (3, 1.0, 1)], "k long, score double, c long")
    assert R.greedy(pool, "k", "score", "c", 6) == [(2, 3), (3, 2)]


def test_eval_view(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [("a", "-.N0", "Input", t, t, None), ("a", "-.N3", "Call", t, None, "bad")]
    nodes = spark.createDataFrame(rows, "run string, location string, kind string, started timestamp, finished timestamp, error string")
    view, edges = S.eval_view(spark, G.pick(), nodes, "a")
    got = {r.id: r.status for r in view.collect()}
    assert got[0] == "Finished" and got[3] == "Error" and got[1] == "Not started"
    assert edges.count() == len(list(G.pick().edges()))
    assert [r.error for r in S.messages(nodes).collect()] == ["bad"]


SPINS = ("101010", "101100", "011100", "111111", "000000", "110110")


def test_spins_are_dealt_out(spark):
    df = spark.createDataFrame([(b,) for b in SPINS], "bits string")
    got = {r.bits for r in R.expand_configurations(df, "bits", "111000").collect()}
    want = set()
    for bits in SPINS:
        begun = [""]
        for i in range(3):
            pair = bits[2 * i : 2 * i + 2]
            begun = [b + x for b in begun for x in (("10", "01") if pair in ("10", "01") else (pair,))]
        want |= {b for b in begun if b[0::2].count("1") == 2 and b[1::2].count("1") == 1}
    assert got == want and len(got) == 4


def test_matrix_elements_by_operators(spark):
    """Against the operators themselves: strings of creations and annihilations with their signs."""
    import itertools
    import random

    n, rng = 3, random.Random(5)
    m = 2 * n
    h1 = [[rng.random() for _ in range(n)] for _ in range(n)]
    h1 = [[h1[min(i, j)][max(i, j)] for j in range(n)] for i in range(n)]
    h2 = {}
    for p, q, r, s in itertools.product(range(n), repeat=4):
        key = min((a, b) if (a, b) <= (c, d) else (c, d) for a, b in [tuple(sorted((p, q)))] for c, d in [tuple(sorted((r, s)))])
        other = tuple(sorted((r, s))) if key == tuple(sorted((p, q))) else tuple(sorted((p, q)))
        h2[p, q, r, s] = random.Random(repr((key, other))).random()

    def act(state, steps):
        """Result and sign of (place, create) steps, the last first."""
        state, sign = list(state), 1
        for place, create in reversed(steps):
            if state[place] == create:
                return None, 0
            sign *= (-1) ** sum(state[:place])
            state[place] = int(create)
        return tuple(state), sign

    def element(x, y):
        z = 0.0
        for p, q in itertools.product(range(m), repeat=2):
            if p % 2 == q % 2:
                got, sign = act(y, [(p, True), (q, False)])
                z += sign * h1[p // 2][q // 2] if got == x else 0
        for p, q, r, s in itertools.product(range(m), repeat=4):
            if p % 2 == q % 2 and r % 2 == s % 2:
                got, sign = act(y, [(p, True), (r, True), (s, False), (q, False)])
                z += sign * h2[p // 2, q // 2, r // 2, s // 2] / 2 if got == x else 0
        return z + (0.25 if x == y else 0)

    states = [x for x in itertools.product((0, 1), repeat=m) if sum(x) in (2, 3)]
    pairs = [(list(x), list(y)) for x in states for y in states]
    one = F.array(*[F.lit(v) for row in h1 for v in row])
    two = F.array(*[F.lit(h2[k]) for k in itertools.product(range(n), repeat=4)])
    df = spark.createDataFrame(pairs, "x array<int>, y array<int>")
    got = df.select("x", "y", R.matrix_element(F.col("x"), F.col("y"), one, two, n, 0.25).alias("e")).collect()
    for r in got:
        want = element(tuple(r.x), tuple(r.y)) if sum(r.x) == sum(r.y) else 0.0
        assert abs(r.e - want) < 1e-9, (r, want)


def _square(rows, score, least):
    """Pairs of one group by plain loops; lower triangle and mirror images."""
    out = []
    for g, i, v in rows:
        for h, j, w in rows:
            if g == h and None not in (g, i, j, v, w) and j <= i and abs(score(v, w)) > least:
                out += [(g, i, j, score(v, w))] + ([(g, j, i, score(v, w))] if i != j else [])
    return sorted(out)


@pytest.mark.parametrize("repeated", [False, True])
def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch, repeated):
    import random

    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "PAIRS", 100)
    rng = random.Random(9)
    rows = [(rng.choice((1, 2, None)), rng.choice((i, i, 5, None)), rng.choice((-3, -1, 0, 2, 4, None))) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, k long, v long")
    got = R.lower_triangle(df, "k", "v", "g", lambda a, b: 2 * a - b, F.lit(1), repeated=repeated)
    want = _square(rows, lambda a, b: 2 * a - b, 1)
    assert len(want) > 400 and sorted(tuple(r) for r in got.collect()) == want
    empty = R.lower_triangle(df.filter("false"), "k", "v", "g", lambda a, b: a, F.lit(1), repeated=repeated)
    assert empty.collect() == []


def test_pairs_of_one_group_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50, raising=False)
    monkeypatch.setattr(R, "PAIRS", 10_000, raising=False)
    df = spark.createDataFrame([(1, i, i % 90) for i in range(1000)], "g int, id long, v long")
    made = R.lower_triangle(df, "id", "v", "g", lambda a, b: a + b)
    tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1_000_000 and max(tasks) <= 100_000


def test_repeated_values_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def score(a, b):
        calls.add(1)
        return 10 * a - b

    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id", F.floor(F.col("id") % 8 / 2).alias("v"))
    made = R.lower_triangle(df, "id", "v", "g", score, F.lit(5), repeated=True)
    assert made.count() > 30_000 and calls.value <= 4 * 4 * 2


def test_greedy_goes_on_to_the_end(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.randint(1, 50), rng.randint(1, 9)) for k in range(300)]
    pool = spark.createDataFrame(rows, "k long, score long, c long")
    left, want = 700, []
    for k, s, c in sorted(rows, key=lambda r: (-r[1] / r[2], r[0])):
        if c <= left:
            left -= c
            want.append((k, left))
    assert len(want) > 100 and R.greedy(pool, "k", "score", "c", 700, step=40) == want


def test_only_names_of_python_take_a_prefix():
    from skein.functions import plain_name

    assert plain_name("x_abs") == "abs" and plain_name("builtins.add") == "add" and plain_name("my_add") == "my_add"
