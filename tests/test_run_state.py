import datetime

from pyspark.sql import functions as F

from skein.operators import run_state as S
from skein.plans import graphs as G
from skein.sources.checkpoints import step

T0 = datetime.datetime(2024, 1, 1)
ROWS = [
    ("a", "-", "Apply", T0, None, None),
    ("a", "-.N1", "Repeat", T0, None, None),
    ("a", "-.N1.L0", "Apply", T0, T0 + datetime.timedelta(seconds=2), None),
    ("a", "-.N1.L1", "Apply", T0, None, None),
    ("a", "-.N1.L1.N3", "Call", T0, None, "bad"),
    ("a", "-.N10", "Call", None, None, None),
]
SCHEMA = "run string, location string, kind string, started timestamp, finished timestamp, error string"


def test_status_and_errors(spark):
    nodes = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.location: r.status for r in S.with_status(nodes).collect()}
    assert got["-.N1.L0"] == "Finished" and got["-.N1.L1.N3"] == "Error" and got["-.N1"] == "Started" and got["-.N10"] == "Not started"
    assert {r.location for r in S.errors_above(nodes).collect()} == {"-", "-.N1", "-.N1.L1", "-.N1.L1.N3"}  # not -.N10
    assert [r.location for r in S.children(nodes, "-.N1", "L").collect()] == ["-.N1.L0", "-.N1.L1"]
    assert {r.location: r.micros for r in S.timings(nodes).collect()}["-.N1.L0"] == 2_000_000
    assert [r.run for r in S.runs(nodes).collect()] == ["a"]


def test_parents(spark):
    df = spark.createDataFrame([("-",), ("-.N1",), ("-.N1.L0",), ("-.N1.L2",), ("-.N1.L2.N0.M7",)], "location string")
    got = {r.location: r.up for r in df.select("location", S.parent(F.col("location")).alias("up")).collect()}
    assert got == {"-": None, "-.N1": "-", "-.N1.L0": "-.N1", "-.N1.L2": "-.N1.L1", "-.N1.L2.N0.M7": "-.N1.L2.N0"}
    assert S.breadcrumbs("-.N1.L2") == [("-", "-"), ("N1", "-.N1"), ("L2", "-.N1.L2")]


def test_loop_edges(spark):
    df = spark.createDataFrame([("l", i, i * i) for i in range(3)], "loop string, turn int, value int")
    assert sorted((r.from_round, r.to_round, r.value) for r in S.loop_edges(df, ["loop"], "turn", "value").collect()) == [(0, 1, 0), (1, 2, 1)]


def test_graph_tables(spark):
    nodes, edges = S.graph_tables(spark, G.pick())
    assert edges.filter("conditional").count() == 2
    assert {r.kind for r in nodes.collect()} == {"Input", "Const", "Call", "Choose", "Output"}


def test_finished_steps_are_taken_up(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert step(spark, f"file://{tmp_path}", "one", make).count() == 3
    assert len(calls) == 1


def test_watching_a_run(spark, tmp_path):
    from skein.streaming.monitor import watch

    folder = f"{tmp_path}/state"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(folder)
    q = watch(spark, folder).writeStream.outputMode("update").format("memory").queryName("watched").start()
    try:
        q.processAllAvailable()
        assert {r.location: r.status for r in spark.table("watched").collect()}["-.N1.L0"] == "Finished"
    finally:
        q.stop()


def test_a_node_that_ends_hours_later(spark, tmp_path):
    """Updates come file by file, newer nodes in between; nothing known of a node is given up."""
    from skein.streaming.monitor import NODE_SCHEMA, watch

    folder = f"{tmp_path}/long"
    at = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    updates = [("r", "-.N1", "Call", at(1), None, None), ("r", "-.N2", "Call", at(9), at(9), None), ("r", "-.N1", "Call", at(1), at(3), None)]
    spark.createDataFrame(updates[:1], NODE_SCHEMA).write.parquet(folder)
    q = watch(spark, folder).writeStream.outputMode("complete").format("memory").queryName("long_watched").start()
    try:
        for k in range(3):
            if k:
                spark.createDataFrame(updates[k : k + 1], NODE_SCHEMA).write.mode("append").parquet(folder)
            q.processAllAvailable()
        assert {r.location: (r.status, r.finished) for r in spark.table("long_watched").collect()} == {"-.N1": ("Finished", at(3)), "-.N2": ("Finished", at(9))}
    finally:
        q.stop()
