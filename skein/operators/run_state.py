"""Questions about a run, over a table with one row per node:

run, location, kind, started (timestamp), finished (timestamp or null), error (text or null).
Locations are dotted paths such as ``-.N1.L0.M7``: node, loop round, map element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def status() -> Column:
    return F.when(F.col("finished").isNotNull(), "Finished").when(F.col("error").isNotNull(), "Error").when(F.col("started").isNotNull(), "Started").otherwise("Not started")


def with_status(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("status", status())


def runs(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run").agg(F.min("started").alias("started")).orderBy("started", "run")


def parent(location: Column) -> Column:
    """The place before: round i-1 for a later loop round, else the path without its last step."""
    last = F.regexp_extract(location, r"\.([NLM]-?\d+)$", 1)
    up = F.regexp_replace(location, r"\.[NLM]-?\d+$", "")
    turn = F.regexp_extract(last, r"^L(\d+)$", 1)
    return F.when(last == "", None).when((turn != "") & (turn != "0"), F.concat(up, F.lit(".L"), (turn.try_cast("long") - 1).cast("string"))).otherwise(up)


def ancestors(location: Column) -> Column:
    """All proper path prefixes, whole steps only: -.N1 is none of -.N10's."""
    parts = F.split(location, r"\.")
    return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def errors_above(nodes: DataFrame) -> DataFrame:
    """Nodes with an error of their own or below them."""
    bad = nodes.filter("error is not null").select("run", F.explode(F.concat(ancestors(F.col("location")), F.array("location"))).alias("location")).distinct()
    return nodes.join(bad, ["run", "location"], "left_semi")


def children(nodes: DataFrame, location: str, step: str) -> DataFrame:
    """Direct children of one kind: N nodes, L rounds, M elements."""
    n = F.regexp_extract(F.substring("location", len(location) + 1, 1 << 20), rf"^\.{step}(-?\d+)$", 1)
    return nodes.filter(F.startswith(F.col("location"), F.lit(location)) & (n != "")).withColumn("index", n.cast("long")).orderBy("run", "index")


def loop_edges(rounds: DataFrame, by: list[str], turn: str, value: str) -> DataFrame:
    """Edges from each round of a loop to the next."""
    w = Window.partitionBy(*by).orderBy(turn)
    return rounds.select(*by, F.col(turn).alias("from_round"), F.lead(turn).over(w).alias("to_round"), F.col(value).alias("value")).filter("to_round is not null")


def eval_view(spark, graph, nodes: DataFrame, run: str, location: str = "-") -> tuple[DataFrame, DataFrame]:
    """Nodes of a graph with their state in a run, and its edges; nodes that have no row have not started."""
    shape, edges = graph_tables(spark, graph)
    here = children(nodes.filter(F.col("run") == run), location, "N").select(F.col("index").cast("int").alias("id"), "started", "finished", "error")
    return shape.join(here, "id", "left").withColumn("status", status()), edges


def messages(nodes: DataFrame) -> DataFrame:
    """Error texts with their places."""
    return nodes.filter("error is not null").select("run", "location", "error")


def timings(nodes: DataFrame) -> DataFrame:
    return nodes.select("run", "location", (F.unix_micros("finished") - F.unix_micros("started")).alias("micros"))


def breadcrumbs(location: str) -> list[tuple[str, str]]:
    """(step, path up to it) from the root."""
    parts = location.split(".")
    return [(p, ".".join(parts[: i + 1])) for i, p in enumerate(parts)]


def graph_tables(spark, graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph that has not run; the edges to a choice's branches are conditional."""
    from skein.ir import Choose, kind_of

    nodes = [(i, kind_of(n), getattr(n, "task", None) or getattr(n, "name", None)) for i, n in enumerate(graph.nodes)]
    edges = [(a, p, b, q, isinstance(graph.nodes[b], Choose) and not graph.nodes[b].eager and q != "pred") for a, p, b, q in graph.edges()]
    return spark.createDataFrame(nodes, "id int, kind string, name string"), spark.createDataFrame(edges, "from_node int, from_port string, to_node int, to_port string, conditional boolean")
