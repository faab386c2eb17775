"""Graphs that take graphs: pairs of lists, choice among graphs by name, compile-and-run pipelines."""

from __future__ import annotations

from skein.builder import Builder, Elements, fold
from skein.ir import Graph

__all__ = ["choose_by_name", "compile_and_run", "fold", "map_pairs"]


def map_pairs(body: Graph, a: str, b: str) -> Graph:
    """Runs ``body`` on the elements of two equally long lists."""
    g = Builder(a, b)
    return g.outputs(value=g.map(body, **{a: Elements(g[a]), b: Elements(g[b])}))


def choose_by_name(graphs: dict[str, Graph]) -> Graph:
    """One of several graphs with one input ``value`` each, by the input ``name``; an unknown name takes the last."""
    names = list(graphs)
    g = Builder("name", "value")
    picked = g.eval(graphs[names[-1]], value=g["value"])
    for n in reversed(names[:-1]):
        picked = g.ifelse(g.task("str_eq", a=g["name"], b=n), g.eval(graphs[n], value=g["value"]), picked)
    return g.outputs(value=picked)


def compile_and_run(compile_task: str, run_task: str, item: str = "circuit", shots: str = "n_shots") -> Graph:
    """Compiles each item of a list and runs it with its number of shots."""
    body = Builder(item, shots)
    ready = body.task(compile_task, **{item: body[item]})
    inner = body.outputs(value=body.task(run_task, **{item: ready, shots: body[shots]}))
    return map_pairs(inner, item, shots)
