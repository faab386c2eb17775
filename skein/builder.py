"""Typed construction of graphs.

A handle ``Port[T]`` carries the Python type of the value it stands for.  Types are for the
reader and for type checkers, and for choosing a Spark type where a literal needs one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from skein.ir import SELF, Apply, Call, Choose, Const, Each, Graph, GraphError, Input, Output, Ref, Repeat


@dataclass(frozen=True)
class Port[T]:
    ref: Ref

    def __getattr__(self, name: str) -> Port:
        """Another output port of the same node."""
        if name.startswith("_"):
            raise AttributeError(name)
        return Port((self.ref[0], name))


@dataclass(frozen=True)
class Elements[T]:
    """A list of which each element is meant."""

    port: Port


class Builder:
    """Makes a graph step by step; inputs are named, and ``outputs`` closes it."""

    def __init__(self, *inputs: str):
        self.graph = Graph()
        self.input: dict[str, Port] = {n: Port((self.graph.add(Input(n)), n)) for n in inputs}

    def __getitem__(self, name: str) -> Port:
        return self.input[name]

    def _ref(self, x: Any) -> Ref:
        return x.ref if isinstance(x, Port) else self.const(x).ref

    def _refs(self, ports: Mapping[str, Any]) -> dict[str, Ref]:
        return {k: self._ref(v) for k, v in ports.items()}

    def const(self, value: Any) -> Port:
        return Port((self.graph.add(Const(value)), "value"))

    def task(self, name: str, /, *args: Any, **ports: Any) -> Port:
        """Calls a task; positional arguments take the task's own argument names."""
        from skein.udf import argument_names

        if args:
            ports = dict(zip(argument_names(name), args, strict=False)) | ports
        return Port((self.graph.add(Call(name, self._refs(ports))), "value"))

    def ref(self) -> Port:
        """This very graph, for recursion."""
        return Port(SELF)

    def _body(self, body: Graph | Builder | Port) -> Ref:
        if isinstance(body, Builder):
            body = body.graph
        return body.ref if isinstance(body, Port) else self.const(body).ref

    def eval(self, body: Graph | Builder | Port, /, **ports: Any) -> Port:
        return Port((self.graph.add(Apply(self._body(body), self._refs(ports))), "value"))

    def loop(self, body: Graph | Builder | Port, /, go_on: str = "should_continue", limit: int | None = None, **ports: Any) -> Port:
        return Port((self.graph.add(Repeat(self._body(body), self._refs(ports), go_on, limit)), "value"))

    def map(self, body: Graph | Builder | Port | Callable[..., Any], elements: Any = None, /, **ports: Any) -> Port:
        """Runs ``body`` for each element.  Lists to go through are given as ``Elements`` or as ``elements`` for a one-input body.

        A callable body makes a graph from the element handles.
        """
        if elements is not None:
            ports = {"value": Elements(elements), **ports}
        over = tuple(k for k, v in ports.items() if isinstance(v, Elements))
        if not over:
            raise GraphError("a map needs a list to go through")
        if callable(body) and not isinstance(body, (Graph, Builder, Port)):
            inner = Builder(*ports)
            made = body(inner, *[inner[k] for k in ports])
            inner.outputs(**made) if isinstance(made, dict) else inner.outputs(value=made)
            body = inner
        plain = {k: self._ref(v.port if isinstance(v, Elements) else v) for k, v in ports.items()}
        return Port((self.graph.add(Each(self._body(body), plain, over)), "value"))

    def ifelse(self, test: Any, yes: Any, no: Any) -> Port:
        return Port((self.graph.add(Choose(self._ref(test), self._ref(yes), self._ref(no))), "value"))

    def eifelse(self, test: Any, yes: Any, no: Any) -> Port:
        return Port((self.graph.add(Choose(self._ref(test), self._ref(yes), self._ref(no), eager=True)), "value"))

    def outputs(self, **ports: Any) -> Graph:
        self.graph.add(Output(self._refs(ports)))
        return self.graph


def fold(func: Graph | Builder) -> Graph:
    """A graph over ``values`` and ``initial`` that folds ``func`` (inputs a, b; output value) from the left."""
    g = Builder("values", "initial")
    return g.outputs(value=g.task("fold", values=g["values"], initial=g["initial"], func=func.graph if isinstance(func, Builder) else func))


def script(command: str) -> str:
    """Name of a task that sends a text through a shell command, one process for each batch of rows."""
    return f"script:{command}"
