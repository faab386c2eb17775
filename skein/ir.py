"""Program graphs: nodes, ports and their checks.

A port is named by (node index, port name).  A graph is a value too, so it can stand in a
constant and be applied by an ``Apply``, ``Repeat`` or ``Each`` node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

Ref = tuple[int, str]
#: Index and port by which a graph names itself.
SELF: Ref = (-1, "body")


class GraphError(ValueError):
    """A graph that cannot be built or run; the message names the place."""


@dataclass(frozen=True)
class Input:
    name: str


@dataclass(frozen=True)
class Output:
    ports: dict[str, Ref]


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Call:
    """A task by its full name: ``worker.task``, or a built-in name alone."""

    task: str
    ports: dict[str, Ref]


@dataclass(frozen=True)
class Apply:
    """Runs a graph on inputs."""

    graph: Ref
    ports: dict[str, Ref]


@dataclass(frozen=True)
class Repeat:
    """Do-while: runs the body, then again while its ``go_on`` port is true.  Inputs that the body does not put out stay as they are."""

    graph: Ref
    ports: dict[str, Ref]
    go_on: str = "should_continue"
    limit: int | None = None


@dataclass(frozen=True)
class Each:
    """Runs the body for each element of the ports in ``over``; other ports are the same for all elements."""

    graph: Ref
    ports: dict[str, Ref]
    over: tuple[str, ...]


@dataclass(frozen=True)
class Choose:
    """A value by a predicate; only the branch taken is computed unless ``eager``."""

    test: Ref
    yes: Ref
    no: Ref
    eager: bool = False


Node = Input | Output | Const | Call | Apply | Repeat | Each | Choose


@dataclass
class Graph:
    nodes: list[Node] = field(default_factory=list)
    output: int | None = None
    #: Inputs that are bound already (partial application).
    bound: dict[str, Any] = field(default_factory=dict)

    def add(self, node: Node) -> int:
        for index, port in refs_of(node):
            if (index, port) != SELF and not 0 <= index < len(self.nodes):
                raise GraphError(f"port {port} of node {index} does not exist yet")
        if isinstance(node, Output):
            if self.output is not None:
                raise GraphError("a graph has one output node")
            self.output = len(self.nodes)
        self.nodes.append(node)
        return len(self.nodes) - 1

    def inputs(self) -> list[str]:
        return list(dict.fromkeys(n.name for n in self.nodes if isinstance(n, Input) and n.name not in self.bound))

    def outputs(self) -> dict[str, Ref]:
        if self.output is None:
            raise GraphError("the graph has no output node")
        return self.nodes[self.output].ports

    def bind(self, **values: Any) -> Graph:
        """Partial application: a graph with some inputs fixed."""
        if twice := set(values) & set(self.bound):
            raise GraphError(f"inputs are bound twice: {sorted(twice)}")
        return Graph(self.nodes, self.output, self.bound | values)

    def missing(self, given: set[str]) -> set[str]:
        if twice := given & set(self.bound):
            raise GraphError(f"inputs are both bound and given: {sorted(twice)}")
        return set(self.inputs()) - given

    def needed(self) -> set[int]:
        """Nodes that the output depends on; all others are dead."""
        seen: set[int] = set()
        todo = [self.output] if self.output is not None else []
        while todo:
            i = todo.pop()
            if i in seen or i < 0:
                continue
            seen.add(i)
            todo += [r[0] for r in refs_of(self.nodes[i])]
        return seen

    def edges(self) -> Iterator[tuple[int, str, int, str]]:
        """(from node, from port, to node, to port)."""
        for i, n in enumerate(self.nodes):
            for port, (src, out) in ports_of(n).items():
                yield src, out, i, port


def ports_of(node: Node) -> dict[str, Ref]:
    match node:
        case Output(ports) | Call(_, ports):
            return ports
        case Apply(graph, ports) | Repeat(graph, ports) | Each(graph, ports):
            return {"body": graph, **ports}
        case Choose(test, yes, no):
            return {"pred": test, "if_true": yes, "if_false": no}
    return {}


def refs_of(node: Node) -> list[Ref]:
    return list(ports_of(node).values())


def kind_of(node: Node) -> str:
    return "EagerChoose" if isinstance(node, Choose) and node.eager else type(node).__name__


def calls_of(graph: Graph, seen: set[int] | None = None) -> set[str]:
    """Names of all tasks that a graph and the graphs inside it call."""
    seen = set() if seen is None else seen
    if id(graph) in seen:
        return set()
    seen.add(id(graph))
    out: set[str] = set()
    for n in graph.nodes:
        if isinstance(n, Call):
            out.add(n.task)
        if isinstance(n, Const) and isinstance(n.value, Graph):
            out |= calls_of(n.value, seen)
    return out


def to_json(graph: Graph) -> dict:
    """A graph as plain JSON values."""

    def value(v: Any) -> Any:
        return {"graph": to_json(v)} if isinstance(v, Graph) else {"literal": v}

    nodes = []
    for n in graph.nodes:
        d: dict[str, Any] = {"kind": type(n).__name__}
        for k, v in vars(n).items():
            d[k] = value(v) if isinstance(n, Const) else {p: list(r) for p, r in v.items()} if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v
        nodes.append(d)
    return {"nodes": nodes, "bound": {k: value(v) for k, v in graph.bound.items()}}


_KINDS = {c.__name__: c for c in (Input, Output, Const, Call, Apply, Repeat, Each, Choose)}


def from_json(data: dict) -> Graph:
    def value(v: dict) -> Any:
        return from_json(v["graph"]) if "graph" in v else v["literal"]

    def ref(r: list) -> Ref:
        return (r[0], r[1])

    graph = Graph()
    for d in data["nodes"]:
        fields = {k: v for k, v in d.items() if k != "kind"}
        if d["kind"] == "Const":
            fields["value"] = value(fields["value"])
        if "ports" in fields:
            fields["ports"] = {p: ref(r) for p, r in fields["ports"].items()}
        for k in ("graph", "test", "yes", "no"):
            if k in fields:
                fields[k] = ref(fields[k])
        if "over" in fields:
            fields["over"] = tuple(fields["over"])
        graph.add(_KINDS[d["kind"]](**fields))
    graph.bound = {k: value(v) for k, v in data.get("bound", {}).items()}
    return graph
