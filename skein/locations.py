"""Places in a run: dotted paths of steps, N(ode), L(oop round) and M(ap element), as in ``-.N1.L0.M7``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from skein.ir import SELF, Apply, Const, Each, Graph, GraphError, Node, Ref, Repeat

_STEP = re.compile(r"([NLM])(-?\d+)$")


@dataclass(frozen=True)
class Location:
    steps: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def parse(text: str) -> Location:
        root, *rest = text.split(".")
        found = [_STEP.match(s) for s in rest]
        if root != "-" or not all(found):
            raise GraphError(f"no location: {text}")
        return Location(tuple((m[1], int(m[2])) for m in found))

    def __str__(self) -> str:
        return ".".join(["-", *[f"{k}{i}" for k, i in self.steps]])

    def node(self, index: int) -> Location:
        return Location((*self.steps, ("N", index)))

    def turn(self, index: int) -> Location:
        return Location((*self.steps, ("L", index)))

    def element(self, index: int) -> Location:
        return Location((*self.steps, ("M", index)))

    def parent(self) -> Location | None:
        """Round i-1 for a later loop round, else the path without its last step."""
        if not self.steps:
            return None
        kind, index = self.steps[-1]
        return Location((*self.steps[:-1], ("L", index - 1))) if kind == "L" and index > 0 else Location(self.steps[:-1])

    def pop_first(self) -> tuple[tuple[str, int], Location]:
        return self.steps[0], Location(self.steps[1:])

    def pop_last(self) -> tuple[tuple[str, int], Location]:
        return self.steps[-1], Location(self.steps[:-1])

    def last_index(self) -> int:
        return self.steps[-1][1] if self.steps else 0


def _body(graph: Graph, ref: Ref) -> Graph:
    if ref == SELF:
        return graph
    node = graph.nodes[ref[0]]
    if not isinstance(node, Const) or not isinstance(node.value, Graph):
        raise GraphError("the body of this node is known only when it runs")
    return node.value


def find(graph: Graph, location: Location) -> tuple[Node, Graph]:
    """The node at a location, and the graph that holds it."""
    here, node = graph, None
    for kind, index in location.steps:
        if kind == "N":
            if node is not None:
                if not isinstance(node, (Apply, Repeat, Each)):
                    raise GraphError(f"no graph inside the node before N{index} of {location}")
                here = _body(here, node.graph)
            if not 0 <= index < len(here.nodes):
                raise GraphError(f"no node {index} at {location}")
            node = here.nodes[index]
        elif not isinstance(node, Repeat if kind == "L" else Each):
            raise GraphError(f"{kind}{index} of {location} is inside no {'loop' if kind == 'L' else 'map'}")
    if node is None:
        raise GraphError("the root is no node of the graph")
    return node, here
