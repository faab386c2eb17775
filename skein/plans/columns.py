"""Graphs as Column expressions: one projection, no shuffle.

``Each`` becomes ``transform``, ``fold`` and bounded loops become ``aggregate`` with a state
struct, and a graph that applies itself once becomes a pass down that stacks its arguments
and a pass up over the stack.  Loops stop at a bound; a row that would need more steps raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from skein.functions import BUILTINS, plain_name
from skein.ir import SELF, Apply, Call, Choose, Const, Each, Graph, GraphError, Input, Output, Ref, Repeat, refs_of
from skein.types import literal

Value = Column | Graph
#: Steps of a loop or a recursion where the graph names no bound.
LIMIT = 64


def calls_itself(graph: Graph) -> bool:
    return any(isinstance(n, Apply) and n.graph == SELF for n in graph.nodes)


class Columns:
    """Values of the ports of one application of a graph."""

    def __init__(self, graph: Graph, args: dict[str, Value], known: dict[int, dict[str, Value]] | None = None, limit: int = LIMIT):
        self.graph, self.args, self.limit = graph, args, limit
        self.known = dict(known or {})

    def outputs(self) -> dict[str, Value]:
        return {k: self.at(r) for k, r in self.graph.outputs().items()}

    def at(self, ref: Ref) -> Value:
        index, port = ref
        if ref == SELF:
            raise GraphError("a graph can apply itself only as the chosen branch of its output")
        if index not in self.known:
            self.known[index] = self._node(index)
        ports = self.known[index]
        if port not in ports:
            raise GraphError(f"node {index} has no port {port}; it has {sorted(ports)}")
        return ports[port]

    def _ports(self, ports: dict[str, Ref]) -> dict[str, Value]:
        return {k: self.at(r) for k, r in ports.items()}

    def _body(self, ref: Ref) -> Graph:
        body = self.at(ref)
        if not isinstance(body, Graph):
            raise GraphError("only a graph known when the plan is made can be applied")
        return body

    def _node(self, index: int) -> dict[str, Value]:
        match self.graph.nodes[index]:
            case Input(name):
                if name not in self.args:
                    raise GraphError(f"input {name} is missing")
                return {name: self.args[name]}
            case Const(value):
                return {"value": value if isinstance(value, Graph) else literal(value)}
            case Call(task, ports):
                return call(task, self._ports(ports), self.limit)
            case Apply(graph, ports):
                return apply(self._body(graph), self._ports(ports), self.limit)
            case Repeat(graph, ports, go_on, limit):
                return repeat(self._body(graph), self._ports(ports), go_on, limit or self.limit)
            case Each(graph, ports, over):
                return each(self._body(graph), self._ports(ports), over, self.limit)
            case Choose(test, yes, no, eager):
                pick = F.when(self.at(test), self.at(yes)).otherwise(self.at(no))
                if eager:  # a struct holds both, so both are computed
                    both = F.struct(self.at(test).alias("t"), self.at(yes).alias("y"), self.at(no).alias("n"))
                    pick = F.element_at(F.transform(F.array(both), lambda b: F.when(b["t"], b["y"]).otherwise(b["n"])), 1)
                return {"value": pick}
            case Output():
                raise GraphError("the output node has no ports")


def call(task: str, ports: dict[str, Value], limit: int = LIMIT) -> dict[str, Value]:
    from skein import udf

    task = plain_name(task)
    if task == "fold":
        func = ports["func"]
        return {"value": F.aggregate(ports["values"], ports["initial"], lambda acc, x: apply(func, {"a": x, "b": acc}, limit)["value"])}
    if task in BUILTINS:
        out = BUILTINS[task](**ports)
        return out if isinstance(out, dict) else {"value": out}
    if task.startswith("script:"):
        return {"value": udf.pipe(task.removeprefix("script:"), ports["text"])}
    found = udf.find(task)
    out = found.columns(ports)
    return {n: out[n] for n in found.returns.names} if found.bundle else {"value": out}


def apply(graph: Graph, args: dict[str, Value], limit: int = LIMIT) -> dict[str, Value]:
    if lost := graph.missing(set(args)):
        raise GraphError(f"inputs are missing: {sorted(lost)}")
    args = {k: v if isinstance(v, (Column, Graph)) else literal(v) for k, v in (graph.bound | args).items()}
    return recurse(graph, args, limit) if calls_itself(graph) else Columns(graph, args, limit=limit).outputs()


def _split(args: dict[str, Value]) -> tuple[dict[str, Column], dict[str, Graph]]:
    return {k: v for k, v in args.items() if isinstance(v, Column)}, {k: v for k, v in args.items() if isinstance(v, Graph)}


def _steps(limit: int, start: Column, step: Callable[[Column], Column]) -> Column:
    """``start`` stepped while its field ``go`` holds; raises if it still holds after ``limit`` steps."""
    done = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, lambda acc, _: F.when(acc["go"], step(acc)).otherwise(acc))
    return F.element_at(F.transform(F.array(done), lambda s: F.when(~s["go"] | F.raise_error(F.lit(f"not finished after {limit} steps")).cast("boolean"), s)), 1)


def repeat(body: Graph, args: dict[str, Value], go_on: str, limit: int) -> dict[str, Value]:
    plain, graphs = _split(args)

    def state(values: dict[str, Column]) -> Column:
        out = Columns(body, values | graphs, limit=limit).outputs()
        go = F.coalesce(out.pop(go_on), F.lit(True))  # only false ends a loop
        return F.struct(*[v.alias(k) for k, v in (values | out).items()], go.alias("go"))

    names = list(dict.fromkeys([*plain, *[p for p in body.outputs() if p != go_on]]))
    first = state(plain)
    last = _steps(limit, first, lambda acc: state({k: acc[k] for k in names}))
    return {k: last[k] for k in names}


def recurse(graph: Graph, args: dict[str, Value], limit: int) -> dict[str, Value]:
    """A graph whose output chooses between a plain value and one that applies the graph once more."""
    outs = graph.outputs()
    if len(outs) != 1:
        raise GraphError("a recursive graph has one output")
    (port, ref), own = next(iter(outs.items())), [i for i, n in enumerate(graph.nodes) if isinstance(n, Apply) and n.graph == SELF]
    node = graph.nodes[ref[0]] if ref[0] >= 0 else None
    if not isinstance(node, Choose) or len(own) != 1:
        raise GraphError("only a graph that applies itself once, in a branch of its output, can be planned")
    (again,) = own

    def holds(start: Ref) -> bool:
        seen, todo = set(), [start[0]]
        while todo:
            i = todo.pop()
            if i not in seen and i >= 0:
                seen.add(i)
                todo += [r[0] for r in refs_of(graph.nodes[i])]
        return again in seen

    deep, flat = (node.yes, node.no) if holds(node.yes) else (node.no, node.yes)
    if holds(flat) or holds(node.test):
        raise GraphError("a graph may apply itself in one branch only")
    plain, graphs = _split(args)

    def at(values: dict[str, Column], known: dict[int, dict[str, Value]] | None = None) -> Columns:
        return Columns(graph, values | graphs, known, limit)

    def goes_on(values: dict[str, Column]) -> Column:
        test = at(values).at(node.test)
        return F.coalesce(test if deep == node.yes else ~test, F.lit(deep != node.yes))

    def frame(values: dict[str, Column]) -> Column:
        return F.struct(*[values[k].alias(k) for k in plain])

    def down(acc: Column) -> Column:
        now = {k: acc["now"][k] for k in plain}
        c = at(now)
        then = {k: c.at(r) for k, r in graph.nodes[again].ports.items()}
        then = {k: then.get(k, now[k]) for k in plain}
        if tail:
            return F.struct(frame(then).alias("now"), goes_on(then).alias("go"))
        return F.struct(frame(then).alias("now"), F.array_append(acc["stack"], acc["now"]).alias("stack"), goes_on(then).alias("go"))

    tail = deep == (again, "value")  # nothing is left to do on the way up
    if tail:
        end = _steps(limit, F.struct(frame(plain).alias("now"), goes_on(plain).alias("go")), down)
        return {port: at({k: end["now"][k] for k in plain}).at(flat)}
    none = F.slice(F.array(frame(plain)), 1, 0)
    start = F.struct(frame(plain).alias("now"), none.alias("stack"), goes_on(plain).alias("go"))
    end = _steps(limit, start, down)
    base = at({k: end["now"][k] for k in plain}).at(flat)
    up = F.aggregate(F.reverse(end["stack"]), base, lambda acc, f: at({k: f[k] for k in plain}, {again: {"value": acc}}).at(deep))
    return {port: up}


def each(body: Graph, args: dict[str, Value], over: tuple[str, ...], limit: int) -> dict[str, Value]:
    lists = {k: args[k] for k in over}
    rest = {k: v for k, v in args.items() if k not in over}

    def one(values: dict[str, Column]) -> Column:
        out = apply(body, values | rest, limit)
        return out["value"] if set(out) == {"value"} else F.struct(*[v.alias(k) for k, v in out.items()])

    if len(lists) == 1:
        ((name, items),) = lists.items()
        made = F.transform(items, lambda x: one({name: x}))
    else:
        sizes = [F.size(v) for v in lists.values()]
        unequal = F.lit(False)
        for s in sizes[1:]:
            unequal = unequal | (s != sizes[0])
        count = F.when(~unequal | F.raise_error(F.lit("lists to go through differ in length")).cast("boolean"), sizes[0])
        places = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(1), count)
        made = F.transform(places, lambda i: one({k: F.get(v, i) for k, v in lists.items()}))
    ports = list(body.outputs())
    if ports == ["value"]:
        return {"value": made}

    def field(port: str) -> Column:
        return F.transform(made, lambda s: s[port])

    return {"value": made, **{p: field(p) for p in ports}}
