"""Graphs over whole tables, with steps that a Column expression cannot hold.

User tasks are Arrow-batched functions: they cannot run inside array functions, and a
``when`` would run them on rows of the other branch too.  So here a choice splits the table
by its predicate and unites the parts, a map explodes its list and gathers it in order again,
and a loop takes the table through rounds until no row is active.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.lists import gather
from skein.ir import Apply, Choose, Const, Each, Graph, GraphError, Input, Ref, Repeat, calls_of
from skein.plans import columns as C
from skein.sources.checkpoints import cut_lineage
from skein.udf import is_builtin

_FRESH = count()


def opaque(graph: Graph) -> bool:
    """Whether the graph calls anything but built-in tasks."""
    return any(not is_builtin(t) and t.removeprefix("builtins.") != "fold" for t in calls_of(graph))


def run(df: DataFrame, graph: Graph, /, keep: list[str] | None = None, keys: list[str] | None = None, limit: int = C.LIMIT, **inputs: str | Column | Graph | object) -> DataFrame:
    """Applies a graph to each row: the columns in ``keep`` and one column per output port.

    ``inputs`` binds ports to column names, Columns, graphs or values.  ``keys`` name columns that tell
    rows apart; a map with user tasks in its body needs them to gather its elements.
    Integers are taken as long and floats as double.
    """
    keep = list(df.columns) if keep is None else keep
    args = {}
    for k, v in inputs.items():
        args[k] = F.col(v) if isinstance(v, str) and v in df.columns else v
    if not opaque(graph):
        out = C.apply(graph, {k: _widened(df, v) for k, v in args.items()}, limit)
        return df.select(*keep, *[v.alias(k) for k, v in out.items()])
    frame = _Frame(df, keys, limit)
    bound = {k: frame.hold(_widened(df, v)) if isinstance(v, Column) else v for k, v in args.items()}
    out = frame.apply(graph, bound)
    return frame.df.select(*keep, *[frame.value(v).alias(k) for k, v in out.items()])


def _widened(df: DataFrame, value: object) -> object:
    if not isinstance(value, Column):
        return value
    kind = df.select(value.alias("x")).schema["x"].dataType.simpleString()
    wide = kind.replace("tinyint", "bigint").replace("smallint", "bigint").replace("float", "double")
    wide = "bigint" if wide == "int" else wide.replace("array<int>", "array<bigint>")
    return value.cast(wide) if wide != kind else value


class _Frame:
    """A table that grows by one column for each port that a later step needs."""

    def __init__(self, df: DataFrame, keys: list[str] | None, limit: int):
        self.df, self.keys, self.limit = df, keys, limit

    def hold(self, value: Column) -> str:
        name = f"_s{next(_FRESH)}"
        self.df = self.df.withColumn(name, value)
        return name

    def value(self, held: object) -> Column | Graph:
        return held if isinstance(held, Graph) else F.col(held) if isinstance(held, str) and held.startswith("_s") else C.literal(held)

    def apply(self, graph: Graph, args: dict[str, object]) -> dict[str, object]:
        if lost := graph.missing(set(args)):
            raise GraphError(f"inputs are missing: {sorted(lost)}")
        if not opaque(graph):
            out = C.apply(graph, {k: self.value(v) for k, v in args.items()}, self.limit)
            return {k: v if isinstance(v, Graph) else self.hold(v) for k, v in out.items()}
        if C.calls_itself(graph):
            raise GraphError("a graph with user tasks cannot apply itself; use a loop")
        known: dict[int, dict[str, object]] = {}
        return {k: self.at(graph, args, r, known) for k, r in graph.outputs().items()}

    def at(self, graph: Graph, args: dict[str, object], ref: Ref, known: dict[int, dict[str, object]]) -> object:
        index, port = ref
        if index not in known:
            known[index] = self.node(graph, args, index, known)
        return known[index][port]

    def node(self, graph: Graph, args: dict[str, object], index: int, known: dict[int, dict[str, object]]) -> dict[str, object]:
        def at(ref: Ref) -> object:
            return self.at(graph, args, ref, known)

        node = graph.nodes[index]
        match node:
            case Input(name):
                return {name: (graph.bound | args)[name]}
            case Const(value):
                return {"value": value if isinstance(value, Graph) else self.hold(C.literal(value))}
            case Apply(body, ports):
                return self.apply(at(body), {k: at(r) for k, r in ports.items()})
            case Choose(test, yes, no, False):
                return {"value": self.choose(graph, args, at(test), yes, no, known)}
            case Each(body, ports, over) if opaque(at(body)):
                return self.each(at(body), {k: at(r) for k, r in ports.items()}, over)
            case Repeat(body, ports, go_on, limit) if opaque(at(body)):
                return self.loop(at(body), {k: at(r) for k, r in ports.items()}, go_on, limit or self.limit)
        here = C.Columns(graph, {k: self.value(v) for k, v in args.items()}, limit=self.limit)
        for r in _direct(node):
            at(r)
        here.known = {i: {p: self.value(v) for p, v in ports.items()} for i, ports in known.items()}
        return {p: v if isinstance(v, Graph) else self.hold(v) for p, v in here._node(index).items()}

    def choose(self, graph: Graph, args: dict[str, object], test: str, yes: Ref, no: Ref, known: dict[int, dict[str, object]]) -> str:
        """Each branch sees only its own rows."""
        taken = F.coalesce(self.value(test), F.lit(False))
        before, parts, name = self.df.columns, [], f"_s{next(_FRESH)}"
        for rows, branch in ((self.df.filter(taken), yes), (self.df.filter(~taken), no)):
            side = _Frame(rows, self.keys, self.limit)
            value = side.at(graph, args, branch, dict(known))
            parts.append(side.df.select(*before, side.value(value).alias(name)))
        self.df = parts[0].unionByName(parts[1])
        return name

    def each(self, body: Graph, args: dict[str, object], over: tuple[str, ...]) -> dict[str, object]:
        if not self.keys:
            raise GraphError("a map with user tasks needs keys that tell rows apart")
        lists = {k: self.value(args[k]) for k in over}
        pos, cell = f"_s{next(_FRESH)}", f"_s{next(_FRESH)}"
        sizes = [F.size(v) for v in lists.values()]
        same = F.lit(True)
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        items = F.when(same | F.raise_error(F.lit("lists to go through differ in length")).cast("boolean"), F.arrays_zip(*[v.alias(k) for k, v in lists.items()]))
        shared = [v for k, v in args.items() if k not in over and isinstance(v, str) and v.startswith("_s")]
        rows = self.df.select(*self.keys, *shared, items.alias(cell)).select(*self.keys, *shared, F.posexplode(cell).alias(pos, cell))
        inner = _Frame(rows, [*self.keys, pos], self.limit)
        out = inner.apply(body, {k: inner.hold(F.col(cell)[k if len(over) == 1 and k in inner.df.schema[cell].dataType.names else inner.df.schema[cell].dataType.names[list(over).index(k)]]) if k in over else v for k, v in args.items()})
        made = {p: f"_s{next(_FRESH)}" for p in out}
        done = inner.df.groupBy(*self.keys).agg(*[gather(F.collect_list(F.struct(F.col(pos).alias("pos"), inner.value(v).alias("v")))).alias(made[p]) for p, v in out.items()])
        kinds = {made[p]: done.schema[made[p]].dataType for p in out}
        match = None
        for k in self.keys:
            test = self.df[k].eqNullSafe(done[k])
            match = test if match is None else match & test
        joined = self.df.join(done, match, "left").select(self.df["*"], *[F.coalesce(done[c], F.array().cast(t)).alias(c) for c, t in kinds.items()])
        self.df = joined
        return dict(made)

    def loop(self, body: Graph, args: dict[str, object], go_on: str, limit: int) -> dict[str, object]:
        """Rounds over the rows that are still active; finished rows leave the loop."""
        graphs = {k: v for k, v in args.items() if isinstance(v, Graph)}
        names = list(dict.fromkeys([*(k for k in args if k not in graphs), *(p for p in body.outputs() if p != go_on)]))
        held = {k: f"_s{next(_FRESH)}" for k in names}
        before = self.df.columns
        active = self.df.select(*before, *[self.value(args[k]).alias(held[k]) for k in args if k not in graphs])
        finished: DataFrame | None = None
        for _ in range(limit):
            step = _Frame(active, self.keys, self.limit)
            out = step.apply(body, {k: held[k] for k in args if k not in graphs} | graphs)
            go = F.coalesce(step.value(out[go_on]), F.lit(True))
            new = step.df.select(*before, *[(step.value(out[k]) if k in out else F.col(held[k])).alias(held[k]) for k in names], go.alias("_go"))
            # every round is cut: user tasks must not run again for each later round
            new = cut_lineage(new)
            done = new.filter(~F.col("_go")).drop("_go")
            finished = done if finished is None else finished.unionByName(done)
            active = new.filter("_go").drop("_go")
            if active.isEmpty():
                self.df = finished
                return dict(held)
        raise GraphError(f"not finished after {limit} rounds")


def _direct(node: object) -> list[Ref]:
    from skein.ir import refs_of

    return refs_of(node)
