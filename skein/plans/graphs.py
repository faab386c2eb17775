"""Small graphs that queries and tests share."""

from __future__ import annotations

from skein.builder import Builder, Elements
from skein.ir import Graph


def doubler() -> Graph:
    g = Builder("value")
    return g.outputs(value=g.task("itimes", a=g["value"], b=2))


def doubler_plus() -> Graph:
    g = Builder("x", "intercept")
    return g.outputs(value=g.task("iadd", a=g.task("itimes", a=g["x"], b=2), b=g["intercept"]))


def doubler_plus_multi() -> Graph:
    g = Builder("x", "intercept")
    return g.outputs(a=g["x"], value=g.task("iadd", a=g.task("itimes", a=g["x"], b=2), b=g["intercept"]))


def nested() -> Graph:
    """doubler_plus of doubler of a value."""
    g = Builder("value", "intercept")
    return g.outputs(value=g.eval(doubler_plus(), x=g.eval(doubler(), value=g["value"]), intercept=g["intercept"]))


def map_plus() -> Graph:
    g = Builder("value", "intercept")
    return g.outputs(value=g.map(doubler_plus(), x=Elements(g["value"]), intercept=g["intercept"]))


def maps_in_series() -> Graph:
    g = Builder("value")
    return g.outputs(value=g.map(doubler(), g.map(doubler(), g["value"])))


def map_two() -> Graph:
    inner = Builder("a", "b")
    body = inner.outputs(value=inner.task("iadd", a=inner["a"], b=inner["b"]))
    g = Builder("a", "b")
    return g.outputs(value=g.map(body, a=Elements(g["a"]), b=Elements(g["b"])))


def map_field() -> Graph:
    g = Builder("value", "intercept")
    made = g.map(doubler_plus_multi(), x=Elements(g["value"]), intercept=g["intercept"])
    return g.outputs(a=made.a, value=made.value)


def count_to(stop: int) -> Graph:
    """Adds 1 until ``stop`` is reached; the first step is taken in any case."""
    body = Builder("acc")
    new = body.task("iadd", a=body["acc"], b=1)
    inner = body.outputs(acc=new, should_continue=body.task("igt", a=stop, b=new))
    g = Builder("value")
    return g.outputs(value=g.loop(inner, acc=g["value"]).acc)


def three_counters(stop: int) -> Graph:
    body = Builder("acc1", "acc2", "acc3")
    a, b, c = (body.task("iadd", a=body[f"acc{i}"], b=i) for i in (1, 2, 3))
    inner = body.outputs(acc1=a, acc2=b, acc3=c, should_continue=body.task("igt", a=stop, b=a))
    g = Builder("x", "y", "z")
    out = g.loop(inner, acc1=g["x"], acc2=g["y"], acc3=g["z"])
    return g.outputs(acc1=out.acc1, acc2=out.acc2, acc3=out.acc3)


def pick(eager: bool = False) -> Graph:
    """a // b where b is not 0, else -1."""
    g = Builder("a", "b")
    test = g.task("neq", a=g["b"], b=0)
    if eager:  # both sides are computed, so the divisor is made safe first
        safe = g.eifelse(test, g["b"], 1)
        return g.outputs(value=g.eifelse(test, g.task("idivide", a=g["a"], b=safe), -1))
    return g.outputs(value=g.ifelse(test, g.task("idivide", a=g["a"], b=g["b"]), -1))


def gcd() -> Graph:
    g = Builder("a", "b")
    again = g.eval(g.ref(), a=g["b"], b=g.task("mod", a=g["a"], b=g["b"]))
    return g.outputs(value=g.ifelse(g.task("eq", a=g["b"], b=0), g["a"], again))


def factorial() -> Graph:
    g = Builder("n")
    again = g.eval(g.ref(), n=g.task("isubtract", a=g["n"], b=1))
    return g.outputs(value=g.ifelse(g.task("igt", a=g["n"], b=1), g.task("itimes", a=g["n"], b=again), 1))


def weighted_sum() -> Graph:
    """Fold of value * weight over two lists."""
    from skein.builder import fold

    step = Builder("a", "b")
    pair = step.task("untuple", a=step["a"])
    func = step.outputs(value=step.task("add", a=step["b"], b=step.task("times", a=pair.a, b=pair.b)))
    g = Builder("values", "weights")
    return g.outputs(value=g.eval(fold(func), values=g.task("zip", a=g["values"], b=g["weights"]), initial=0.0))


def by_name() -> Graph:
    """One of two graphs, by a name."""
    g = Builder("name", "value")
    test = g.task("str_eq", a=g["name"], b="double")
    return g.outputs(value=g.ifelse(test, g.eval(doubler(), value=g["value"]), g.task("ipow", a=g["value"], b=2)))
