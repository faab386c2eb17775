"""Declarations of workers: reading them, and writing typed Python stubs from them.

    model Pair { a: integer; b: string[]; }
    interface demo {
      greet(greeting: string, subject?: string): string;
      both(x: int64): Pair;
    }

Types are the usual scalar names, ``T[]`` or ``Array<T>``, ``Record<T>``, models, and Spark's own
simple type strings, which :meth:`skein.udf.Worker.stubs` writes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Scalar names and what stands for them (fixed values).
SCALARS = {
    "boolean": "boolean",
    "int8": "bigint", "int16": "bigint", "int32": "bigint", "int64": "bigint",
    "uint8": "bigint", "uint16": "bigint", "uint32": "bigint", "uint64": "bigint",
    "safeint": "bigint", "integer": "bigint",
    "float": "double", "float32": "double", "float64": "double", "numeric": "double",
    "string": "string", "url": "string",
    "bytes": "binary",
    "null": "void",
}
_PYTHON = {"boolean": "bool", "bigint": "int", "double": "float", "string": "str", "binary": "bytes", "void": "None"}
_TOKEN = re.compile(r"\s*(?:(//[^\n]*)|([A-Za-z_][\w.]*)|(\[\]|[{}()<>,;:?]))")


class IdlError(ValueError):
    pass


@dataclass
class Method:
    arguments: dict[str, str]
    optional: set[str]
    returns: str


@dataclass
class Declarations:
    models: dict[str, dict[str, str]] = field(default_factory=dict)
    interfaces: dict[str, dict[str, Method]] = field(default_factory=dict)

    def spark_type(self, name: str) -> T.DataType:
        return T._parse_datatype_string(self._ddl(name))

    def _ddl(self, name: str) -> str:
        if name in SCALARS:
            return SCALARS[name]
        if name in self.models:
            return "struct<" + ",".join(f"{k}:{self._ddl(v)}" for k, v in self.models[name].items()) + ">"
        if m := re.fullmatch(r"(?:Array|array)<(.+)>", name):
            return f"array<{self._ddl(m[1])}>"
        if m := re.fullmatch(r"Record<(.+)>", name):
            return f"map<string,{self._ddl(m[1])}>"
        if name in _PYTHON or re.match(r"(?:struct|map)<", name):
            return name
        raise IdlError(f"unsupported type {name}")

    def _python(self, name: str) -> str:
        if name in self.models:
            return name
        ddl = SCALARS.get(name, name)
        if ddl in _PYTHON:
            return _PYTHON[ddl]
        if m := re.fullmatch(r"(?:Array|array)<(.+)>", name):
            return f"list[{self._python(m[1])}]"
        if m := re.fullmatch(r"Record<(.+)>", name):
            return f"dict[str, {self._python(m[1])}]"
        raise IdlError(f"unsupported type {name}")

    def stubs(self) -> str:
        """Python source with a named tuple for each model and a graph-building function for each method."""
        lines = ["from typing import NamedTuple", "", "from skein.builder import Builder, Port", ""]
        for name, fields in self.models.items():
            lines += ["", f"class {name}(NamedTuple):", *[f"    {k}: {self._python(v)}" for k, v in fields.items()], ""]
        for worker, methods in self.interfaces.items():
            for name, m in methods.items():
                args = ", ".join(f"{a}: Port[{self._python(t)}]" + (" | None = None" if a in m.optional else "") for a, t in m.arguments.items())
                lines += ["", f"def {name}(graph: Builder{', ' + args if args else ''}) -> Port[{self._python(m.returns)}]:", f"    ports = {{{', '.join(f'{a!r}: {a}' for a in m.arguments)}}}", f"    return graph.task({f'{worker}.{name}'!r}, **{{k: v for k, v in ports.items() if v is not None}})", ""]
        return "\n".join(lines)


def parse(text: str) -> Declarations:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise IdlError(f"unexpected {text[at : at + 10]!r}")
        at = m.end()
        if not m[1]:
            tokens.append(m[2] or m[3])
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        if pos >= len(tokens) or want and tokens[pos] != want:
            raise IdlError(f"expected {want or 'more'}, found {tokens[pos] if pos < len(tokens) else 'the end'}")
        pos += 1
        return tokens[pos - 1]

    def kind() -> str:
        name = take()
        if tokens[pos : pos + 1] == ["<"]:
            take("<")
            inner = [kind()]
            while tokens[pos] == ",":
                take(",")
                inner.append(kind())
            take(">")
            name = f"{name}<{','.join(inner)}>"
        while tokens[pos : pos + 1] == ["[]"]:
            take("[]")
            name = f"Array<{name}>"
        return name

    out = Declarations()
    while pos < len(tokens):
        what, name = take(), take()
        take("{")
        if what == "model":
            fields = out.models.setdefault(name, {})
            while tokens[pos] != "}":
                key = take()
                take(":")
                fields[key] = kind()
                take(";")
        elif what == "interface":
            methods = out.interfaces.setdefault(name, {})
            while tokens[pos] != "}":
                method, args, optional = take(), {}, set()
                take("(")
                while tokens[pos] != ")":
                    arg = take()
                    if tokens[pos] == "?":
                        take("?")
                        optional.add(arg)
                    take(":")
                    args[arg] = kind()
                    if tokens[pos] == ",":
                        take(",")
                take(")")
                take(":")
                methods[method] = Method(args, optional, kind())
                take(";")
        else:
            raise IdlError(f"unexpected {what}")
        take("}")
    for m in (m for i in out.interfaces.values() for m in i.values()):
        for t in (*m.arguments.values(), m.returns):
            out._ddl(t)
    return out
