"""Workers: named groups of user tasks, run as Arrow-batched Python functions."""

from __future__ import annotations

import inspect
import subprocess
import typing
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skein.functions import BUILTINS, plain_name
from skein.types import codec_of, spark_type

_WORKERS: dict[str, Worker] = {}


class Task:
    def __init__(self, name: str, func: Callable[..., Any], vectorized: bool, capture: bool = False):
        self.name, self.func, self.capture = name, func, capture
        hints = typing.get_type_hints(func, include_extras=True)
        if "return" not in hints:
            raise TypeError(f"{name}: the return type is not annotated")
        self.arguments = {}
        for p in inspect.signature(func).parameters.values():
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) or p.name not in hints:
                raise TypeError(f"{name}: argument {p.name} needs a name and a type of its own")
            self.arguments[p.name] = p.default
            spark_type(hints[p.name])
        self.returns = spark_type(hints["return"])
        self.bundle = isinstance(self.returns, T.StructType) and hasattr(hints["return"], "_fields")
        self.vectorized = vectorized
        self.decode = {k: c.decode for k, h in hints.items() if k != "return" and (c := codec_of(h))}
        self.encode = c.encode if (c := codec_of(hints["return"])) else None
        if capture:
            self.returns, self.bundle = T.StructType([T.StructField("value", self.returns), T.StructField("error", T.StringType())]), True

    def columns(self, given: dict[str, Column]) -> Column:
        """The call as a Column.  Arguments that are not given take their defaults."""
        if wrong := set(given) - set(self.arguments):
            raise TypeError(f"{self.name}: no such arguments: {sorted(wrong)}")
        args = []
        for name, default in self.arguments.items():
            if name not in given and default is inspect.Parameter.empty:
                raise TypeError(f"{self.name}: argument {name} is missing")
            args.append(given[name] if name in given else F.lit(default))
        func, bundle, vectorized, names = self.func, self.bundle, self.vectorized, self.returns.names if self.bundle else None
        decode, encode, capture = [self.decode.get(a) for a in self.arguments], self.encode, self.capture

        def one(*row: Any) -> Any:
            if any(decode):
                row = [d(x) if d and x is not None else x for d, x in zip(decode, row, strict=True)]
            out = func(*row)
            return encode(out) if encode and out is not None else out

        def kept(*row: Any) -> tuple[Any, str | None]:
            try:
                return one(*row), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        call = kept if capture else one

        def run(*columns: pd.Series) -> pd.Series | pd.DataFrame:
            if vectorized:
                return func(*columns)
            rows = [call(*r) for r in zip(*columns, strict=True)] if columns else [call()]
            return pd.DataFrame([tuple(r) for r in rows], columns=names, dtype="object") if bundle else pd.Series(rows, dtype="object")

        run.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame if bundle else pd.Series}
        return F.pandas_udf(run, self.returns)(*args)


class Worker:
    """``@worker.task()`` registers a function of single values, ``@worker.task(vectorized=True)`` one of pandas series.

    With ``capture=True`` an error in a row does not stop the run: the task has the ports ``value`` and ``error``.
    ``@worker.table_task()`` registers a function from table to table, which :meth:`on_table` applies.
    """

    def __init__(self, name: str):
        self.name, self.tasks, self.tables = name, {}, {}
        _WORKERS[name] = self

    def task(self, vectorized: bool = False, capture: bool = False) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def register(func: Callable[..., Any]) -> Callable[..., Any]:
            self.tasks[func.__name__] = Task(f"{self.name}.{func.__name__}", func, vectorized, capture)
            return func

        return register

    def table_task(self) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
        def register(func: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.tables[func.__name__] = func
            return func

        return register

    def on_table(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"unknown table task {self.name}.{name}")
        return self.tables[name](df)

    def stubs(self) -> str:
        """Declarations of the tasks, in the form that :mod:`skein.idl` reads."""
        lines = [f"interface {self.name} {{"]
        for name, t in self.tasks.items():
            args = ", ".join(f"{a}: {ty.simpleString()}" for a, ty in ((a, spark_type(typing.get_type_hints(t.func, include_extras=True)[a])) for a in t.arguments))
            lines.append(f"  {name}({args}): {t.returns.simpleString()};")
        return "\n".join([*lines, "}"])


def is_builtin(task: str) -> bool:
    return plain_name(task) in BUILTINS


def find(task: str) -> Task:
    worker, _, name = task.rpartition(".")
    if worker not in _WORKERS or name not in _WORKERS[worker].tasks:
        raise KeyError(f"unknown task {task}")
    return _WORKERS[worker].tasks[name]


def argument_names(task: str) -> list[str]:
    task = plain_name(task)
    if task in BUILTINS:
        return list(inspect.signature(BUILTINS[task]).parameters)
    if task == "fold":
        return ["values", "initial", "func"]
    if task.startswith("script:"):
        return ["text"]
    return list(find(task).arguments)


def pipe(command: str, text: Column) -> Column:
    """Each text through the standard input and output of a shell command; a non-zero exit raises with its message."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            done = subprocess.run(["sh", "-c", command], input=(t or "").encode(), capture_output=True)
            if done.returncode:
                raise RuntimeError(f"{command}: exit {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
            out.append(done.stdout.decode())
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(text)
