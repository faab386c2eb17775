"""Command line: run a graph on one set of inputs, or print a graph or worker declarations.

    python -m skein.cli run module:function -i inputs.json
    python -m skein.cli run graph.json -i a=path.json -i b=path.bin
    python -m skein.cli show module:function
    python -m skein.cli stubs module:worker
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path
from typing import Any

from skein.ir import Graph, from_json, to_json


def load(name: str) -> Any:
    """``module:attribute``, called if it is a function; or a JSON file of a graph."""
    if name.endswith(".json"):
        return from_json(json.loads(Path(name).read_text()))
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if callable(found) else found


def read_inputs(given: list[str]) -> dict[str, Any]:
    """One JSON object, or ``port=path`` files that hold JSON or else plain bytes."""
    if len(given) == 1 and "=" not in given[0]:
        data = json.loads(Path(given[0]).read_text())
        return data if isinstance(data, dict) else {"value": data}
    out = {}
    for g in given:
        port, _, path = g.partition("=")
        raw = Path(path).read_bytes()
        try:
            out[port] = json.loads(raw)
        except ValueError:
            out[port] = raw
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="skein")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "show", "stubs"):
        p = sub.add_parser(name)
        p.add_argument("what")
        if name == "run":
            p.add_argument("-i", "--input", action="append", default=[])
            p.add_argument("-n", "--limit", type=int, default=64, help="steps of a loop before it counts as endless")
            p.add_argument("--folder", help="keep the result as a finished step here, and take it up again if it is there")
    args = top.parse_args(argv)
    found = load(args.what)
    if args.command == "stubs":
        print(found.stubs())
        return 0
    if args.command == "show":
        print(json.dumps(to_json(found), indent=1))
        return 0
    from pyspark.sql import SparkSession

    from skein.plans.frames import run
    from skein.sources.checkpoints import step

    assert isinstance(found, Graph), f"{args.what} is no graph"
    spark = SparkSession.builder.getOrCreate()

    def make():
        return run(spark.range(1), found, keep=[], keys=["id"], limit=args.limit, **read_inputs(args.input))

    out = step(spark, args.folder, "result", make) if args.folder else make()
    print(out.toJSON().first())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
