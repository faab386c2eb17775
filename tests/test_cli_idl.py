import json

import pytest

from skein import cli, domain, idl
from skein.builder import Builder
from skein.ir import to_json
from skein.plans import graphs as G
from skein.plans.frames import run
from skein.udf import Worker

worker = Worker("declared")


@worker.task()
def join(words: list[str], n: int = 2) -> str:
    return " ".join(words[:n])


def test_run_from_the_command_line(spark, tmp_path, capsys):
    graph = tmp_path / "graph.json"
    graph.write_text(json.dumps(to_json(G.doubler_plus())))
    inputs = tmp_path / "in.json"
    inputs.write_text(json.dumps({"x": 3, "intercept": 6}))
    assert cli.main(["run", str(graph), "-i", str(inputs)]) == 0
    assert json.loads(capsys.readouterr().out) == {"value": 12}
    for _ in range(2):
        assert cli.main(["run", "skein.plans.graphs:gcd", "-i", f"a={_file(tmp_path, 'a', '1071')}", "-i", f"b={_file(tmp_path, 'b', '462')}", "--folder", f"file://{tmp_path}/run"]) == 0
        assert json.loads(capsys.readouterr().out) == {"value": 21}
    assert cli.main(["show", "skein.plans.graphs:doubler"]) == 0
    assert json.loads(capsys.readouterr().out)["nodes"][0] == {"kind": "Input", "name": "value"}


def _file(folder, name, text):
    (folder / name).write_text(text)
    return folder / name


def test_binary_inputs(tmp_path):
    (tmp_path / "raw").write_bytes(b"\xff\x00")
    assert cli.read_inputs([f"x={tmp_path / 'raw'}", f"y={_file(tmp_path, 'y', '5')}"]) == {"x": b"\xff\x00", "y": 5}


def test_declarations():
    text = """
    // shapes
    model Pair { a: int32; b: Array<string>; }
    interface demo {
      greet(greeting: string, subject?: string): string;
      both(x: uint8[]): Pair;
      counts(x: Record<float32>): boolean;
    }
    """
    d = idl.parse(text)
    assert d.spark_type("Pair").simpleString() == "struct<a:bigint,b:array<string>>"
    assert d.spark_type("Record<float32>").simpleString() == "map<string,double>"
    assert d.interfaces["demo"]["greet"].optional == {"subject"}
    space: dict = {}
    exec(d.stubs(), space)
    b = Builder("s")
    port = space["greet"](b, b["s"])
    assert b.graph.nodes[port.ref[0]].task == "demo.greet"


@pytest.mark.parametrize("text", ["model A { x: decimal; }\ninterface i { f(x: A): A; }", "interface i { f(x: plainDate): string; }", "interface i { f(x string): string; }", "thing x {}", "model A { x: string"])
def test_bad_declarations(text):
    with pytest.raises((idl.IdlError, IndexError)):
        idl.parse(text)


def test_a_workers_declarations_read_back():
    d = idl.parse(worker.stubs())
    assert d.interfaces["declared"]["join"].arguments == {"words": "array<string>", "n": "bigint"}


def test_domain_tasks(spark):
    assert sum(len(t) for t in domain.TASKS.values()) == 47
    b = Builder("c")
    graph = b.outputs(value=b.task("circuit.n_qubits", circuit=b["c"]))
    with pytest.raises(domain.NotProvided, match="circuit.n_qubits"):
        run(spark.range(1), graph, keep=[], c="q0 q1")

    def n_qubits(circuit: str) -> int:
        return len(circuit.split())

    domain.provide("circuit.n_qubits", n_qubits)
    assert run(spark.range(1), graph, keep=[], c="q0 q1").first().value == 2
    with pytest.raises(KeyError):
        domain.provide("circuit.nothing", n_qubits)
