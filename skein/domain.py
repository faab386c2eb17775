"""Domain tasks whose work is done by outside toolkits.

The names and arguments are here, so that graphs which call them can be built, checked and
planned.  A toolkit is plugged in with :func:`provide`; without one, a call fails when the plan is
made and names what is missing.  Conversions of shots, expectation values and array tasks
need no toolkit: they are in :mod:`skein.operators.relational`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from skein.udf import Task, Worker, _WORKERS

#: Task names by worker, with their arguments (fixed values).
TASKS = {
    "circuit": {
        "get_backend_info": ["config"],
        "device_name_from_info": ["backend_info"],
        "compile_using_info": ["circuit", "backend_info", "config", "optimisation_level", "timeout"],
        "add_measure_all": ["circuit"],
        "append_pauli_measurement_impl": ["circuit", "pauli_string"],
        "optimise_phase_gadgets": ["circuit"],
        "apply_pass": ["circuit", "compiler_pass"],
        "compile_generic_with_fixed_pass": ["circuit", "input_format", "optimisation_level", "gate_set", "coupling_map", "output_format", "optimisation_pass"],
        "to_qasm2_str": ["circuit", "header"],
        "from_qasm2_str": ["qasm"],
        "to_qir_bytes": ["circuit"],
        "from_qir_bytes": ["qir"],
        "expectation": ["backend_result"],
        "n_qubits": ["circuit"],
        "backend_result_to_dict": ["backend_result"],
        "backend_result_from_dict": ["data"],
    },
    "aer": {
        "get_compiled_circuit": ["circuit", "optimisation_level", "timeout", "simulation_method", "n_qubits"],
        "run_circuit": ["circuit", "n_shots", "simulation_method", "n_qubits", "seed"],
        "run_circuits": ["circuits", "n_shots", "simulation_method", "n_qubits", "seed"],
        "to_qasm3_str": ["circuit"],
        "submit": ["circuits", "n_shots"],
        "submit_single": ["circuit", "n_shots"],
    },
    "qulacs": {
        "get_compiled_circuit": ["circuit", "optimisation_level", "result_type", "gpu_sim"],
        "run_circuit": ["circuit", "n_shots", "result_type", "gpu_sim", "seed"],
        "run_circuits": ["circuits", "n_shots", "result_type", "gpu_sim", "seed"],
    },
    "remote_jobs": {
        "upload_circuit": ["project_name", "circ"],
        "start_execute_job": ["project_name", "job_name", "circuits", "n_shots", "backend_config"],
        "is_running": ["execute_ref"],
        "get_results": ["execute_ref"],
        "check_status": ["execute_ref"],
        "submit": ["circuits", "n_shots"],
    },
    "hosted_device": {
        "get_backend_info": ["device_name"],
        "backend_pass_from_info": ["backend_info", "optimisation_level"],
        "backend_default_compilation_pass": ["device_name", "optimisation_level"],
        "fixed_pass": [],
        "compile": ["circuit", "device_name", "optimisation_level"],
        "compile_circuit": ["circuit"],
        "compile_circuits": ["circuits"],
        "run_circuit": ["circuit", "n_shots", "device_name"],
    },
    "ibmq": {
        "get_backend_info": ["device_name"],
        "backend_pass_from_info": ["backend_info", "optimisation_level"],
        "backend_default_compilation_pass": ["device_name", "optimisation_level"],
        "fixed_pass": ["coupling_map", "optimisation_level"],
        "compile": ["circuit", "device_name", "optimisation_level"],
        "compile_circuit": ["circuit", "device_name", "optimisation_level"],
        "compile_circuits": ["circuits", "device_name", "optimisation_level"],
        "run_circuit": ["circuit", "n_shots", "device_name"],
    },
}


class NotProvided(RuntimeError):
    pass


class _Open(Task):
    """A declared task without a toolkit."""

    def __init__(self, name: str, arguments: list[str]):
        self.name, self.arguments, self.bundle = name, dict.fromkeys(arguments), False

    def columns(self, given: dict) -> Any:
        raise NotProvided(f"{self.name} needs a toolkit: register one with skein.domain.provide({self.name!r}, function)")


def provide(task: str, func: Callable[..., Any]) -> None:
    """Plugs a typed function in as a domain task; circuits and results travel as bytes or structs."""
    worker, _, name = task.rpartition(".")
    if name not in TASKS.get(worker, {}):
        raise KeyError(f"no domain task {task}")
    _WORKERS[worker].tasks[name] = Task(task, func, vectorized=False)


for _worker, _tasks in TASKS.items():
    Worker(_worker).tasks.update({n: _Open(f"{_worker}.{n}", a) for n, a in _tasks.items()})
