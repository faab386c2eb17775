"""What a worker's stage asks of the cluster, as a Spark resource profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests


@dataclass(frozen=True)
class Needs:
    cores: int = 1
    memory: str = "1g"
    task_cores: int = 1
    gpus: int = 0
    gpu_discovery: str = ""


def profile(needs: Needs) -> ResourceProfile:
    """To pass to ``mapInPandas`` or ``mapInArrow`` as ``profile``."""
    executor = ExecutorResourceRequests().cores(needs.cores).memory(needs.memory)
    task = TaskResourceRequests().cpus(needs.task_cores)
    if needs.gpus:
        executor = executor.resource("gpu", needs.gpus, needs.gpu_discovery)
        task = task.resource("gpu", 1)
    return ResourceProfileBuilder().require(executor).require(task).build


class Router:
    """Profiles by worker name; a default serves the others, an unknown name without one is an error."""

    def __init__(self, by_worker: dict[str, Needs], default: Needs | None = None):
        self.by_worker, self.default = by_worker, default

    def needs(self, task: str) -> Needs:
        found = self.by_worker.get(task.rpartition(".")[0], self.default)
        if found is None:
            raise KeyError(f"no resources are set for {task}")
        return found
