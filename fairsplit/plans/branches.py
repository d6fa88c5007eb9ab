"""Independent branches of a job graph, run at the same time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from .storage import scratch_root

#: Branches that submit jobs at once. A branch is a sequence of jobs, so this is the number of jobs in flight.
MOST_AT_ONCE = 4


def run_branches(spark: SparkSession, branches: Mapping[str, Callable[[], Any]],
                 at_once: int = MOST_AT_ONCE) -> dict[str, Any]:
    """Results of the branches by name; each is a function that runs its own Spark jobs.

    A branch waits for the driver between its jobs, and its last tasks leave cores idle; other branches
    fill both. The jobs of a branch carry its name as scheduler pool, so ``spark.scheduler.mode=FAIR``
    shares the cores between branches, and inherit the caller's job group and other local properties.
    All branches end before this returns; then the first failure, in the order given, is raised.
    """
    if len(branches) <= 1:
        return {name: branch() for name, branch in branches.items()}
    scratch_root(spark)  # settled once, before several branches ask for it

    def named(name: str, branch: Callable[[], Any]) -> Callable[[], Any]:
        pool = f"{name}-{uuid.uuid4().hex[:8]}"

        def run() -> Any:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            return branch()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(min(at_once, len(branches))) as threads:
        started = {name: threads.submit(named(name, branch)) for name, branch in branches.items()}
    return {name: future.result() for name, future in started.items()}
