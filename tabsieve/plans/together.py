"""Independent jobs submitted side by side, so that one fills the gaps of another."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of the jobs, in order; the first error is raised."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
