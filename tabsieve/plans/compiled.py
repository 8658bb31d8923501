"""Wide expressions in methods that the JVM compiles.

A stage of generated code is one method. The JVM never compiles a method of more than
8,000 bytes but interprets it, at ten times the price; without whole-stage code, Spark
splits the expressions into small methods.
"""

from __future__ import annotations

from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession

_LIMIT, _COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
_LOCK = Lock()
_BEFORE: dict[int, tuple[int, str]] = {}


@contextmanager
def small_methods(spark: SparkSession):
    """For the length of a block that fetches its results, stages that would be interpreted
    are not generated whole. Blocks may overlap; the last one restores the setting."""
    with _LOCK:
        blocks, before = _BEFORE.get(id(spark), (0, spark.conf.get(_LIMIT)))
        _BEFORE[id(spark)] = blocks + 1, before
        spark.conf.set(_LIMIT, min(int(before), _COMPILED_BYTES))
    try:
        yield
    finally:
        with _LOCK:
            blocks, before = _BEFORE.pop(id(spark))
            if blocks > 1:
                _BEFORE[id(spark)] = blocks - 1, before
            else:
                spark.conf.set(_LIMIT, before)
