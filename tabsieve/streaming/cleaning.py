"""Fitted cleaning steps on a stream.

Means, bounds and mappings are fixed by a batch; the stream then applies the
same row-wise steps; a mapping of any size is a table that each micro-batch is
joined with. Whole-row deduplication has no end on an unbounded stream and is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabsieve.functions.values import finite_columns
from tabsieve.operators.cleaning import Step, apply_step


def clean_stream(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The streaming table after the fitted steps, row by row, without state."""
    for step in steps:
        if step.kind == "remove_duplicates":
            raise ValueError("remove_duplicates cannot run on a stream.")
    out = finite_columns(stream)
    for step in steps:
        out = apply_step(out, step)
    return out
