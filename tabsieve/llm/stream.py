"""Groups and blocks for code that works on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one partition, one key after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of sorted batches, each as one table; keys are whole numbers or bytes."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c.slice(1).to_numpy(zero_copy_only=False) != c.slice(0, len(c) - 1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate((np.flatnonzero(changed), [batch.num_rows]))
        begin = 0
        for end in cuts:
            key = tuple(c[begin].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last, begin = key, int(end)
    if held:
        yield pa.Table.from_batches(held)


def in_block_pairs(df: DataFrame, members: Column, key: Column, block: int) -> DataFrame:
    """Deals the rows of large groups to pairs of blocks.

    ``members`` is the size of the row's group. A group of up to ``block`` rows is
    one piece (0, 0). A larger one is cut into blocks by a hash of ``key``, and a
    row goes to each pair of blocks that has its own, so that any two rows meet
    in exactly one piece as members of different blocks, or in the piece of their
    own block. Adds ``left``, ``right`` and ``mine``, the row's own block.
    """
    blocks = F.ceil(members / F.lit(float(block))).cast("int")
    mine = F.pmod(F.xxhash64(key, F.lit(11)), F.greatest(blocks, F.lit(1))).cast("int")
    pieces = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
    return pieces.withColumns({"left": F.least("mine", "other"), "right": F.greatest("mine", "other")}).drop("other")


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's connected component in a symmetric matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        front = np.array([i])
        root[i] = i
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = i
    return root
