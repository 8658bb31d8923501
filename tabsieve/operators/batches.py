"""Sums over many columns, added up in numpy batch by batch.

Spark deals the rows to its tasks and adds up what they send: sums for columns and
pairs, or for the values of a batch, never rows. The functions that run in tasks are
nested so that they travel with their code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    return df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])


def column_sums(df: DataFrame, values: Sequence[Column]) -> dict[int, dict]:
    """Rows, count, mean and range of every value by its place; none for a table without rows."""

    def add(batches):
        with np.errstate(all="ignore"):
            for b in batches:
                cells = [c.drop_null().to_numpy(zero_copy_only=False) for c in b.columns]
                n = [len(x) for x in cells]
                low = [float(x.min()) if len(x) else None for x in cells]
                high = [float(x.max()) if len(x) else None for x in cells]
                places = pa.array(range(len(n)), pa.int32())
                figures = [pa.array([b.num_rows] * len(n), pa.int64()), pa.array(n, pa.int64())]
                figures += [pa.array(v, pa.float64()) for v in ([float(x.sum()) for x in cells], low, high)]
                yield pa.RecordBatch.from_arrays([places, *figures], names=["idx", "rows", "n", "s", "low", "high"])

    sums = _named(df, values).mapInArrow(add, "idx int, rows bigint, n bigint, s double, low double, high double")
    found = sums.groupBy("idx").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return {
        r["idx"]: {
            "rows": r["rows"],
            "count": r["n"],
            "null_count": r["rows"] - r["n"],
            "mean": r["s"] / r["n"] if r["n"] else None,
            "low": r["low"],
            "high": r["high"],
        }
        for r in found.collect()
    }


def gram_matrix(df: DataFrame, values: Sequence[Column], marks: bool = False) -> np.ndarray:
    """Sums of products of all pairs of values: one scan, in which every task adds up the
    whole matrix, and only matrices move.

    With ``marks``, missing values are 0, and the squares of the values and then the
    marks of those that are present follow the values.
    """
    width = len(values) * (3 if marks else 1)

    def add(batches):
        total = np.zeros((width, width))
        with np.errstate(all="ignore"):
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                if marks:
                    there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns])
                    x = np.where(there, x, 0.0)
                    x = np.hstack([x, x * x, there])
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = _named(df, values).mapInArrow(add, "i int, j int, s double")
    out = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def value_counts_by_partner(values: DataFrame, partners: Sequence[str]) -> DataFrame:
    """(idx, value, n, n0, n1, ...) of finite doubles: rows per value of each column, in all
    and where partner j is present. A batch sends each of its values once."""
    places = [values.columns.index(p) for p in partners]
    names = ["n", *[f"n{j}" for j in range(len(partners))]]

    def count(batches):
        for b in batches:
            there = [np.ones(b.num_rows, np.int64)]
            there += [b.columns[j].is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for j in places]
            marks = np.column_stack(there)
            for i, c in enumerate(b.columns):
                x = c.to_numpy(zero_copy_only=False)
                order = np.argsort(x, kind="stable")[: len(x) - c.null_count]
                if not len(order):
                    continue
                x = x[order]
                starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                n = np.add.reduceat(marks[order], starts, axis=0)
                columns = [pa.array(np.full(len(starts), i, np.int32)), pa.array(x[starts])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(w) for w in n.T.copy()]], names=["idx", "value", *names])

    schema = "idx int, value double, " + ", ".join(f"{w} bigint" for w in names)
    return values.mapInArrow(count, schema).groupBy("idx", "value").agg(*[F.sum(w).alias(w) for w in names])


def rank_products(values: DataFrame, tables, pairs: Sequence[tuple[int, int, int, int]]) -> list[float]:
    """Sums over the rows of ``rank ka of column a times rank kb of column b`` for each
    (a, ka, b, kb). ``tables`` is a broadcast {column: (sorted values, ranks by kind)}; ranks
    are centred, and those behind the last value, which stand for a missing one, are 0."""
    used = sorted({i for a, _, b, _ in pairs for i in (a, b)})
    at = {i: k for k, i in enumerate(used)}

    def add(batches):
        total = np.zeros(len(pairs))
        for b in batches:
            ranks = {}
            for i in used:
                known, by_kind = tables.value[i]
                # A missing value is NaN here and sorts behind all others.
                ranks[i] = np.take(by_kind, np.searchsorted(known, b.columns[at[i]].to_numpy(zero_copy_only=False)), axis=1)
            total += [ranks[i][ki] @ ranks[j][kj] for i, ki, j, kj in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(total)], names=["pair", "s"])

    sums = values.select(*[values.columns[i] for i in used]).mapInArrow(add, "pair int, s double")
    found = {r["pair"]: r["s"] for r in sums.groupBy("pair").agg(F.sum("s").alias("s")).collect()}
    return [found.get(p, 0.0) for p in range(len(pairs))]


def rank_sums_by_value(values: DataFrame, tables, column: int, others: Sequence[tuple[int, int]]) -> DataFrame:
    """(value, s0, s1, ...): for each value of a column the sums of the ranks, by kind, of
    other columns in its rows; ``tables`` as above."""
    used = [column, *dict.fromkeys(i for i, _ in others)]
    names = [f"s{k}" for k in range(len(others))]

    def add(batches):
        for b in batches:
            x = b.columns[0].to_numpy(zero_copy_only=False)
            order = np.argsort(x, kind="stable")[: len(x) - b.columns[0].null_count]
            if not len(order):
                continue
            x = x[order]
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            spots = {i: np.searchsorted(tables.value[i][0], b.columns[used.index(i)].to_numpy(zero_copy_only=False)[order]) for i in used[1:]}
            sums = [np.add.reduceat(tables.value[i][1][k][spots[i]], starts) for i, k in others]
            yield pa.RecordBatch.from_arrays([pa.array(x[starts]), *[pa.array(s) for s in sums]], names=["value", *names])

    schema = "value double, " + ", ".join(f"{s} double" for s in names)
    rows = values.select(*[values.columns[i] for i in used]).mapInArrow(add, schema)
    return rows.groupBy("value").agg(*[F.sum(s).alias(s) for s in names])
