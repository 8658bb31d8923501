"""Frequency tables: the shared source of distinct counts, modes and top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import ID_LENGTH, col, is_present, present, text_id
from tabsieve.operators.schema import is_integral, require_column
from tabsieve.plans.held import held
from tabsieve.plans.lookup import BROADCAST_ROWS
from tabsieve.plans.tall import tall

# Values that a sketch of frequent items tracks in a task, and those that it names.
TRACKED_VALUES, NAMED_VALUES = 12_000, 1_000
# Texts are tracked by their ids, which are short.
SKETCHED_TYPES = ("bigint", "date", "string")


def value_type(field: T.StructField) -> T.DataType:
    """Type in which values of a column are compared and counted."""
    if is_integral(field):
        return T.LongType()
    if isinstance(field.dataType, T.FloatType):
        return T.DoubleType()
    return field.dataType


def _any_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in names])


def typed_frequencies(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """(idx, one slot per value type, n) for the non-missing values of all columns.

    One scan and one shuffle for any number of columns: every column goes to the
    slot of its type, partial counts are combined before the exchange, so a hot
    value leaves each task as a single row. Returns also the slot of each column.
    """
    if not columns:
        raise ValueError("No columns given.")
    fields = [require_column(df, c) for c in columns]
    for f in fields:
        if isinstance(f.dataType, T.MapType):
            raise ValueError(f"Column '{f.name}' is a map; its values cannot be compared.")
    types: dict[str, T.DataType] = {}
    for f in fields:
        types.setdefault(value_type(f).simpleString(), value_type(f))
    slots = {name: f"v{i}" for i, name in enumerate(types)}
    rows = [
        [
            present(df, f.name).cast(t) if name == value_type(f).simpleString() else F.lit(None).cast(t)
            for name, t in types.items()
        ]
        for f in fields
    ]
    names = list(slots.values())
    table = (
        tall(df, rows, names)
        .where(_any_present(names))
        .groupBy("idx", *names)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return table, {f.name: slots[value_type(f).simpleString()] for f in fields}


def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, n) over all named columns; missing values excluded."""
    table, slots = typed_frequencies(df, columns)
    used = list(dict.fromkeys(slots.values()))
    names = F.array(*[F.lit(c) for c in columns])
    return table.select(
        F.element_at(names, F.col("idx") + 1).alias("column"),
        F.coalesce(*[F.col(s).cast("string") for s in used]).alias("value"),
        "n",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column with its own type; missing values excluded."""
    require_column(df, column)
    return (
        df.where(is_present(df, column))
        .select(col(column).alias("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_values(df: DataFrame, column: str, k: int) -> list | None:
    """Values, texts by their ids, among which the k most frequent ones certainly are, from one
    scan with a sketch of frequent items in each task; None where the sketch cannot tell.

    A value that the sketch does not name occurs in no more than twice its error of the rows, or no
    more often than the last one named.
    """
    if value_type(require_column(df, column)).simpleString() not in SKETCHED_TYPES:
        return None
    rows = df.where(is_present(df, column)).select(_tracked(df, column).alias("value"))
    found = rows.agg(F.expr(f"approx_top_k(value, {NAMED_VALUES}, {TRACKED_VALUES})").alias("top"), F.count("value").alias("n")).first()
    named = sorted((r["count"] for r in found["top"] or ()), reverse=True)
    if len(named) < k:
        return None
    # Fixed by the sketch: its table has the next power of two above 4/3 of the items tracked.
    error = 3.5 / (1 << math.ceil(math.log2(TRACKED_VALUES * 4 / 3))) * found["n"]
    unnamed = max(2 * error, named[-1] + error if len(named) == NAMED_VALUES else 0)
    # Estimates are never more than the error above the counts.
    return [r["item"] for r in found["top"]] if named[k - 1] - error > unnamed else None


def _tracked(df: DataFrame, column: str) -> Column:
    field = require_column(df, column)
    return text_id(col(column)) if _is_string(field) else col(column).cast(value_type(field))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts are ordered by value.

    Where a sketch names all values that can be among them, only those are counted and
    shuffled; else all values are.
    """
    named = frequent_values(df, column, k)
    counts = value_counts(df, column)
    if named is not None:
        kind = T.StructType([T.StructField("id", value_type(require_column(df, column)))])
        # At most NAMED_VALUES rows.
        few = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in named], kind))
        rows = df.where(is_present(df, column)).select(col(column).alias("value"), _tracked(df, column).alias("id")).join(few, "id", "left_semi")
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def _by_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with every text replaced by its id."""
    return df.select(
        *[text_id(col(c)).alias(c) if _is_string(require_column(df, c)) else col(c) for c in columns]
    )


def _is_string(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct count per column; long texts travel as their ids."""
    table, _ = typed_frequencies(_by_ids(df, columns), columns)
    found = {r["idx"]: r["d"] for r in table.groupBy("idx").agg(F.count(F.lit(1)).alias("d")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def distinct_and_mode(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, object]]:
    """Exact distinct count and mode (smallest of the ties) per column."""
    table, slots = typed_frequencies(_by_ids(df, columns), columns)
    used = list(dict.fromkeys(slots.values()))
    texts = [slots[c] for c in columns if _is_string(df.schema[c])][:1]
    hashed = F.max(F.char_length(texts[0]) >= ID_LENGTH) if texts else F.lit(None).cast("boolean")
    # Few different counts exist, so grouping by count first leaves little to
    # compare; numeric buffers let it run as a hash aggregation.
    by_count = table.groupBy("idx", "n").agg(
        F.count(F.lit(1)).alias("values"), hashed.alias("hashed"), *[F.min(s).alias(s) for s in used]
    )
    best = by_count.groupBy("idx").agg(
        F.sum("values").alias("distinct"), F.max_by(F.struct("n", "hashed", *used), F.col("n")).alias("top")
    )
    found = {r["idx"]: (r["distinct"], r["top"]) for r in best.collect()}
    out: dict[str, tuple[int, object]] = {}
    for i, c in enumerate(columns):
        distinct, top = found.get(i, (0, None))
        if top is None:
            out[c] = (distinct, None)
        elif top["hashed"]:
            out[c] = (distinct, _mode_of_long_texts(df, c, top["n"]))
        else:
            out[c] = (distinct, top[slots[c]])
    return out


def _mode_of_long_texts(df: DataFrame, column: str, n: int) -> str:
    """The smallest of the texts that occur n times, n being the highest count."""
    rows = df.select(col(column).alias("value")).where(F.col("value").isNotNull())
    if n == 1:  # no text occurs twice, so all of them are tied
        return rows.agg(F.min("value")).first()[0]
    by_id = rows.withColumn("id", text_id(F.col("value")))
    tied = by_id.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("id")
    with held(tied, "tied") as few:
        if few.count() <= BROADCAST_ROWS:
            return by_id.join(F.broadcast(few), "id", "left_semi").agg(F.min("value")).first()[0]
    counts = value_counts(df, column)
    return counts.where(F.col("n") == n).agg(F.min("value")).first()[0]
