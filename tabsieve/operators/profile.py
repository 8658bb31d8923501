"""Column statistics, the profile of all numeric columns, categorical summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import col, number, present
from tabsieve.operators.frequency import distinct_and_mode, distinct_counts
from tabsieve.operators.quantiles import Extent, exact_quantiles
from tabsieve.operators.schema import (
    is_integral,
    is_nested,
    is_numeric,
    numeric_columns,
    require_column,
    require_numeric,
)
from tabsieve.plans.compiled import small_methods
from tabsieve.plans.tall import tall
from tabsieve.plans.together import together

STATISTICS = (
    "count",
    "null_count",
    "unique",
    "mode",
    "min",
    "max",
    "mean",
    "median",
    "std",
    "variance",
    "p25",
    "p75",
    "iqr",
    "skewness",
    "kurtosis",
)
COUNTS = ("count", "null_count", "unique")
TYPED = ("mode", "min", "max")
DIGITS = 4
QUARTILES = (0.25, 0.5, 0.75)
DETAILED_COLUMNS = 40
SAMPLE_VALUES = 5


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below 3 values."""
    n = F.count(value).cast("double")
    g1 = F.coalesce(F.skewness(value), F.lit(0.0))
    return F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, NULL below 4 values."""
    n = F.count(value).cast("double")
    g2 = F.kurtosis(value)
    full = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(full, F.lit(0.0)))


_MOMENTS = ("mean", "variance", "skewness", "kurtosis")


def moments(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = _MOMENTS) -> dict[str, dict]:
    """Order-free statistics of all columns in one scan, one group per column.

    The grouped form keeps the generated code small and gives every column its
    own reducer; integers keep a slot of their own so that their range is exact.
    """
    makers = {"mean": F.avg, "variance": F.var_samp, "skewness": sample_skewness, "kurtosis": sample_kurtosis}
    none = F.lit(None).cast("long")
    values = [
        (number(df, c), col(c).cast("long") if is_integral(require_numeric(df, c)) else none) for c in columns
    ]
    v = F.col("v")
    found = (
        tall(df, values, ("v", "w"))
        .groupBy("idx")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("count"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.min("w").alias("whole_low"),
            F.max("w").alias("whole_high"),
            *[makers[m](v).alias(m) for m in wanted],
        )
    )
    with small_methods(df.sparkSession):
        by_index = {r["idx"]: r for r in found.collect()}
    out: dict[str, dict] = {}
    for i, c in enumerate(columns):
        r = by_index.get(i)
        if r is None:  # empty table
            out[c] = dict.fromkeys(("low", "high", "min", "max", *wanted)) | {"rows": 0, "count": 0, "null_count": 0}
            continue
        exact = r["whole_low"] is not None
        out[c] = {
            "rows": r["rows"],
            "count": r["count"],
            "null_count": r["rows"] - r["count"],
            "low": r["low"],
            "high": r["high"],
            "min": r["whole_low"] if exact else r["low"],
            "max": r["whole_high"] if exact else r["high"],
            **{m: r[m] for m in wanted},
        }
    return out


def _as_float(value: object) -> float | None:
    return None if value is None else float(value)


def describe(df: DataFrame, columns: Sequence[str], modes: bool = True) -> dict[str, dict]:
    """All fifteen statistics, unrounded, per column.

    Without ``modes`` the distinct count and the mode, the only statistics that
    shuffle values, are left out.

    Three kinds of job whatever the number of columns: one aggregate for the
    moments, one frequency table for distinct counts and modes, and the
    narrowing passes for the quartiles.
    """
    for c in columns:
        require_numeric(df, c)

    def ordered():
        stats = moments(df, columns)
        known = {c: Extent(s["count"], s["low"], s["high"]) for c, s in stats.items()}
        return stats, exact_quantiles(df, {c: QUARTILES for c in columns}, known)

    (stats, quartiles), counted = together(
        df.sparkSession, ordered, lambda: distinct_and_mode(df, columns) if modes else {}
    )
    for c, s in stats.items():
        p25, median, p75 = (quartiles[c][q] for q in QUARTILES)
        unique, mode = counted.get(c, (None, None))
        s.update(
            unique=unique,
            mode=mode,
            median=median,
            p25=p25,
            p75=p75,
            iqr=None if p25 is None else p75 - p25,
            std=None if s["variance"] is None else s["variance"] ** 0.5,
        )
    return stats


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """One row per numeric column with the fifteen statistics.

    Counts are exact; minimum, maximum and mode are given as doubles so that
    all columns share one type; other figures are rounded to ``digits``.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    schema = "column string, " + ", ".join(
        f"`{s}` {'bigint' if s in COUNTS else 'double'}" for s in STATISTICS
    )
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    stats = describe(df, columns)
    rows = [
        (c, *[stats[c][s] if s in COUNTS else _as_float(stats[c][s]) for s in STATISTICS]) for c in columns
    ]
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.select("column", *_rounded(digits))


def _rounded(digits: int) -> list[Column]:
    exact = COUNTS + TYPED
    return [F.col(s) if s in exact else F.round(s, digits).alias(s) for s in STATISTICS]


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """The fifteen statistics of one column in one row, mode/min/max in its own type.

    A column that is not numeric has count, null_count, unique and mode only.
    """
    field = require_column(df, column)
    if not is_numeric(field):
        rows = df.agg(F.count(F.lit(1)).alias("rows"), F.count(present(df, column)).alias("count")).first()
        unique, mode = distinct_and_mode(df, [column])[column]
        found = Row(count=rows["count"], null_count=rows["rows"] - rows["count"], unique=unique)
        out = df.sparkSession.createDataFrame([found], "count bigint, null_count bigint, unique bigint")
        return out.withColumn("mode", F.lit(mode).cast(field.dataType))
    own = T.LongType() if is_integral(field) else T.DoubleType()
    types = dict.fromkeys(STATISTICS, T.DoubleType())
    types |= dict.fromkeys(COUNTS, T.LongType()) | dict.fromkeys(TYPED, own)
    stats = describe(df, [column])[column]
    row = [_as_float(stats[s]) if isinstance(types[s], T.DoubleType) else stats[s] for s in STATISTICS]
    table = df.sparkSession.createDataFrame(
        [row], T.StructType([T.StructField(s, types[s]) for s in STATISTICS])
    )
    return table.select(*_rounded(DIGITS))


def numeric_summary(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(column, mean, std, min, max, nulls) per numeric column from one aggregate."""
    columns = numeric_columns(df)
    stats = moments(df, columns, ("mean", "variance")) if columns else {}
    rows = [
        (c, s["mean"], None if s["variance"] is None else s["variance"] ** 0.5, s["low"], s["high"], s["null_count"])
        for c, s in stats.items()
    ]
    table = df.sparkSession.createDataFrame(
        rows, "column string, mean double, std double, min double, max double, nulls bigint"
    )
    return table.withColumns({c: F.round(c, digits) for c in ("mean", "std")})


def first_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = SAMPLE_VALUES) -> DataFrame:
    """(idx, sample): texts of each column's first k non-missing values in row order.

    One scan: every task keeps the first k of its rows for a column, and only those
    are exchanged. Rows of equal order are in the order of their texts.
    """
    for c in order_by:
        require_column(df, c)
    keys = [f"k{i}" for i in range(len(order_by))]
    rows = [[*[col(o) for o in order_by], present(df, c).cast("string")] for c in columns]
    values = tall(df, rows, [*keys, "value"]).where(F.col("value").isNotNull())
    order = [*keys, "value"]
    place = F.row_number().over(Window.partitionBy("idx").orderBy(*order))
    first = values.withColumn("place", place).where(F.col("place") <= k)
    pairs = F.sort_array(F.collect_list(F.struct("place", "value")))
    return first.groupBy("idx").agg(F.transform(pairs, lambda p: p["value"]).alias("sample"))


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns that are neither numeric nor nested."""
    return [f.name for f in df.schema.fields if not is_numeric(f) and not is_nested(f)]


def categorical_summary(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, k: int = SAMPLE_VALUES
) -> DataFrame:
    """(column, unique, nulls, sample): distinct count, missing count, first k values.

    The samples of all columns come from one scan; ``sample`` is an array of at most k texts.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    schema = "column string, unique bigint, nulls bigint, sample array<string>"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    nulls = df.agg(
        *[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    counted = distinct_counts(df, columns)
    samples = {r["idx"]: r["sample"] for r in first_values(df, columns, order_by, k).collect()}
    rows = [(c, counted[c], nulls[f"c{i}"], samples.get(i, [])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, schema)
