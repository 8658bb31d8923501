"""Schema-only operators: type predicates, overview, type report, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import col, is_present, present

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = _INTEGRAL + (T.FloatType, T.DoubleType, T.DecimalType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
CATEGORY = {"logical_type": "category"}


def is_numeric(field: T.StructField) -> bool:
    """Booleans, categories and dates are not numbers."""
    return isinstance(field.dataType, _NUMERIC) and not is_category(field)


def is_integral(field: T.StructField) -> bool:
    return isinstance(field.dataType, _INTEGRAL)


def is_category(field: T.StructField) -> bool:
    return field.metadata.get("logical_type") == CATEGORY["logical_type"]


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, _TEXT) and not is_category(field)


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def text_columns(df: DataFrame, with_category: bool = False) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, _TEXT) and (with_category or not is_category(f))
    ]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_nested(f)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def select_text(df: DataFrame, with_category: bool = False) -> DataFrame:
    return df.select(*[col(c) for c in text_columns(df, with_category)])


def require_column(df: DataFrame, name: str) -> T.StructField:
    """The field of that name, or ValueError before any job starts."""
    if name not in df.columns:
        raise ValueError(f"Column '{name}' not found.")
    return df.schema[name]


def require_numeric(df: DataFrame, name: str) -> T.StructField:
    field = require_column(df, name)
    if not is_numeric(field):
        raise ValueError(f"Column '{name}' is not numeric.")
    return field


def complete_rows(df: DataFrame, *names: str) -> DataFrame:
    """Rows where none of the named columns is missing."""
    for name in names:
        require_column(df, name)
    for name in names:
        df = df.where(is_present(df, name))
    return df


def within(value: Column, low: float, high: float) -> Column:
    return value.between(F.lit(low), F.lit(high))


def outside(value: Column, low: float, high: float) -> Column:
    return (value < F.lit(low)) | (value > F.lit(high))


def range_filter(df: DataFrame, name: str, low: float, high: float, inside: bool = True) -> DataFrame:
    """Rows inside (or strictly outside) the bounds; a missing value is in neither."""
    require_numeric(df, name)
    if not inside:
        return df.where(outside(present(df, name), low, high))
    if math.isinf(low) or math.isinf(high):
        return df.where(within(present(df, name), low, high))
    return df.where(within(col(name), low, high))


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_numeric, n_text (all that is not numeric)."""
    columns, numeric = len(df.columns), len(numeric_columns(df))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(columns).alias("n_columns"),
        F.lit(numeric).alias("n_numeric"),
        F.lit(columns - numeric).alias("n_text"),
    )


def logical_type(field: T.StructField) -> str:
    if is_category(field):
        return "Category"
    if isinstance(field.dataType, _NUMERIC):
        return "Number"
    if isinstance(field.dataType, T.BooleanType):
        return "Boolean"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Date/Time"
    if isinstance(field.dataType, _TEXT):
        return "Text"
    return field.dataType.simpleString()


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, column, spark_type, logical_type."""
    rows = [
        (i, f.name, f.dataType.simpleString(), logical_type(f)) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, spark_type string, logical_type string"
    )
