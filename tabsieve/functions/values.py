"""Column expressions for missing values, text keys and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that a CSV cell may use for "missing".
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# A plain decimal number. try_cast alone also takes Java spellings like "1.0d".
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"

# Texts of this length and more are represented by a hash of this length.
ID_LENGTH = 64

_FLOATS = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """Column by its exact name; dots and back-ticks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL (NaN compares above infinity)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_columns(df: DataFrame) -> DataFrame:
    """The same table with NaN and infinities of float columns read as NULL."""
    if not any(isinstance(f.dataType, _FLOATS) for f in df.schema.fields):
        return df
    return df.select(*[present(df, f.name).alias(f.name, metadata=f.metadata) for f in df.schema.fields])


def present(df: DataFrame, name: str) -> Column:
    """The column with every missing spelling of its type read as NULL."""
    if isinstance(df.schema[name].dataType, _FLOATS):
        return finite(col(name))
    return col(name)


def is_present(df: DataFrame, name: str) -> Column:
    """Condition for a value that is not missing, simple enough for the scan."""
    if isinstance(df.schema[name].dataType, _FLOATS):
        return F.abs(col(name)) < F.lit(float("inf"))
    return col(name).isNotNull()


def double(df: DataFrame, name: str) -> Column:
    """The column as double, for rows already known to be finite."""
    return col(name) if isinstance(df.schema[name].dataType, T.DoubleType) else col(name).cast("double")


def number(df: DataFrame, name: str) -> Column:
    """The column as a finite double."""
    if isinstance(df.schema[name].dataType, _FLOATS):
        return finite(double(df, name))
    return double(df, name)


def missing_to_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TOKENS), value)


def strip_text(value: Column) -> Column:
    """Strip Unicode white space from both ends; trim() knows only the blank."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text_key(value: Column) -> Column:
    """Spellings that differ only by case or outer white space share this key."""
    return strip_text(F.lower(value))


def text_id(value: Column) -> Column:
    """Short stand-in that is equal for equal texts only: SHA-256 from ID_LENGTH characters on.

    Long texts are counted and compared by it, so their bodies need no shuffle.
    """
    return F.when(F.char_length(value) < ID_LENGTH, value).otherwise(F.sha2(value, 256))


def plain_number(text: Column) -> Column:
    """Text holding a plain finite number as double, anything else NULL."""
    return finite(F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double"))


def lenient_number(text: Column) -> Column:
    """'$1,234.56' -> 1234.56, '45%' -> 45, '(1,234)' -> -1234, others NULL."""
    bare = F.regexp_replace(strip_text(text), "[,$%]", "")
    signed = F.regexp_replace(bare, r"^\((.+)\)$", "-$1")
    return plain_number(strip_text(signed))


def half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits)
