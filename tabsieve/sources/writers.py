"""Previews, CSV export and written reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.values import col, finite_columns
from tabsieve.operators.report import report_markdown, report_tables
from tabsieve.operators.schema import is_nested, require_column

PREVIEW_ROWS = 8
REPORT_FORMATS = ("parquet", "csv", "json")


def preview(df: DataFrame, order_by: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the given order, non-finite numbers as NULL."""
    for c in order_by:
        require_column(df, c)
    return finite_columns(df).orderBy(*[col(c) for c in order_by]).limit(rows)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 CSV with a header and no index; one file per task.

    Arrays, structs and maps are written as JSON. An empty text and a missing one
    are both written as nothing, and read back as missing.
    """
    nested = [f.name for f in df.schema.fields if is_nested(f)]
    flat = finite_columns(df).withColumns({c: F.to_json(col(c)) for c in nested})
    writer = flat.write.mode(mode).option("header", True).option("escape", '"')
    # Blanks are data.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("emptyValue", "").option("encoding", "UTF-8").csv(path)


def write_report(df: DataFrame, path: str, order_by: Sequence[str], fmt: str = "parquet") -> None:
    """The report tables in one folder each, or one Markdown text."""
    spark = df.sparkSession
    if fmt == "markdown":
        lines = [(i, line) for i, line in enumerate(report_markdown(df, order_by).splitlines())]
        table = spark.createDataFrame(lines, "i int, value string")
        table.coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
        return
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"Unknown report format {fmt!r}.")
    for name, table in report_tables(df, order_by).items():
        if fmt == "csv":
            write_csv(table.coalesce(1), f"{path}/{name}")
        else:
            table.write.format(fmt).save(f"{path}/{name}")
