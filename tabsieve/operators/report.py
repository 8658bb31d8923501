"""Recommendations, the dataset profile and its text, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.values import col
from tabsieve.operators.profile import (
    DETAILED_COLUMNS,
    categorical_summary,
    describe,
    numeric_summary,
)
from tabsieve.operators.schema import dataset_overview, is_nested, is_numeric, numeric_columns, text_columns

# Column names that stand for time, and the number of proposals.
TIME_NAMES = ("timestamp", "date", "Date", "time")
MOST_PROPOSALS = 5
NAMED_COLUMNS = 3

# The texts of the proposals ({some}: first numeric names as a list).
HISTOGRAM = "Histogram — distribution of {some}"
SCATTER = "Scatter Plot — {a} vs {b}"
LINE = "Line Plot — {some} over time"
BOX = "Box Plot — outliers in {some}"
HEATMAP = "Heatmap — correlation matrix"
BAR = "Bar Chart — frequency of '{text}'"
PIE = "Pie Chart — proportion of '{text}'"
REGRESSION = "Linear Regression — {a} vs {b}"
SUMMARY = "Statistical Summary — {some}"
COUNTS = "Value Counts — '{text}'"

# The lines of the profile text.
HEAD_LINES = ("Dataset: {rows:,} rows × {columns} columns.", "Columns: {names}.", "")
EMPTY_LINE = "- '{column}' (numeric): all values are null."
NUMERIC_LINE = "- '{column}' (numeric): min={min}, max={max}, mean={mean}, median={median}, std={std}, nulls={nulls}"
CATEGORY_LINE = "- '{column}' (categorical): {unique} unique values, sample={sample}, nulls={nulls}"
NESTED_LINE = "- '{column}' ({type}): nested, nulls={nulls}"
OMITTED_LINE = "\n(+{omitted} more columns not detailed here — ask about a specific one by name.)"


def recommendations(df: DataFrame) -> DataFrame:
    """(kind, rank, text): charts and analyses that suit the schema."""
    numbers, texts = numeric_columns(df), text_columns(df, with_category=True)
    names = {
        "some": numbers[:NAMED_COLUMNS],
        "a": numbers[0] if numbers else None,
        "b": numbers[1] if len(numbers) > 1 else None,
        "text": texts[0] if texts else None,
    }
    several, timed = len(numbers) > 1, any(c in TIME_NAMES for c in df.columns)
    charts = (
        (HISTOGRAM, numbers),
        (SCATTER, several),
        (LINE, numbers and timed),
        (BOX, numbers),
        (HEATMAP, several),
        (BAR, texts),
        (PIE, texts),
    )
    analyses = ((REGRESSION, several), (SUMMARY, numbers), (COUNTS, texts))
    rows = []
    for kind, proposals in (("visualization", charts), ("analysis", analyses)):
        fitting = [text.format(**names) for text, applies in proposals if applies][:MOST_PROPOSALS]
        rows += [(kind, i, text) for i, text in enumerate(fitting, 1)]
    return df.sparkSession.createDataFrame(rows, "kind string, rank int, text string")


PROFILE = (
    "position int, column string, kind string, min double, max double, mean double, median double, "
    "std double, unique bigint, sample array<string>, nulls bigint"
)


def dataset_profile(df: DataFrame, order_by: Sequence[str], columns: int | None = None) -> DataFrame:
    """One row per column in schema order, with details of all or of the first ``columns``.

    Numeric columns have range, mean, median and spread, others their distinct
    count and first values, nested ones their missing values.
    """
    detailed = df.schema.fields[:columns]
    numbers = [f.name for f in detailed if is_numeric(f)]
    others = [f.name for f in detailed if not is_numeric(f) and not is_nested(f)]
    stats = describe(df, numbers, modes=False) if numbers else {}
    rest = categorical_summary(df, order_by, others).collect() if others else []
    nested = [f.name for f in detailed if is_nested(f)]
    missing = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(nested)]).first() if nested else ()
    gaps = dict(zip(nested, missing))
    categories = {r["column"]: r for r in rest}
    rows = []
    for i, f in enumerate(df.schema.fields):
        s, c = stats.get(f.name), categories.get(f.name)
        if s is not None:
            low, high = (None if s[k] is None else float(s[k]) for k in ("min", "max"))
            figures = (low, high, s["mean"], s["median"], s["std"], None, None, s["null_count"])
            rows.append((i, f.name, "numeric", *figures))
        elif c is not None:
            rows.append((i, f.name, "categorical", *[None] * 5, c["unique"], c["sample"], c["nulls"]))
        else:
            kind = "nested" if f.name in gaps else "omitted"
            rows.append((i, f.name, kind, *[None] * 7, gaps.get(f.name)))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def profile_text(df: DataFrame, order_by: Sequence[str], columns: int = DETAILED_COLUMNS) -> str:
    """The profile as text, with a line for each of the first ``columns`` columns."""
    rows = dataset_profile(df, order_by, columns).orderBy("position").collect()
    total = df.count()
    head = {"rows": total, "columns": len(rows), "names": ", ".join(df.columns)}
    lines = [line.format(**head) for line in HEAD_LINES]
    for r in rows:
        figures = {k: _general(r[k]) for k in ("min", "max", "mean", "median", "std")}
        if r["kind"] == "numeric" and r["min"] is None:
            lines.append(EMPTY_LINE.format(column=r["column"]))
        elif r["kind"] == "numeric":
            lines.append(NUMERIC_LINE.format(column=r["column"], nulls=r["nulls"], **figures))
        elif r["kind"] == "categorical":
            found = {"unique": r["unique"], "sample": list(r["sample"]), "nulls": r["nulls"]}
            lines.append(CATEGORY_LINE.format(column=r["column"], **found))
        elif r["kind"] == "nested":
            lines.append(NESTED_LINE.format(column=r["column"], type=df.schema[r["column"]].dataType.typeName(), nulls=r["nulls"]))
    omitted = sum(r["kind"] == "omitted" for r in rows)
    if omitted:
        lines.append(OMITTED_LINE.format(omitted=omitted))
    return "\n".join(lines)


def _general(value: float | None) -> str:
    return "nan" if value is None else f"{value:.4g}"


def report_tables(df: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """Overview, profile and numeric summary: the tables of a report."""
    return {
        "overview": dataset_overview(df),
        "profile": dataset_profile(df, order_by),
        "numeric_summary": numeric_summary(df),
    }


def report_markdown(df: DataFrame, order_by: Sequence[str]) -> str:
    """The report as Markdown: overview, profile lines, numeric summary."""
    overview = dataset_overview(df).first()
    out = [
        "# Analysis report",
        "",
        "## Dataset overview",
        f"- Rows: {overview['n_rows']:,}",
        f"- Columns: {overview['n_columns']}",
        f"- Column names: {', '.join(df.columns)}",
        "",
        "## Data profile",
    ]
    out += [line if line.startswith("- ") else f"- {line}" for line in profile_text(df, order_by).splitlines() if line.strip()]
    summary = numeric_summary(df).collect()
    if summary:
        out += ["", "## Numeric column summary"]
        for r in summary:
            parts = [f"{k}={_general(r[k])}" for k in ("mean", "std", "min", "max")]
            out.append(f"- {r['column']}: {', '.join(parts)}, nulls={r['nulls']}")
    return "\n".join(out) + "\n"
