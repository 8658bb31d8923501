"""Ordered cleaning operations with warnings.

Every operation is split in two: *fitting* fetches the few numbers it needs
(mean, quartiles, mode ...) from the table as it stands at that point, and
*applying* adds a lazy step with these numbers as literals. Neighbouring
operations that see the same state of their columns are fitted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.dates import format_of, has_zone, parse_timestamp, prepared_columns, shape_counts
from tabsieve.functions.values import col, finite_columns, lenient_number, number, present
from tabsieve.operators.frequency import distinct_and_mode, value_counts
from tabsieve.operators.quality import _no_maps, distinct_rows, repeated_hashes
from tabsieve.operators.quantiles import Extent, exact_quantiles
from tabsieve.operators.schema import CATEGORY, is_numeric, within
from tabsieve.plans.compiled import small_methods
from tabsieve.plans.held import drop_held, hold
from tabsieve.plans.lookup import BROADCAST_BYTES, HOT_SHARE, lookup, measured_bytes

# The accepted operation types, methods and target types.
TYPES = ("remove_duplicates", "fill_nulls", "remove_outliers", "normalize", "fix_text", "cast_type")
METHODS = ("mean", "median", "zero", "mode", "drop", "minmax", "zscore")
DTYPES = ("numeric", "datetime", "category", "text")

# The texts of the warnings and of the empty-result error.
FILL_SKIPPED = "Fill nulls ({method}) skipped on '{column}' — column is not numeric."
OUTLIERS_SKIPPED = "Remove outliers skipped on '{column}' — column is not numeric."
NORMALIZE_SKIPPED = "Normalize skipped on '{column}' — column is not numeric."
VALUES_LOST = "Cast '{column}' to number: {lost} value(s) couldn't be parsed as numbers and were set to null."
DATES_LOST = "Cast '{column}' to datetime: {lost} value(s) couldn't be parsed as dates and were set to null."
# Texts of our own.
ZONES_MIXED = "Cast '{column}' to datetime: {naive} value(s) name no time zone and were taken as UTC like the others."
NOTHING_LEFT = "Cleaning would remove all rows. Relax your settings and try again."

# Mappings up to this size are literals of the plan, larger ones are joined.
LITERAL_MAPPING = 32
# The prepared texts of a column while it is cast.
_PREPARED = "__prepared"
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass
class Step:
    """A fitted operation: what to do and the numbers it uses."""

    kind: str
    column: str | None = None
    values: dict = field(default_factory=dict)

    @property
    def changes_rows(self) -> bool:
        return self.kind in ("remove_duplicates", "drop", "keep_range")

    @property
    def shuffles(self) -> bool:
        return self.kind == "remove_duplicates" or self.kind == "replace_joined"


@dataclass
class Cleaned:
    """The cleaned table, its warnings and the fitted steps behind it."""

    table: DataFrame
    warnings: list[str]
    steps: list[Step]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Deletes the tables written for this result, once nobody reads it any more."""
        for table in self.held:
            drop_held(table)
        self.held.clear()


def validate_operations(operations: Sequence[Mapping]) -> None:
    """ValueError for an unknown operation type, method or target type."""
    for op in operations:
        if op.get("type") not in TYPES:
            raise ValueError(f"Unknown operation type {op.get('type')!r}.")
        if op.get("method") is not None and op["method"] not in METHODS:
            raise ValueError(f"Unknown method {op['method']!r}.")
        if op.get("dtype") is not None and op["dtype"] not in DTYPES:
            raise ValueError(f"Unknown target type {op['dtype']!r}.")


def _needs(op: Mapping) -> set[str]:
    """Which figures of its column an operation has to know beforehand."""
    kind, method = op["type"], op.get("method")
    if kind == "remove_outliers":
        return {"quartiles"}
    if kind == "cast_type":
        return {"numeric": {"lost"}, "datetime": {"format"}}.get(op.get("dtype"), set())
    if kind in ("fill_nulls", "normalize"):
        wanted = {
            "mean": {"fill_nulls": "mean"},
            "median": {"fill_nulls": "median"},
            "mode": {"fill_nulls": "mode"},
            "minmax": {"normalize": "range"},
            "zscore": {"normalize": "spread"},
        }
        name = wanted.get(method, {}).get(kind)
        return {name} if name else set()
    return set()


def _batches(operations: Sequence[Mapping]):
    """Runs of operations that can be fitted on the table as the run begins."""
    run: list[Mapping] = []
    touched: set[str] = set()
    rows_changed = False
    for op in operations:
        column = op.get("column")
        if column in touched or (rows_changed and _needs(op)):
            yield run
            run, touched, rows_changed = [], set(), False
        run.append(op)
        if column:
            touched.add(column)
        removes_rows = op["type"] in ("remove_duplicates", "remove_outliers") or op.get("method") == "drop"
        rows_changed = rows_changed or removes_rows
    if run:
        yield run


def _admit(df: DataFrame, op: Mapping, warnings: list[str]) -> bool:
    """Whether an operation applies to its column; type mismatches warn."""
    kind, column, method = op["type"], op.get("column"), op.get("method")
    if kind == "remove_duplicates":
        _no_maps(df)
        return True
    if not column or column not in df.columns:
        return False
    field_ = df.schema[column]
    numeric = is_numeric(field_)
    if kind == "fill_nulls":
        if method in ("mean", "median", "zero") and not numeric:
            warnings.append(FILL_SKIPPED.format(method=method, column=column))
            return False
        return method in ("mean", "median", "zero", "mode", "drop")
    if kind == "remove_outliers":
        if not numeric:
            warnings.append(OUTLIERS_SKIPPED.format(column=column))
        return numeric
    if kind == "normalize":
        if not numeric:
            warnings.append(NORMALIZE_SKIPPED.format(column=column))
        return numeric and method in ("minmax", "zscore")
    if kind == "fix_text":
        mapping = op.get("mapping")
        some = isinstance(mapping, DataFrame) or bool(mapping)
        return some and isinstance(field_.dataType, T.StringType)
    return op.get("dtype") is not None


def _figures(df: DataFrame, ops: Sequence[Mapping]) -> dict[str, dict]:
    """All figures a batch needs: one aggregate, one quantile and one mode call."""
    wanted: dict[str, set[str]] = {}
    for op in ops:
        if _needs(op):
            wanted.setdefault(op["column"], set()).update(_needs(op))
    exprs: list[Column] = []
    for i, (c, needs) in enumerate(wanted.items()):
        exprs.append(F.count_if(present(df, c).isNull()).alias(f"nulls{i}"))
        if needs & {"mean", "median", "quartiles", "range", "spread"}:
            v = number(df, c)
            exprs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}")]
            if needs & {"mean", "spread"}:
                exprs.append(F.avg(v).alias(f"mean{i}"))
            if "spread" in needs:
                exprs.append(F.stddev_samp(v).alias(f"std{i}"))
        if "lost" in needs and isinstance(df.schema[c].dataType, T.StringType):
            lost = F.count_if(col(c).isNotNull() & lenient_number(col(c)).isNull())
            exprs.append(lost.alias(f"lost{i}"))
        if "format" in needs and isinstance(df.schema[c].dataType, T.StringType):
            exprs.append(F.count(col(c)).alias(f"texts{i}"))
    if not exprs:
        return {}
    row = df.agg(*exprs).first().asDict()
    out: dict[str, dict] = {}
    for i, c in enumerate(wanted):
        out[c] = {k[: -len(str(i))]: v for k, v in row.items() if k in {f"{n}{i}" for n in _FIGURES}}
    shares = {
        c: (0.25, 0.5, 0.75)
        for c, needs in wanted.items()
        if needs & {"median", "quartiles"} and (needs & {"quartiles"} or out[c]["nulls"])
    }
    if shares:
        known = {c: Extent(out[c]["n"], out[c]["low"], out[c]["high"]) for c in shares}
        for c, q in exact_quantiles(df, shares, known).items():
            out[c].update(p25=q[0.25], median=q[0.5], p75=q[0.75])
    dates = [c for c in wanted if out[c].get("texts")]
    if dates:
        _date_figures(df, ops, dates, out)
    modes = [c for c, needs in wanted.items() if "mode" in needs and out[c]["nulls"]]
    if modes:
        for c, (_, mode) in distinct_and_mode(df, modes).items():
            out[c]["mode"] = mode
    return out


_FIGURES = ("nulls", "n", "low", "high", "mean", "std", "lost", "texts")


def _date_figures(df: DataFrame, ops: Sequence[Mapping], columns: Sequence[str], out: dict[str, dict]) -> None:
    """The formats of text columns: those named, or one for each shape of dates that a
    column has; then how many texts they can read."""
    named = {op["column"]: op["formats"] for op in ops if op.get("dtype") == "datetime" and op.get("formats")}
    shapes = [c for c in columns if c not in named]
    counted = shape_counts(df, shapes) if shapes else {}
    for c in columns:
        found = [(format_of(r), r["n"]) for r in counted.get(c, ())]
        found = [(f, n) for f, n in found if f is not None]
        out[c]["formats"] = named.get(c) or [f for f, _ in found]
        out[c]["inferred"] = c in counted and bool(found)
        out[c]["naive"] = sum(n for f, n in found if not has_zone(f)) if any(has_zone(f) for f, _ in found) else 0
    texts = [f"t{i}" for i in range(len(columns))]
    plain = df.select(*[col(c).alias(t) for c, t in zip(columns, texts)])
    ready = prepared_columns(plain, {t: F.col(t) for c, t in zip(columns, texts) if out[c]["inferred"]})
    read = [F.count(parse_timestamp(F.col(t), out[c]["formats"])).alias(t) for c, t in zip(columns, texts)]
    with small_methods(df.sparkSession):
        counts = ready.agg(*read).first()
    for c, t in zip(columns, texts):
        out[c]["read"] = counts[t]


def _fit(df: DataFrame, op: Mapping, figures: Mapping[str, dict], warnings: list[str]) -> Step | None:
    kind, c, method = op["type"], op.get("column"), op.get("method")
    got = figures.get(c, {})
    if kind == "remove_duplicates":
        return Step(kind, values={"repeated": repeated_hashes(df)})
    if kind == "fill_nulls":
        if method == "drop":
            return Step("drop", c)
        if method == "zero":
            return Step("fill", c, {"value": 0})
        value = got.get(method) if got["nulls"] else None
        if value is None:
            return None
        return Step("fill_double" if method in ("mean", "median") else "fill", c, {"value": value})
    if kind == "remove_outliers":
        if got["p25"] is None or got["p75"] - got["p25"] <= 0:
            return None
        reach = 1.5 * (got["p75"] - got["p25"])
        return Step("keep_range", c, {"low": got["p25"] - reach, "high": got["p75"] + reach})
    if kind == "normalize" and method == "minmax":
        if got["low"] is None or got["low"] == got["high"]:
            return None
        return Step("scale", c, {"shift": got["low"], "by": got["high"] - got["low"]})
    if kind == "normalize":
        if got["std"] == 0:
            return None
        return Step("scale", c, {"shift": got["mean"], "by": got["std"]})
    if kind == "fix_text":
        return _fit_mapping(df, c, op["mapping"])
    if got.get("lost"):
        warnings.append(VALUES_LOST.format(column=c, lost=got["lost"]))
    if got.get("texts"):
        if got["texts"] > got["read"]:
            warnings.append(DATES_LOST.format(column=c, lost=got["texts"] - got["read"]))
        if got["naive"]:
            warnings.append(ZONES_MIXED.format(column=c, naive=got["naive"]))
    return Step(f"cast_{op['dtype']}", c, {k: got.get(k) for k in ("formats", "inferred")})


def _fit_mapping(df: DataFrame, column: str, mapping: Mapping | DataFrame) -> Step:
    if not isinstance(mapping, DataFrame):
        pairs = [(str(k), None if v is None else str(v)) for k, v in mapping.items()]
        if len(pairs) <= LITERAL_MAPPING:
            return Step("replace", column, {"mapping": dict(pairs)})
        mapping = df.sparkSession.createDataFrame(pairs, "value string, replacement string")
    table = hold(mapping.groupBy("value").agg(F.min("replacement").alias("replacement")), "mapping")
    size, hot = measured_bytes(table), None
    if size > BROADCAST_BYTES:
        counts = value_counts(df, column)
        total = counts.agg(F.sum("n")).first()[0] or 1
        # No more than HOT_SHARE values can hold 1/HOT_SHARE of the rows.
        heavy = counts.where(F.col("n") >= F.lit(total) / HOT_SHARE).select("value")
        hot = hold(heavy, "hot-values")
    return Step("replace_joined", column, {"mapping": table, "bytes": size, "hot": hot})


def _replace_column(df: DataFrame, name: str, value: Column, metadata: dict | None = None) -> DataFrame:
    keep = df.schema[name].metadata if metadata is None else metadata
    return df.select(
        *[value.alias(c, metadata=keep) if c == name else col(c) for c in df.columns]
    )


def _to_number(df: DataFrame, name: str) -> Column | None:
    field_ = df.schema[name]
    if isinstance(field_.dataType, T.StringType):
        return lenient_number(col(name))
    if isinstance(field_.dataType, T.BooleanType):
        return col(name).cast("double")
    if isinstance(field_.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        stamp = col(name).cast("timestamp_ntz")
        # Whole nanoseconds: a double has no room for all their digits.
        return (F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), stamp) * 1000).cast("double")
    return None


def _to_timestamp(df: DataFrame, name: str, found: Mapping) -> Column | None:
    field_ = df.schema[name]
    if isinstance(field_.dataType, T.StringType):
        return parse_timestamp(F.col(_PREPARED) if found.get("inferred") else col(name), found.get("formats"))
    if isinstance(field_.dataType, T.DateType):
        return col(name).cast("timestamp_ntz")
    if is_numeric(field_):  # nanoseconds since 1970
        return F.timestamp_add("MICROSECOND", F.floor(col(name) / 1000).cast("long"), F.expr(_EPOCH))
    return None


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """The table after one fitted step, still lazy."""
    kind, c, v = step.kind, step.column, step.values
    if kind == "remove_duplicates":
        return distinct_rows(df, v.get("repeated"))
    if kind == "drop":
        return df.where(col(c).isNotNull())
    if kind == "keep_range":
        # A NULL is not inside the range, so rows without a value go as well.
        return df.where(within(col(c), v["low"], v["high"]))
    if kind == "fill":
        return _replace_column(df, c, F.coalesce(col(c), F.lit(v["value"]).cast(df.schema[c].dataType)))
    if kind == "fill_double":
        return _replace_column(df, c, F.coalesce(number(df, c), F.lit(float(v["value"]))))
    if kind == "scale":
        if v["by"] is None:  # the spread of a single value is undefined
            return _replace_column(df, c, F.lit(None).cast("double"))
        return _replace_column(df, c, (number(df, c) - F.lit(v["shift"])) / F.lit(v["by"]))
    if kind == "replace":
        entries = [F.lit(x) for pair in v["mapping"].items() for x in pair]
        table = F.create_map(*entries)
        return _replace_column(
            df, c, F.when(F.map_contains_key(table, col(c)), F.element_at(table, col(c))).otherwise(col(c))
        )
    if kind == "replace_joined":
        renamed = v["mapping"].withColumn("__hit", F.lit(True)).withColumnRenamed("replacement", "__new")
        joined = lookup(df, col(c), renamed, "value", v["bytes"], v["hot"])
        new = F.when(F.col("__hit"), F.col("__new")).otherwise(col(c))
        keep = df.schema[c].metadata
        return joined.select(*[new.alias(c, metadata=keep) if n == c else col(n) for n in df.columns])
    if kind == "cast_category":
        return _replace_column(df, c, col(c).cast("string"), CATEGORY)
    if kind == "cast_text":
        return _replace_column(df, c, col(c).cast("string"), {})
    if kind == "cast_datetime" and v.get("inferred") and isinstance(df.schema[c].dataType, T.StringType):
        ready = prepared_columns(df.withColumn(_PREPARED, col(c)), {_PREPARED: F.col(_PREPARED)})
        return _replace_column(ready, c, _to_timestamp(df, c, v), {}).drop(_PREPARED)
    new = _to_number(df, c) if kind == "cast_numeric" else _to_timestamp(df, c, v)
    return df if new is None else _replace_column(df, c, new, {})


def clean(df: DataFrame, operations: Sequence[Mapping]) -> Cleaned:
    """Apply the operations in order; each sees the result of those before it."""
    validate_operations(operations)
    out = finite_columns(df)
    warnings: list[str] = []
    steps: list[Step] = []
    shuffled, kept = False, []
    for batch in _batches(operations):
        # Notes keep the order of the operations although fitting comes first.
        notes: list[list[str]] = [[] for _ in batch]
        admitted = [op if _admit(out, op, note) else None for op, note in zip(batch, notes)]
        wanted = [op for op in admitted if op is not None]
        if shuffled and any(_needs(op) for op in wanted):
            # Figures of this batch and all later jobs read the held table
            # instead of repeating the shuffles before it.
            out, shuffled = hold(out, "cleaning"), False
            kept.append(out)
        figures = _figures(out, wanted)
        fitted = [
            _fit(out, op, figures, note) if op is not None else None for op, note in zip(admitted, notes)
        ]
        for step, note in zip(fitted, notes):
            warnings += note
            if step is not None:
                out = apply_step(out, step)
                if step.kind == "remove_duplicates" and step.values["repeated"] is None:
                    kept.append(out)
                shuffled = shuffled or step.shuffles
                steps.append(step)
                kept += [step.values[k] for k in ("repeated", "mapping", "hot") if isinstance(step.values.get(k), DataFrame)]
    return Cleaned(out, warnings, steps, kept)


def apply_cleaning(df: DataFrame, operations: Sequence[Mapping]) -> tuple[DataFrame, list[str]]:
    """The cleaned table and the warnings."""
    result = clean(df, operations)
    return result.table, result.warnings


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself, or ValueError when cleaning left nothing."""
    if df.isEmpty():
        raise ValueError(NOTHING_LEFT)
    return df


def cleaning_report(df: DataFrame, result: Cleaned) -> DataFrame:
    """One row: rows and columns before and after, rows removed, warnings."""
    none = F.lit(None).cast("long")
    before = df.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("rows_after", none)
    after = result.table.agg(F.count(F.lit(1)).alias("rows_after")).select(none.alias("rows_before"), "rows_after")
    both = before.unionByName(after).agg(
        F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after")
    )
    return both.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(len(df.columns)).alias("columns_before"),
        F.lit(len(result.table.columns)).alias("columns_after"),
        F.lit("\n".join(result.warnings)).alias("warnings"),
    )
