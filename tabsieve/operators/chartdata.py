"""The table behind each chart: aggregated in Spark, ready to be drawn."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import col, double, is_present, number
from tabsieve.operators.association import correlation_matrix
from tabsieve.operators.frequency import top_values
from tabsieve.operators.quality import Fences, fences
from tabsieve.operators.quantiles import exact_quantiles, extents
from tabsieve.operators.schema import is_integral, is_numeric, require_column, require_numeric

# The names of the supported charts.
CHART_TYPES = (
    "Histogram",
    "Line Plot",
    "Bar Chart",
    "Scatter Plot",
    "Box Plot",
    "Heatmap",
    "Violin Plot",
    "Pie Chart",
    "Area Plot",
)

BAR_VALUES, PIE_VALUES = 20, 10
# Rows of a seeded sample.
SAMPLE_POINTS = 1000
MAX_POINTS = 1000
GRID_CELLS = 100
CURVE_POINTS = 200
# Cells per kernel bandwidth. A cell counts by its mean and variance: the curve
# is the exact one but for about 1e-7 of its height.
CELLS_PER_BANDWIDTH = 64
# Kernel tails beyond this many bandwidths are below 1e-15 of its height, less
# than the last digit of a double.
KERNEL_REACH = 8.5


def _position(df: DataFrame, name: str) -> Column:
    """An order column as a number: dates and times in microseconds since 1970."""
    field = require_column(df, name)
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", epoch, col(name).cast("timestamp_ntz")).cast("double")
    return number(df, name) if is_numeric(field) else require_numeric(df, name)


def _equal_cell(value: Column, low: float, high: float, cells: int) -> Column:
    """0-based index among ``cells`` equal cells of [low, high], last one closed."""
    if low == high:
        return F.lit(0)
    place = F.floor((value - F.lit(low)) / F.lit(high - low) * cells)
    return F.least(F.greatest(place, F.lit(0)), F.lit(cells - 1)).cast("int")


# -- Line and area ---------------------------------------------------------------


def line_points(df: DataFrame, column: str, order_col: str) -> DataFrame:
    """(x, y) of every row with both values, lazily; draw them in order of x."""
    require_numeric(df, column)
    points = df.select(_position(df, order_col).alias("x"), number(df, column).alias("y"))
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def area_points(df: DataFrame, column: str, order_col: str) -> DataFrame:
    """``line_points`` with missing values read as zero; no rows for text columns."""
    field = require_column(df, column)
    x = _position(df, order_col).alias("x")
    if not is_numeric(field):
        return df.select(x, F.lit(None).cast("double").alias("y")).limit(0)
    return df.select(x, F.coalesce(number(df, column), F.lit(0.0)).alias("y")).where(F.col("x").isNotNull())


def line_series(df: DataFrame, column: str, order_col: str, max_points: int = MAX_POINTS) -> DataFrame:
    """(bucket, x_min, x_max, n, min, avg, max) along ``order_col``.

    Up to ``max_points`` equal buckets of the order range; every row counts in
    exactly one of them, missing values of ``column`` are skipped.
    """
    require_numeric(df, column)
    points = df.select(_position(df, order_col).alias("x"), number(df, column).alias("y"))
    return _series(points, max_points)


def area_series(df: DataFrame, column: str, order_col: str, max_points: int = MAX_POINTS) -> DataFrame:
    """``line_series`` with missing values read as zero; no rows for text columns."""
    field = require_column(df, column)
    x = _position(df, order_col)
    if not is_numeric(field):
        none = F.lit(None).cast("double")
        return _buckets(df.select(x.alias("x"), none.alias("y")).limit(0), F.lit(0))
    return _series(df.select(x.alias("x"), F.coalesce(number(df, column), F.lit(0.0)).alias("y")), max_points)


def _series(points: DataFrame, max_points: int) -> DataFrame:
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    span = points.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    cell = F.lit(0) if span["low"] is None else _equal_cell(F.col("x"), span["low"], span["high"], max_points)
    return _buckets(points, cell)


def _buckets(points: DataFrame, cell: Column) -> DataFrame:
    return points.groupBy(cell.alias("bucket")).agg(
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.count(F.lit(1)).alias("n"),
        F.min("y").alias("min"),
        F.avg("y").alias("avg"),
        F.max("y").alias("max"),
    )


# -- Histogram -------------------------------------------------------------------


def auto_bins(f: Fences, integral: bool) -> tuple[float, float, int]:
    """(low, high, bins) by the 'auto' width rule.

    Width = min(max(Freedman-Diaconis, half the square-root width), Sturges),
    at least 1 for integers.
    """
    if not f.n:
        return 0.0, 1.0, 1
    if f.low == f.high:
        return f.low - 0.5, f.high + 0.5, 1
    spread = f.high - f.low
    sturges = spread / (math.log2(f.n) + 1.0)
    root = spread / math.sqrt(f.n)
    diaconis = 2.0 * f.iqr * f.n ** (-1.0 / 3.0)
    width = min(max(diaconis, root / 2.0), sturges)
    if integral:
        width = max(width, 1.0)
    return f.low, f.high, math.ceil(spread / width)


def histogram(df: DataFrame, column: str, bins: int | None = None, known: Fences | None = None) -> DataFrame:
    """(bin, lo, hi, n) with equal bins, empty ones included, last one closed."""
    field = require_numeric(df, column)
    known = known or fences(df, [column])[column]
    low, high, auto = auto_bins(known, is_integral(field))
    bins = auto if bins is None else bins
    value = double(df, column)
    step = F.lit((high - low) / bins)
    # The edges as shown decide: a value rounded across one goes back.
    near = _equal_cell(value, low, high, bins).cast("long")
    shift = (
        F.when(F.col("v") < F.lit(low) + F.col("near") * step, F.lit(-1))
        .when((F.col("v") >= F.lit(low) + (F.col("near") + 1) * step) & (F.col("near") < bins - 1), F.lit(1))
        .otherwise(F.lit(0))
    )
    counts = (
        df.where(is_present(df, column))
        .select(value.alias("v"), near.alias("near"))
        .groupBy((F.col("near") + shift).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Empty bins come as rows of count 0 and merge in the next aggregate.
    empty = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("long").alias("n"))
    all_bins = counts.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n"))
    return all_bins.select(
        "bin",
        (F.lit(low) + F.col("bin") * step).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(F.lit(low) + (F.col("bin") + 1) * step).alias("hi"),
        "n",
    )


# -- Bar and pie -----------------------------------------------------------------


def bar_counts(df: DataFrame, column: str, k: int = BAR_VALUES) -> DataFrame:
    """(value, n): the k most frequent values, ties by value."""
    return top_values(df, column, k)


def pie_shares(df: DataFrame, column: str, k: int = PIE_VALUES) -> DataFrame:
    """(value, n, share): top k with percentages of the shown total, 1 digit."""
    top = top_values(df, column, k)
    packed = top.agg(F.collect_list(F.struct("value", "n")).alias("rows"), F.sum("n").alias("total"))
    return packed.select(F.inline("rows"), "total").select(
        "value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("share")
    )


# -- Box -------------------------------------------------------------------------


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, p25, median, p75, whisker_low, whisker_high, outliers.

    Whiskers end at the most extreme value within 1.5 IQR of the quartiles.
    """
    require_numeric(df, column)
    known = extents(df, [column])
    q = exact_quantiles(df, {column: (0.25, 0.5, 0.75)}, known)[column]
    f = Fences(known[column].n, known[column].low, known[column].high, q[0.25], q[0.75])
    value = number(df, column)
    inside = value.between(F.lit(f.lower), F.lit(f.upper)) if f.n else F.lit(False)
    return df.agg(
        F.count(value).alias("n"),
        F.lit(q[0.25]).cast("double").alias("p25"),
        F.lit(q[0.5]).cast("double").alias("median"),
        F.lit(q[0.75]).cast("double").alias("p75"),
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(value.isNotNull() & ~inside).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str) -> DataFrame:
    """(value, n): every value beyond the whiskers with its number of rows."""
    require_numeric(df, column)
    f = fences(df, [column])[column]
    value = number(df, column)
    outside = ~value.between(F.lit(f.lower), F.lit(f.upper)) if f.n else F.lit(False)
    return df.where(outside).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """The k rows whose keys have the smallest hashes under a seed, with the columns of ``df``.

    Independent of partitions and of the order of rows; every task keeps its own
    k smallest. Rows of one key come in the order of their other columns.
    """
    for c in key:
        require_column(df, c)
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in key])
    plain = [col(c) for c, t in df.dtypes if not t.startswith("map")]
    return df.withColumn("__mark", F.md5(text.cast("binary"))).orderBy("__mark", *plain).limit(k).drop("__mark")


def box_outlier_sample(df: DataFrame, column: str, key: Sequence[str], k: int = SAMPLE_POINTS, seed: int = 0) -> DataFrame:
    """(*key, value) of at most k rows beyond the whiskers; ``box_outliers`` has all of them."""
    require_numeric(df, column)
    f = fences(df, [column])[column]
    value = number(df, column)
    outside = ~value.between(F.lit(f.lower), F.lit(f.upper)) if f.n else F.lit(False)
    return seeded_sample(df.where(outside).select(*[col(c) for c in key], value.alias("value")), key, k, seed)


# -- Scatter ---------------------------------------------------------------------


def _scatter_pairs(df: DataFrame, column: str, x_column: str) -> DataFrame:
    require_numeric(df, column)
    pairs = df.select(_position(df, x_column).alias("x"), number(df, column).alias("y"))
    return pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def scatter_points(df: DataFrame, column: str, x_column: str) -> DataFrame:
    """(x, y, n): every distinct point with the number of rows on it."""
    return _scatter_pairs(df, column, x_column).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def scatter_sample(df: DataFrame, column: str, x_column: str, key: Sequence[str], k: int = SAMPLE_POINTS, seed: int = 0) -> DataFrame:
    """(*key, x, y) of at most k points; ``scatter_points`` has all of them."""
    require_numeric(df, column)
    points = df.select(*[col(c) for c in key], _position(df, x_column).alias("x"), number(df, column).alias("y"))
    return seeded_sample(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()), key, k, seed)


def scatter_grid(df: DataFrame, column: str, x_column: str, cells: int = GRID_CELLS) -> DataFrame:
    """(x_bin, y_bin, n, x, y): row counts and mean point per cell of a grid."""
    pairs = _scatter_pairs(df, column, x_column)
    s = pairs.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).first()
    if s["x0"] is None:
        xb = yb = F.lit(0)
    else:
        xb = _equal_cell(F.col("x"), s["x0"], s["x1"], cells)
        yb = _equal_cell(F.col("y"), s["y0"], s["y1"], cells)
    return pairs.groupBy(xb.alias("x_bin"), yb.alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )


def scatter_data(df: DataFrame, column: str, x_column: str, grid: bool = False) -> DataFrame:
    """(n, x, y): all points, or the cells of a grid if the caller asks for them."""
    made = scatter_grid if grid else scatter_points
    return made(df, column, x_column).select("n", "x", "y")


# -- Density curve and violin ------------------------------------------------------


@dataclass
class _Kernel:
    n: int
    low: float
    high: float
    bandwidth: float


def _kernel(df: DataFrame, column: str) -> _Kernel | None:
    """Scott's bandwidth std * n^(-1/5); None where no density exists."""
    v = number(df, column)
    r = df.agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std")
    ).first()
    if r["n"] < 2 or not r["std"]:
        return None
    return _Kernel(r["n"], r["low"], r["high"], r["std"] * r["n"] ** -0.2)


_CURVE = "point int, x double, density double"


def _density(df: DataFrame, column: str, k: _Kernel, start: float, stop: float, points: int) -> DataFrame:
    """Gaussian kernel density on an even grid.

    Rows are first counted in cells much narrower than the kernel; each cell
    then adds to the grid points within the kernel's reach only, and the sums
    are combined within the tasks before ``points`` groups are shuffled.
    """
    v = double(df, column)
    cell = F.floor((v - F.lit(k.low)) / F.lit(k.bandwidth / CELLS_PER_BANDWIDTH))
    cells = (
        df.where(is_present(df, column))
        .groupBy(cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("at"), F.var_pop(v).alias("var"))
    )
    step = (stop - start) / (points - 1)
    reach = KERNEL_REACH * k.bandwidth
    first = F.greatest(F.ceil((F.col("at") - reach - start) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("at") + reach - start) / step), F.lit(points - 1)).cast("int")
    hits = cells.where(first <= last).select("n", "at", "var", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.lit(start) + F.col("point") * F.lit(step) - F.col("at")) / F.lit(k.bandwidth)
    bend = F.lit(1.0) + (z * z - 1) * F.col("var") * F.lit(0.5 / k.bandwidth**2)
    weight = F.col("n") * F.exp(z * z * F.lit(-0.5)) * bend
    height = 1.0 / (k.n * k.bandwidth * math.sqrt(2.0 * math.pi))
    zero = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), F.lit(0.0).alias("w"))
    summed = hits.select("point", weight.alias("w")).unionByName(zero).groupBy("point").agg(F.sum("w").alias("w"))
    return summed.select(
        "point",
        (F.lit(start) + F.col("point") * F.lit(step)).alias("x"),
        (F.col("w") * F.lit(height)).alias("density"),
    )


def density_curve(df: DataFrame, column: str, points: int = CURVE_POINTS) -> DataFrame:
    """(point, x, density) of a Gaussian kernel density from minimum to maximum."""
    require_numeric(df, column)
    k = _kernel(df, column)
    if k is None:
        return df.sparkSession.createDataFrame([], _CURVE)
    return _density(df, column, k, k.low, k.high, points)


def histogram_curve(
    df: DataFrame, column: str, points: int = CURVE_POINTS, known: Fences | None = None
) -> DataFrame:
    """(point, x, density, height): the density scaled to the histogram's counts."""
    field = require_numeric(df, column)
    f = known or fences(df, [column])[column]
    low, high, bins = auto_bins(f, is_integral(field))
    area = f.n * (high - low) / bins
    return density_curve(df, column, points).withColumn("height", F.col("density") * F.lit(area))


def violin_curve(df: DataFrame, column: str, points: int = CURVE_POINTS) -> DataFrame:
    """(point, x, density) with the grid extended by two bandwidths on each side."""
    if not is_numeric(require_column(df, column)):
        raise ValueError(f"'{column}' is not numeric")
    k = _kernel(df, column)
    if k is None:
        return df.sparkSession.createDataFrame([], _CURVE)
    return _density(df, column, k, k.low - 2 * k.bandwidth, k.high + 2 * k.bandwidth, points)


# -- One entry for all charts ------------------------------------------------------


def chart_data(
    df: DataFrame,
    chart_type: str,
    column: str,
    x_column: str | None = None,
    order_col: str | None = None,
) -> dict[str, DataFrame]:
    """The tables one chart is drawn from, by role.

    Line and area charts, and scatter charts without ``x_column``, run along
    ``order_col``: a distributed table has no row number.
    """
    if chart_type not in CHART_TYPES:
        raise ValueError(f"Unknown chart type: {chart_type}")
    if chart_type == "Heatmap":
        return {"cells": correlation_matrix(df)}
    require_column(df, column)
    if chart_type == "Histogram":
        require_numeric(df, column)
        known = fences(df, [column])[column]
        return {"bins": histogram(df, column, known=known), "curve": histogram_curve(df, column, known=known)}
    if chart_type == "Bar Chart":
        return {"bars": bar_counts(df, column)}
    if chart_type == "Pie Chart":
        return {"slices": pie_shares(df, column)}
    if chart_type == "Box Plot":
        return {"box": box_stats(df, column), "outliers": box_outliers(df, column)}
    if chart_type == "Violin Plot":
        return {"curve": violin_curve(df, column), "box": box_stats(df, column)}
    along = x_column if chart_type == "Scatter Plot" and x_column else order_col
    if along is None:
        raise ValueError(f"{chart_type} needs an order column.")
    if chart_type == "Scatter Plot":
        return {"points": scatter_data(df, column, along), "grid": scatter_data(df, column, along, grid=True)}
    if chart_type == "Line Plot":
        return {"points": line_points(df, column, along), "series": line_series(df, column, along)}
    return {"points": area_points(df, column, along), "series": area_series(df, column, along)}
