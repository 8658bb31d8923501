"""Exact order statistics and quantiles without sorting or shuffling the data.

A quantile sketch of every column, from one scan, gives each wanted rank a narrow
interval of values. One more scan counts what lies below the intervals and the
distinct values inside them: two scans, whatever the number of columns and ranks.

Few ranks, which fit into one pass, and those that a sketch should have missed are found by narrowing: a pass counts
the rows of an interval in cells and keeps the cell that holds the rank, whose
smallest and largest value are the next interval. A value that fills a third of the rows is
one row or one cell everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.values import col, double, number
from tabsieve.operators.ranks import average_ranks, distinct_sizes
from tabsieve.operators.schema import require_numeric
from tabsieve.plans.compiled import small_methods
from tabsieve.plans.held import held
from tabsieve.plans.tall import tall

# Size of the quantile sketches, and the part of the rows by which a rank that is read from
# them may be off: half again the published bound of 2.3 / k ** 0.9.
SKETCH_K = 2048
SKETCH_ERROR = 3.5 / SKETCH_K**0.9
CELLS = 1024
# An interval with at most this many rows is fetched value by value.
FETCH_ROWS = 4096
# Intervals counted in one pass; bounds the rows fetched by CELLS times this.
INTERVALS_PER_PASS = 64


@dataclass
class Extent:
    """Count and range of the finite values of a column."""

    n: int
    low: float | None
    high: float | None


@dataclass
class _Interval:
    column: str
    low: float
    high: float
    below: int
    count: int
    ranks: set[int]
    log_scale: bool = False
    cells: list = field(default_factory=list)

    def use_log(self) -> bool:
        return self.log_scale or math.isinf(self.high - self.low)


def extents(df: DataFrame, columns: Sequence[str]) -> dict[str, Extent]:
    """Count, minimum and maximum of every named column in one aggregate."""
    for c in columns:
        require_numeric(df, c)
    found = (
        tall(df, [[number(df, c)] for c in columns], ["v"])
        .groupBy("idx")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    rows = {r["idx"]: Extent(r["n"], r["low"], r["high"]) for r in found.collect()}
    return {c: rows.get(i, Extent(0, None, None)) for i, c in enumerate(columns)}


def _log_position(value: Column) -> Column:
    """Monotone map of all doubles onto about [-1456, 1456]; zero stays zero."""
    size = F.abs(value)
    return F.when(size > 0, F.signum(value) * (F.ln(size) + F.lit(746.0))).otherwise(F.lit(0.0))


def _log_position_of(value: float) -> float:
    return math.copysign(math.log(abs(value)) + 746.0, value) if value else 0.0


def _cell(value: Column, part: _Interval) -> Column:
    if part.use_log():
        low, high = _log_position_of(part.low), _log_position_of(part.high)
        value = _log_position(value)
        if high <= low:
            return F.lit(0.0)
    else:
        low, high = part.low, part.high
    share = (value - F.lit(low)) / F.lit(high - low)
    return F.least(F.greatest(F.floor(share * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("double")


def _count_cells(df: DataFrame, parts: Sequence[_Interval]) -> None:
    """One pass: fill ``cells`` of every interval with (count, min, max) in order."""
    # The disjunction on bare columns prunes row groups at the scan.
    near = [col(p.column).between(F.lit(p.low), F.lit(p.high)) for p in parts]
    rows: list[tuple[Column, Column]] = []
    for p in parts:
        v = double(df, p.column)  # NaN and infinities are outside any interval
        x = F.when(v.between(F.lit(p.low), F.lit(p.high)), v)
        rows.append((x, x if p.count <= FETCH_ROWS else _cell(v, p)))
    counted = (
        tall(df.where(reduce(lambda a, b: a | b, near)), rows, ("x", "cell"))
        .where(F.col("x").isNotNull())
        .groupBy("idx", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    for p in parts:
        p.cells = []
    for r in counted.collect():  # at most CELLS (or FETCH_ROWS) rows per interval
        parts[r["idx"]].cells.append((r["low"], r["high"], r["n"]))
    for p in parts:
        p.cells.sort()


@dataclass
class _Part:
    """An interval of values that should hold some ranks of a column."""

    column: str
    low: float
    high: float
    ranks: set[int]


def _sketched(df: DataFrame, ranks: Mapping[str, set[int]], known: Mapping[str, Extent]) -> list[_Part]:
    """One scan: an interval for each rank, overlapping ones made one."""
    columns = list(ranks)
    sketches = df.agg(*[F.kll_sketch_agg_double(number(df, c), F.lit(SKETCH_K)).alias(f"s{i}") for i, c in enumerate(columns)])
    spots: dict[str, list[tuple[int, float, float]]] = {}
    for c in columns:
        n = known[c].n
        spots[c] = [(r, r / n - SKETCH_ERROR, (r + 1) / n + SKETCH_ERROR) for r in sorted(ranks[c])]
    shares = [F.array(*[F.lit(min(1.0, max(0.0, p))) for _, a, b in spots[c] for p in (a, b)]) for c in columns]
    read = [F.kll_sketch_get_quantile_double(f"s{i}", s).alias(f"q{i}") for i, s in enumerate(shares)]
    parts: list[_Part] = []
    for c, values in zip(columns, sketches.select(*read).first()):
        first = len(parts)
        for k, (r, a, b) in enumerate(spots[c]):
            low = known[c].low if a <= 0 else values[2 * k]
            high = known[c].high if b >= 1 else values[2 * k + 1]
            if len(parts) > first and low <= parts[-1].high:
                parts[-1].high = max(parts[-1].high, high)
                parts[-1].ranks.add(r)
            else:
                parts.append(_Part(c, low, high, {r}))
    return parts


def _keys(parts: Sequence[_Part]) -> tuple[list[str], int, dict[int, _Part]]:
    """Columns, the most intervals of a column, and the intervals by number: those of the i-th
    column begin at i times that most, in the order of their values."""
    columns = list(dict.fromkeys(p.column for p in parts))
    own = {c: [p for p in parts if p.column == c] for c in columns}
    most = max(len(v) for v in own.values())
    # One number more for what lies above all intervals.
    return columns, most + 1, {i * (most + 1) + j: p for i, c in enumerate(columns) for j, p in enumerate(own[c])}


def _inside(df: DataFrame, parts: Sequence[_Part]) -> DataFrame:
    """(idx, value, n): how often each value of an interval occurs, idx being the interval's
    number, and, with a value of NULL, how many values lie between it and the one before.

    One scan and one row per value, whatever the number of intervals; only values
    inside of intervals keep their own row in the exchange.
    """
    columns, width, keys = _keys(parts)

    def bound(j: int, side: str) -> Column:
        ends = [keys.get(i * width + j) for i in range(len(columns))]
        return F.get(F.array(*[F.lit(getattr(p, side) if p else math.inf) for p in ends]), F.col("idx"))

    v = F.col("v")
    values = tall(df, [[number(df, c)] for c in columns], ["v"]).where(v.isNotNull())
    past = reduce(lambda a, b: a + b, [(v > bound(j, "high")).cast("int") for j in range(width - 1)])
    inside = reduce(lambda a, b: a | b, [(v >= bound(j, "low")) & (v <= bound(j, "high")) for j in range(width - 1)])
    found = values.select((F.col("idx") * width + past).alias("idx"), F.when(inside, v).alias("value"))
    return found.groupBy("idx", "value").agg(F.count(F.lit(1)).alias("n"))


def _below(parts: Sequence[_Part], outside: Mapping[int, int], totals: Mapping[int, int]) -> dict[int, int]:
    """How many values of its column lie below each interval."""
    columns, width, keys = _keys(parts)
    out, before = {}, 0
    for key in range(len(columns) * width):
        before = 0 if key % width == 0 else before
        if key in keys:
            out[key] = before + outside.get(key, 0)
        before += totals.get(key, 0)
    return out


def _at_ranks(found: DataFrame, parts: Sequence[_Part], fetch: bool) -> dict[tuple[str, int], float]:
    """The values at the ranks of the parts, where they lie inside of them."""
    out: dict[tuple[str, int], float] = {}
    keys = _keys(parts)[2]

    def take(key: int, value: float, first: int, n: int) -> None:
        out.update({(keys[key].column, r): value for r in keys[key].ranks if first <= r < first + n})

    if fetch:
        cells: dict[int, list] = {}
        outside: dict[int, int] = {}
        for r in found.collect():
            if r["value"] is None:
                outside[r["idx"]] = r["n"]
            else:
                cells.setdefault(r["idx"], []).append((r["value"], r["n"]))
        totals = {k: outside.get(k, 0) + sum(n for _, n in cells.get(k, ())) for k in {*cells, *outside}}
        below = _below(parts, outside, totals)
        for key, values in cells.items():
            at = below[key]
            for value, n in sorted(values):
                take(key, value, at, n)
                at += n
        return out
    with held(found, "inside") as table:
        sums = table.groupBy("idx").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("outside")).collect()
        below = _below(parts, {r["idx"]: r["outside"] or 0 for r in sums}, {r["idx"]: r["total"] for r in sums})
        inside = table.where("value IS NOT NULL")
        ranked = average_ranks(inside, distinct_sizes(inside))
        first = (F.col("rank") - (F.col("n") + 1) / F.lit(2.0)).cast("long")
        wanted = [(k, r, r - below[k]) for k, p in keys.items() for r in p.ranks]
        # One row for each rank; a condition with a term for each would be too deep for Spark.
        spots = found.sparkSession.createDataFrame(wanted, "idx int, wanted bigint, spot bigint")
        cells = ranked.select("idx", "value", "n", first.alias("first"))
        at = (F.col("first") <= F.col("spot")) & (F.col("spot") < F.col("first") + F.col("n"))
        hits = cells.join(F.broadcast(spots), "idx").where(at)
        for r in hits.select("idx", "wanted", "value").collect():
            out[(keys[r["idx"]].column, r["wanted"])] = r["value"]
    return out


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Iterable[int]], known: Mapping[str, Extent]
) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks of the sorted finite values."""
    found: dict[tuple[str, int], float] = {}
    small, large = [], {}
    for c, wanted in ranks.items():
        wanted, e = set(wanted), known[c]
        if wanted and e.low == e.high:
            found.update({(c, r): e.low for r in wanted})
        elif wanted and e.n <= FETCH_ROWS:
            small.append(_Part(c, e.low, e.high, wanted))
        elif wanted:
            large[c] = wanted
    if sum(len(w) for w in large.values()) <= INTERVALS_PER_PASS:
        # Few ranks share each narrowing pass, which is cheaper than sketches.
        found.update(_narrowed(df, large, known))
        large = {}
    parts = small + (_sketched(df, large, known) if large else [])
    if not parts:
        return found
    # Expected rows inside of an interval; more are not fetched but ranked where they are.
    most = max((known[c].n * 2 * SKETCH_ERROR * len(w) for c, w in large.items()), default=0)
    found.update(_at_ranks(_inside(df, parts), parts, most <= FETCH_ROWS))
    missed = {c: {r for r in w if (c, r) not in found} for c, w in large.items()}
    found.update(_narrowed(df, {c: w for c, w in missed.items() if w}, known))
    return found


def _narrowed(
    df: DataFrame, ranks: Mapping[str, set[int]], known: Mapping[str, Extent]
) -> dict[tuple[str, int], float]:
    """The same by narrowing passes alone."""
    found: dict[tuple[str, int], float] = {}
    todo: list[_Interval] = []

    def place(part: _Interval) -> None:
        if part.low == part.high:
            found.update({(part.column, r): part.low for r in part.ranks})
        else:
            todo.append(part)

    for c, wanted in ranks.items():
        place(_Interval(c, known[c].low, known[c].high, 0, known[c].n, wanted))

    while todo:
        batch, todo[:] = todo[:INTERVALS_PER_PASS], todo[INTERVALS_PER_PASS:]
        _count_cells(df, batch)
        for part in batch:
            below = part.below
            for low, high, n in part.cells:
                hit = {r for r in part.ranks if below <= r < below + n}
                if hit:
                    # Change the scale when this one hardly separates the rows.
                    slow = n * 8 > part.count and not part.use_log()
                    place(_Interval(part.column, low, high, below, n, hit, slow))
                below += n
    return found


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    known: Mapping[str, Extent] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation at (n - 1) * q per column."""
    columns = list(probabilities)
    for c in columns:
        require_numeric(df, c)
    if known is None:
        with small_methods(df.sparkSession):
            known = extents(df, columns)
    ranks: dict[str, set[int]] = {}
    for c in columns:
        n = known[c].n
        spots = [(n - 1) * q for q in probabilities[c]] if n else []
        ranks[c] = {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}
    with small_methods(df.sparkSession):
        values = order_statistics(df, ranks, known)
    out: dict[str, dict[float, float | None]] = {}
    for c in columns:
        out[c] = {}
        for q in probabilities[c]:
            if not known[c].n:
                out[c][q] = None
                continue
            spot = (known[c].n - 1) * q
            low, high = values[(c, math.floor(spot))], values[(c, math.ceil(spot))]
            out[c][q] = low + (high - low) * (spot - math.floor(spot))
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Long table (column, probability, value) of exact quantiles."""
    result = exact_quantiles(df, {c: probabilities for c in columns})
    rows = [(c, float(q), v) for c in columns for q, v in result[c].items()]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")
