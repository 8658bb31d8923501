"""Pairwise correlation, p-values, the correlation matrix, linear regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.rounding import half_up
from tabsieve.functions.student import correlation_p_value
from tabsieve.functions.values import double, number
from tabsieve.operators.batches import column_sums, rank_products, rank_sums_by_value, value_counts_by_partner
from tabsieve.operators.batches import gram_matrix as _gram_matrix
from tabsieve.operators.profile import moments
from tabsieve.operators.ranks import average_ranks, distinct_sizes
from tabsieve.operators.schema import complete_rows, numeric_columns, require_numeric
from tabsieve.plans.compiled import small_methods
from tabsieve.plans.held import hold, released
from tabsieve.plans.lookup import BROADCAST_BYTES, HOT_SHARE, lookup
from tabsieve.plans.tall import tall
from tabsieve.plans.together import together

METHODS = ("pearson", "spearman")
# Pairs per aggregate; more pairs take further scans of the table.
PAIRS_PER_SCAN = 256
# Plain sums that fit into one method small enough to be compiled, in one scan.
PRODUCTS_PER_SCAN = 40
# More columns are not turned into rows but added up by batches.
COLUMNS_EXPANDED = 12
# A spread that is a smaller part of its sum of squares is computed anew, pair by pair.
CANCELLED = 1e-8
# Columns of a side whose ranks within pairs are brought back to the rows together.
RANKED_TOGETHER = 4
# The sentence that explains a fit and its error, and the grades of R2.
FIT_SENTENCE = (
    "For each unit increase in '%s', '%s' %s by %.4f. The model explains %.1f%% of variance (%s fit)."
)
TOO_FEW_ROWS = "Need at least 2 non-null rows to fit a regression model."
STRONG_FIT, MODERATE_FIT = 0.7, 0.4
DIGITS, P_DIGITS = 4, 6

Pair = tuple[str, str]


def _pair_moments(df: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> list[tuple[int, float | None]]:
    """(n, r) of each pair over the rows where both sides are present.

    One group per pair keeps the generated code small and gives every pair its
    own reducer. corr() raises on a constant column, so r is built from its parts.
    """
    out: list[tuple[int, float | None]] = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        part = pairs[start : start + PAIRS_PER_SCAN]
        both = tall(df, part, ("x", "y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        found = both.groupBy("idx").agg(
            F.count(F.lit(1)).alias("n"),
            F.covar_pop("x", "y").alias("cov"),
            F.stddev_pop("x").alias("sx"),
            F.stddev_pop("y").alias("sy"),
            # The spread of a constant may be a little above 0 after it is merged.
            ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("constant"),
        )
        rows = {r["idx"]: r for r in found.collect()}
        for i in range(len(part)):
            r = rows.get(i)
            if r is None or r["n"] < 2 or r["constant"] or not r["sx"] or not r["sy"]:
                out.append((r["n"] if r else 0, None))
            else:
                out.append((r["n"], max(-1.0, min(1.0, r["cov"] / (r["sx"] * r["sy"])))))
    return out


def _centered_products(
    df: DataFrame, values: dict[str, Column], pairs: Sequence[Pair]
) -> dict[Pair, float]:
    """Sums of products of centred columns that have no missing values.

    Plain sums cost a few nanoseconds per pair and row; there are at most as
    many as one compiled method can hold.
    """
    own = {c: f"v{i}" for i, c in enumerate(values)}
    centred = df.select(*[values[c].alias(v) for c, v in own.items()])
    sums = centred.agg(*[F.sum(F.col(own[a]) * F.col(own[b])).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return dict(zip(pairs, sums.first()))


def _complete_pairs(
    df: DataFrame, values: dict[str, Column], rows: int, constant: set[str], pairs: Sequence[Pair]
) -> dict[Pair, tuple[int, float | None]]:
    """(n, r) of pairs of centred columns without missing values.

    Few pairs are plain sums of one scan, many are one Gram matrix of one scan.
    """
    if not pairs:
        return {}
    open_pairs = [p for p in pairs if not constant & set(p)]
    used = list(dict.fromkeys(c for p in open_pairs for c in p))
    wanted = list(dict.fromkeys([*open_pairs, *((c, c) for c in used)]))
    found: dict[Pair, float] = {}
    if len(wanted) > PRODUCTS_PER_SCAN and rows > 1:
        matrix = _gram_matrix(df, [values[c] for c in used])
        at = {c: i for i, c in enumerate(used)}
        spread = np.sqrt(np.diag(matrix))
        found = {(a, b): _share(matrix[at[a], at[b]], spread[at[a]] * spread[at[b]]) for a, b in open_pairs}
    elif wanted and rows > 1:
        sums = _centered_products(df, {c: values[c] for c in used}, wanted)
        for a, b in open_pairs:
            spread = math.sqrt(sums[(a, a)]) * math.sqrt(sums[(b, b)])
            found[(a, b)] = _share(sums[(a, b)], spread)
    out: dict[Pair, tuple[int, float | None]] = {}
    for p in pairs:
        r = found.get(p, math.nan)
        out[p] = (rows, None if math.isnan(r) else max(-1.0, min(1.0, r)))
    return out


def _share(part: float, whole: float) -> float:
    return float(part / whole) if whole and math.isfinite(whole) else math.nan


def _gap_pairs(df: DataFrame, values: dict[str, Column], pairs: Sequence[Pair]) -> dict[Pair, tuple[int, float | None]]:
    """(n, r) of pairs of centred columns, over the rows where both are present.

    With x being 0 where it is missing and m telling where it is not, all sums of
    all pairs are cells of the Gram matrix of x, x squared and m. Pairs that
    lose their digits in it, such as those with a constant side, are computed anew.
    """
    if not pairs:
        return {}
    used = list(dict.fromkeys(c for p in pairs for c in p))
    gram = _gram_matrix(df, [values[c] for c in used], True)
    cell = lambda i, j: float(gram[i, j])
    k = len(used)
    at = {c: i for i, c in enumerate(used)}
    mask = {c: 2 * k + i for c, i in at.items()}
    found: dict[Pair, tuple[int, float | None]] = {}
    again: list[Pair] = []
    for p in pairs:
        (i, j), (mi, mj) = (at[c] for c in p), (mask[c] for c in p)
        n, si, sj, qi, qj, ij = cell(mi, mj), cell(i, mj), cell(j, mi), cell(k + i, mj), cell(k + j, mi), cell(i, j)
        if n < 2 or qi == 0 or qj == 0:
            found[p] = (round(n), None)
            continue
        di, dj = qi - si * si / n, qj - sj * sj / n
        if not (math.isfinite(qi + qj) and di > CANCELLED * qi and dj > CANCELLED * qj):
            again.append(p)
            continue
        found[p] = (round(n), max(-1.0, min(1.0, (ij - si * sj / n) / math.sqrt(di) / math.sqrt(dj))))
    found.update(zip(again, _pair_moments(df, [(values[a], values[b]) for a, b in again])))
    return found


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Rows, counts, means and ranges; those of many columns are added up by batches."""
    if len(columns) <= COLUMNS_EXPANDED:
        return moments(df, columns, ("mean",))
    found = column_sums(df, [number(df, c) for c in columns])
    none = {"rows": 0, "count": 0, "null_count": 0, "mean": None, "low": None, "high": None}
    return {c: found.get(i, none) for i, c in enumerate(columns)}


def _pearson(df: DataFrame, columns: Sequence[str], pairs: Sequence[Pair]) -> list[tuple[int, float | None]]:
    """Two scans for any number of columns: the means, then centred sums."""
    seen = _means(df, columns)
    complete = {c for c in columns if seen[c]["count"] and not seen[c]["null_count"]}
    filled = [c for c in columns if seen[c]["count"]]
    easy = [p for p in pairs if complete.issuperset(p)]
    hard = [p for p in pairs if not complete.issuperset(p) and set(filled).issuperset(p)]
    centred = {c: number(df, c) - F.lit(seen[c]["mean"]) for c in filled}
    constant = {c for c in complete if seen[c]["low"] == seen[c]["high"]}
    found, rest = together(
        df.sparkSession,
        lambda: _complete_pairs(df, centred, seen[columns[0]]["rows"], constant, easy),
        lambda: _gap_pairs(df, centred, hard),
    )
    found.update(rest)
    return [found.get(p, (0, None)) for p in pairs]


def _spearman(df: DataFrame, columns: Sequence[str], pairs: Sequence[Pair]) -> list[tuple[int, float | None]]:
    """Correlation of average ranks, taken within the complete rows of each pair.

    One counting shuffle serves all columns. A column without missing values
    leaves its partners' ranks unchanged, so a value has one rank per
    partner *with* missing values plus one for all others. Sizes and spreads follow from the
    counts; only sums of products are taken over the rows. Rank tables that fit a broadcast, by
    their counted size, the smallest first, are looked up where the rows are. A column beyond
    that meets them by its values: one shuffle of sums for each. Pairs of two such columns meet
    their ranks as narrow (row, column, value) rows in a skew-safe lookup, and one shuffle
    by row brings them back.
    """
    numbers = [number(df, c).alias(f"v{i}") for i, c in enumerate(columns)]
    with released(df.sparkSession):
        values = df.select(*numbers)
        names = values.columns
        counts = values.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in names]).first()
        rows = counts["rows"]
        partners = [c for c in names if counts[c] < rows]
        table = hold(value_counts_by_partner(values, partners), "counts")
        sizes = distinct_sizes(table)
        ranked = hold(average_ranks(table, sizes, len(partners)), "ranks")
        index = {p: j for j, p in enumerate(partners)}
        at = {c: i for i, c in enumerate(columns)}
        # The place of a column's ranks among the rows where another one is present.
        kind = {c: index.get(names[at[c]], -1) + 1 for c in columns}
        totals = _rank_totals(ranked, len(partners))
        small = _in_place(sizes, 24 + 8 * len(partners))
        found: dict[Pair, tuple[int, float | None]] = {}
        products: dict[Pair, float] = {}
        near, far, apart = [], {}, []
        for a, b in pairs:
            if at[a] not in totals or at[b] not in totals or totals[at[a]][kind[b]][0] < 2:
                found[(a, b)] = (totals[at[a]][kind[b]][0] if at[a] in totals else 0, None)
            elif at[a] in small and at[b] in small:
                near.append((a, b))
            elif at[a] in small or at[b] in small:
                far.setdefault(b if at[a] in small else a, []).append((a, b))
            else:
                apart.append((a, b))
        tables = df.sparkSession.sparkContext.broadcast(_rank_arrays(ranked, small, totals))

        def all_near() -> None:
            wanted = [(at[a], kind[b], at[b], kind[a]) for a, b in near]
            products.update(zip(near, rank_products(values, tables, wanted) if near else ()))

        def one_far(c: str) -> None:
            others = [b if a == c else a for a, b in far[c]]
            sums = rank_sums_by_value(values, tables, at[c], [(at[o], kind[c]) for o in others])
            mine = ranked.where(F.col("idx") == at[c])
            own = [F.col("rank" if not kind[o] else f"rank{kind[o] - 1}") - F.lit((rows + 1) / 2.0) for o in others]
            met = mine.join(sums, "value").agg(*[F.sum(r * F.col(f"s{k}")).alias(f"p{k}") for k, r in enumerate(own)])
            products.update(zip(far[c], met.first()))

        together(df.sparkSession, all_near, *[lambda c=c: one_far(c) for c in far])
        tables.unpersist()
        for (a, b), product in products.items():
            (n, of_a), (_, of_b) = totals[at[a]][kind[b]], totals[at[b]][kind[a]]
            r = _share(product or 0.0, math.sqrt(of_a) * math.sqrt(of_b))
            found[(a, b)] = (n, None if math.isnan(r) else max(-1.0, min(1.0, r)))
        found.update(_spearman_by_row(values, ranked, sizes, rows, index, at, apart))
        return [found[p] for p in pairs]


def _rank_totals(ranked: DataFrame, partners: int) -> dict[int, list[tuple[int, float]]]:
    """By column and kind of rank: how many rows have one, and the sum of squares around the mean."""
    kinds = ["", *range(partners)]
    sums = F.broadcast(ranked.groupBy(F.col("idx").alias("of")).agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in kinds]))
    gap = [F.col(f"rank{k}") - (F.col(f"t{k}") + 1) / F.lit(2.0) for k in kinds]
    spread = [F.coalesce(F.sum(F.col(f"n{k}") * g * g), F.lit(0.0)).alias(f"s{k}") for k, g in zip(kinds, gap)]
    found = ranked.join(sums, F.col("idx") == F.col("of")).groupBy("idx").agg(*[F.first(f"t{k}").alias(f"t{k}") for k in kinds], *spread)
    return {r["idx"]: [(r[f"t{k}"], r[f"s{k}"]) for k in kinds] for r in found.collect()}


def _in_place(sizes: dict[int, int], width: int) -> list[int]:
    """The columns with the fewest values, whose rank tables together fit a broadcast."""
    out, used = [], 0
    for i, n in sorted(sizes.items(), key=lambda item: (item[1], item[0])):
        used += n * width
        if used > BROADCAST_BYTES:
            break
        out.append(i)
    return out


def _rank_arrays(ranked: DataFrame, small: Sequence[int], totals: dict[int, list[tuple[int, float]]]) -> dict[int, tuple]:
    """(sorted values, centred ranks by kind) of columns whose tables fit a broadcast, by counted size."""
    found = ranked.where(F.col("idx").isin(list(small))).toArrow() if small else None
    out = {}
    for i in small:
        mine = found.filter(pc.equal(found["idx"], i)).sort_by("value")
        ranks = []
        for k, (n, _) in enumerate(totals[i]):
            own = mine["rank" if not k else f"rank{k - 1}"].to_numpy() - (n + 1) / 2.0
            # A value that no row of the partner has, and a missing one.
            ranks.append(np.append(np.nan_to_num(own), 0.0))
        out[i] = (mine["value"].to_numpy(), np.array(ranks))
    return out


def _spearman_by_row(values: DataFrame, ranked: DataFrame, sizes: dict[int, int], rows: int, index: dict[str, int], at: dict[str, int], pairs: Sequence[Pair]) -> dict[Pair, tuple[int, float | None]]:
    """(n, r) of pairs of columns whose rank tables are too large to be looked up in place."""
    if not pairs:
        return {}
    names = values.columns
    complete = {c for c in at if names[at[c]] not in index and at[c] in sizes}
    easy = [p for p in pairs if complete.issuperset(p)]
    hard = [p for p in pairs if not complete.issuperset(p)]
    used = sorted({at[c] for p in pairs for c in p})
    held_values = hold(values.select(*[names[i] for i in used], F.monotonically_increasing_id().alias("row")), "values")

    def rank(of: int, other: int) -> Column:
        j = index.get(names[other])
        # Where the partner is missing, it has no rank either.
        return F.col(f"r{of}") if j is None else F.when(F.col(f"r{other}").isNotNull(), F.col(f"r{of}_{j}"))

    centred = {c: F.col(f"r{at[c]}") - F.lit((rows + 1) / 2.0) for c in complete}
    constant = {c for c in complete if sizes[at[c]] == 1}
    found: dict[Pair, tuple[int, float | None]] = {}
    for out, whole, gapped in _ranks_by_row(held_values, ranked, sizes, rows, index, at, easy, hard):
        plain, rest = together(
            values.sparkSession,
            lambda out=out, whole=whole: _complete_pairs(out, centred, rows, constant, whole),
            lambda out=out, gapped=gapped: _pair_moments(out, [(rank(at[a], at[b]), rank(at[b], at[a])) for a, b in gapped]),
        )
        found.update(plain)
        found.update(zip(gapped, rest))
    return found


def _rank_name(of: int, kind: str) -> str:
    return f"r{of}{kind[4:] and '_' + kind[4:]}"


def _ranks_by_row(values: DataFrame, ranked: DataFrame, sizes: dict[int, int], rows: int, index: dict[str, int], at: dict[str, int], easy: list[Pair], hard: list[Pair]):
    """``(rows with ranks, complete pairs, pairs with gaps)``, some pairs at a time: all
    complete ones, then those between two groups of columns, so that a row is never
    wider than the ranks of RANKED_TOGETHER columns with each other."""
    groups = {c: i // RANKED_TOGETHER for c, i in at.items()}
    tasks: dict[tuple, list[Pair]] = {}
    for p in hard:
        tasks.setdefault(tuple(groups[c] for c in p), []).append(p)
    for whole, gapped in [(easy, []), *(([], part) for part in tasks.values())]:
        used = sorted({at[c] for p in (*whole, *gapped) for c in p})
        if not used:
            continue
        wanted = {f"v{at[c]}" for p in gapped for c in p} & set(index)
        kinds = ["rank", *[f"rank{index[c]}" for c in sorted(wanted)]]
        # No more than HOT_SHARE values of a column can hold 1/HOT_SHARE of the rows.
        keyed = ranked.where(F.col("idx").isin(used)).select(F.struct("idx", "value").alias("key"), "n", *kinds)
        heavy = keyed.where(F.col("n") >= F.lit(max(rows, 1)) / HOT_SHARE).select("key")
        narrow = tall(values, [[F.col("row"), F.lit(i), F.col(f"v{i}")] for i in used], ["row", "of", "value"]).where(F.col("value").isNotNull())
        narrow = narrow.select("row", F.col("of").alias("idx"), "value")
        width = sum(sizes.get(i, 0) for i in used) * (24 + 8 * len(kinds))
        met = lookup(narrow, F.struct("idx", "value"), keyed.drop("n"), "key", width, heavy)
        own = [F.max(F.when(F.col("idx") == i, F.col(k))).alias(_rank_name(i, k)) for i in used for k in kinds]
        # Rows of the block of pairs only; a row without any of its values takes no part.
        yield hold(met.groupBy("row").agg(*own), "row-ranks"), whole, gapped


def _pairs(df: DataFrame, method: str, columns: Sequence[str], pairs: Sequence[Pair]):
    if method not in METHODS:
        raise ValueError(f"Unknown correlation method {method!r}.")
    if not pairs:
        return []
    with small_methods(df.sparkSession):
        return (_pearson if method == "pearson" else _spearman)(df, columns, pairs)


def correlations(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """(rank, column_a, column_b, correlation, p_value, n), strongest pair first.

    Pairs with fewer than two complete rows or a constant side are left out.
    Pairs of equal strength keep the order of the columns.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    for c in columns:
        require_numeric(df, c)
    pairs = list(combinations(columns, 2))
    found = [
        (a, b, half_up(r, DIGITS), half_up(correlation_p_value(r, n, method), P_DIGITS), n)
        for (a, b), (n, r) in zip(pairs, _pairs(df, method, columns, pairs))
        if r is not None
    ]
    found.sort(key=lambda row: -abs(row[2]))  # stable: ties keep column order
    return df.sparkSession.createDataFrame(
        [(k, *row) for k, row in enumerate(found, 1)],
        "rank int, column_a string, column_b string, correlation double, p_value double, n bigint",
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long Pearson matrix (row, col, r) with diagonal, r unrounded.

    An undefined cell is NULL; fewer than two numeric columns is an error.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        raise ValueError("Need at least 2 numeric columns for a heat map.")
    pairs = list(combinations(columns, 2)) + [(c, c) for c in columns]
    found = {p: r for p, (_, r) in zip(pairs, _pairs(df, "pearson", columns, pairs))}
    rows = []
    for a in columns:
        for b in columns:
            r = found[(a, b)] if (a, b) in found else found[(b, a)]
            rows.append((a, b, 1.0 if a == b and r is not None else r))
    return df.sparkSession.createDataFrame(rows, "row string, col string, r double")


def linear_regression(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """One row: n, coefficient, intercept, r2_score, rmse of y = a + b x.

    Rows without x or y are ignored. A constant x has slope 0 and intercept
    mean(y); r2 is then 1 for a constant y and 0 otherwise.
    """
    require_numeric(df, x_col)
    require_numeric(df, y_col)
    x, y = F.col("x"), F.col("y")
    complete = complete_rows(df, x_col, y_col)
    both = complete.select(double(df, x_col).alias("x"), double(df, y_col).alias("y"))
    sums = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    explained = F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    fit = sums.select(
        F.when(F.col("n") < 2, F.raise_error(F.lit(TOO_FEW_ROWS)))
        .otherwise(F.col("n"))
        .alias("n"),
        slope.alias("coefficient"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.coalesce(F.try_divide(explained, F.col("syy")), F.lit(1.0)).alias("r2_score"),
        F.sqrt(F.greatest(F.col("syy") - explained, F.lit(0.0)) / F.col("n")).alias("rmse"),
    )
    return fit


def regression_report(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """The fit rounded to 4 digits with its interpretation."""
    fit = linear_regression(df, x_col, y_col)
    slope, r2 = F.col("coefficient"), F.col("r2_score")
    trend = F.when(slope > 0, "increases").otherwise("decreases")
    grade = F.when(r2 > STRONG_FIT, "strong").when(r2 > MODERATE_FIT, "moderate").otherwise("weak")
    text = F.format_string(
        FIT_SENTENCE,
        F.lit(x_col),
        F.lit(y_col),
        trend,
        F.abs(slope),
        r2 * 100,
        grade,
    )
    return fit.select(
        "n",
        *[F.round(c, DIGITS).alias(c) for c in ("r2_score", "coefficient", "intercept", "rmse")],
        text.alias("interpretation"),
    )
