"""Wide rows turned into one row per column, inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# More rows per input row than this would outgrow one generated method.
ROWS_PER_EXPAND = 64


def tall(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """(idx, *names): each input row gives one output row per entry of ``rows``.

    ``rows[i]`` are the expressions of the output row with idx i; entries of the
    same position share a type. The plan is one scan: an Expand for up to
    ROWS_PER_EXPAND entries, exploded arrays of them for more; nothing is shuffled.
    """
    if len(rows) > ROWS_PER_EXPAND:
        arrays = [F.array(*[r[j] for r in rows]).alias(f"a{j}") for j in range(len(names))]
        # Constant places, so that no filter repeats the arrays below the explode.
        part = df.select(*arrays).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("idx"))
        return part.select("idx", *[F.get(f"a{j}", F.col("idx")).alias(n) for j, n in enumerate(names)])
    numbers = range(len(rows))
    wide = [F.lit(i).alias(f"i{i}") for i in numbers]
    wide += [c.alias(f"c{i}_{j}") for i in numbers for j, c in enumerate(rows[i])]
    parts = [
        "(" + ", ".join([f"i{i}", *[f"c{i}_{j}" for j in range(len(names))]]) + f") AS `{i}`" for i in numbers
    ]
    shape = ", ".join(["idx", *names])
    return df.sparkSession.sql(
        f"SELECT {shape} FROM {{wide}} UNPIVOT INCLUDE NULLS (({shape}) FOR part IN ({', '.join(parts)}))",
        wide=df.select(*wide),
    )
