"""Average ranks of column values, spread over range buckets.

Values are counted first, so ties and hot values are single rows. Distinct
values are then cut into range buckets; a value's rank is the total of the
buckets before it plus a running sum inside its bucket. The bucket follows from
the value alone, so recomputing a lost task cannot change it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.values import number
from tabsieve.operators.schema import require_numeric
from tabsieve.plans.held import hold
from tabsieve.plans.tall import tall

BUCKET_VALUES = 500_000
_SAMPLE_PER_BUCKET = 64


def count_values(df: DataFrame, columns: Sequence[str], partners: Sequence[str] = ()) -> DataFrame:
    """(idx, value, n, n0, n1, ...): rows per value, in all and where partner j is present."""
    for c in columns:
        require_numeric(df, c)
    seen = [number(df, p).isNotNull().cast("int") for p in partners]
    flags = [f"p{j}" for j in range(len(partners))]
    return (
        tall(df, [[number(df, c), *seen] for c in columns], ["value", *flags])
        .where(F.col("value").isNotNull())
        .groupBy("idx", "value")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"n{j}") for j, f in enumerate(flags)])
    )


def _splits(values: DataFrame, distinct: int, bucket_values: int) -> list[float]:
    """Cut points for buckets of about equal size, from a bounded hash sample.

    They steer the balance of the work only; any cut points give the same ranks.
    """
    buckets = -(-distinct // bucket_values)
    if buckets < 2:
        return []
    every = max(1, distinct // (buckets * _SAMPLE_PER_BUCKET))
    sample = values.where(F.pmod(F.xxhash64("value"), F.lit(every)) == 0)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sample.agg(F.percentile_approx("value", shares, buckets * 16)).first()[0]
    return sorted(set(cuts or []))


def average_ranks(
    counts: DataFrame, distinct: dict[int, int], n_partners: int = 0, bucket_values: int = BUCKET_VALUES
) -> DataFrame:
    """(idx, value, n, n0, ..., rank, rank0, ...) from a held ``count_values`` table.

    ``rank`` is the average 1-based rank over all rows of the column, ``rankJ``
    the one among the rows where partner j is present. No values, no ranks.
    """
    weights = ["n"] + [f"n{j}" for j in range(n_partners)]
    if not distinct:
        none = F.lit(None).cast("double")
        return counts.select("idx", "value", *weights, *[none.alias(f"rank{j}") for j in ("", *range(n_partners))])
    small = [i for i, d in distinct.items() if d <= bucket_values]
    pieces = []
    if small:
        pieces.append(counts.where(F.col("idx").isin(small)).withColumn("bucket", F.lit(0.0)))
    for i in distinct:
        if i in small:
            continue
        mine = counts.where(F.col("idx") == i)
        cuts = _splits(mine, distinct[i], bucket_values)
        edges = [-float("inf"), *cuts, float("inf")]
        pieces.append(
            Bucketizer(splits=edges, inputCol="value", outputCol="bucket").transform(mine)
            if cuts
            else mine.withColumn("bucket", F.lit(0.0))
        )
    cells = reduce(DataFrame.unionByName, pieces)

    inside = Window.partitionBy("idx", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"before_{w}") for w in weights]
    )
    if len(small) < len(distinct):
        earlier = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = cells.groupBy("idx", "bucket").agg(*[F.sum(w).alias(w) for w in weights])
        offsets = totals.select(
            "idx", "bucket", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"offset_{w}") for w in weights]
        )
        # The windows left the rows by (idx, bucket): only the few offsets move.
        ranked = ranked.join(offsets, ["idx", "bucket"])
    else:
        ranked = ranked.select("*", *[F.lit(0).cast("long").alias(f"offset_{w}") for w in weights])

    def rank(w: str) -> Column:
        middle = F.col(f"offset_{w}") + F.col(f"before_{w}") + (F.col(w) + 1) / F.lit(2.0)
        return F.when(F.col(w) > 0, middle)

    return ranked.select(
        "idx", "value", *weights, *[rank(w).alias("rank" + w[1:]) for w in weights]
    )


def distinct_sizes(counts: DataFrame) -> dict[int, int]:
    """Distinct values per column index of a ``count_values`` table."""
    return {r["idx"]: r["d"] for r in counts.groupBy("idx").agg(F.count(F.lit(1)).alias("d")).collect()}


def rank_table(df: DataFrame, column: str, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """(value, n, rank): average rank of every distinct value of one column."""
    counts = hold(count_values(df, [column]), "counts")
    return average_ranks(counts, distinct_sizes(counts), 0, bucket_values).select("value", "n", "rank")
