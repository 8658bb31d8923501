"""Approximate profiles from sketches that are stored and merged.

Each input file has one row for each column in a store: exact counts and range, a
distinct-count sketch and a quantile sketch. A new delivery is scanned once, by itself; a
profile of everything is a merge of small rows and reads no data. This is an option
beside the exact statistics, never in their place.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.functions.values import col, number, present
from tabsieve.operators.schema import is_nested, is_numeric

# Sizes of the sketches, and by how much their answers may be off: the part of a distinct count
# (three standard errors of 1.04 / 2 ** (LG_K / 2)), and the part of the rows by which a rank may be.
LG_K, QUANTILE_K = 12, 1024
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 3.5 / QUANTILE_K**0.9
PROBABILITIES = (0.25, 0.5, 0.75)
_FILE = ["file", "modified"]


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_nested(f)]


def sketch_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(file, modified, column, n, nulls, low, high, distinct, quantiles)`` of each file behind ``df``.

    ``low``, ``high`` and ``quantiles`` are NULL for columns that are not numeric. One scan; a
    task sends one row of sketches for each file it has read a part of.
    """
    names = _plain_columns(df) if columns is None else list(columns)
    figures: list[Column] = []
    for i, c in enumerate(names):
        value = present(df, c)
        # Equal zeros have equal hashes. Missing values have none.
        plain = value + F.lit(0.0) if df.schema[c].dataType.typeName() in ("float", "double") else value
        figures += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNull()).alias(f"nulls{i}"),
            F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(plain)), LG_K).alias(f"distinct{i}"),
        ]
        if is_numeric(df.schema[c]):
            x = number(df, c)
            figures += [F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias(f"quantiles{i}")]
        else:
            none = F.first(F.lit(None).cast("double"))
            figures += [none.alias(f"low{i}"), none.alias(f"high{i}"), F.first(F.lit(None).cast("binary")).alias(f"quantiles{i}")]
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), *[col(c) for c in names])
    wide = rows.groupBy(*_FILE).agg(*figures)
    kinds = ("n", "nulls", "low", "high", "distinct", "quantiles")
    parts = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in kinds]) for i, c in enumerate(names)])
    return wide.select(*_FILE, F.inline(parts))


def update_store(spark: SparkSession, path: str, store: str, fmt: str = "parquet") -> int:
    """Adds the sketches of those files below ``path`` that the store does not know, or knows
    in an older state; the number of files that were read."""
    df = spark.read.format(fmt).load(path)
    # The files of the folder, those without rows among them; their content is not read.
    names = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    files = spark.read.format("binaryFile").load(path).select(*names)
    known = stored(spark, store)
    new = files if known is None else files.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
    # As many paths as a listing of the folder brings to the driver.
    listed = new.collect()
    if listed:
        # Names of files are given as URIs; a plus sign stands for itself there.
        paths = [unquote(r["file"]) for r in listed]
        found = sketch_columns(spark.read.schema(df.schema).format(fmt).load(paths))
        kinds = spark.createDataFrame([(c,) for c in _plain_columns(df)], "column string")
        every = spark.createDataFrame(listed, new.schema).crossJoin(F.broadcast(kinds))
        # A file without rows is known by counts of 0 and no sketches.
        every.join(found, [*_FILE, "column"], "left").fillna(0, ["n", "nulls"]).write.mode("append").parquet(store)
    return len(listed)


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of a store, of each file those of its last state; None where there is no store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    last = Window.partitionBy("file")
    rows = spark.read.parquet(store).withColumn("last", F.max("modified").over(last))
    return rows.where(F.col("modified") == F.col("last")).drop("last")


def approx_profile(sketches: DataFrame) -> DataFrame:
    """``(column, n, nulls, distinct, low, high, p25, median, p75)`` of all files together.

    Counts and range are exact, ``distinct`` is off by less than DISTINCT_ERROR of itself and the
    quartiles by less than RANK_ERROR of the rows with a probability of about 0.99.
    """
    merged = sketches.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        # Sketches of nothing have no quantiles.
        F.kll_merge_agg_double(F.when(F.col("low").isNotNull(), F.col("quantiles"))).alias("sketch"),
    )
    shares = F.array(*[F.lit(p) for p in PROBABILITIES])
    quartiles = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("sketch", shares))
    named = [F.get(quartiles, F.lit(i)).alias(name) for i, name in enumerate(("p25", "median", "p75"))]
    return merged.select("column", "n", "nulls", "distinct", "low", "high", *named)
