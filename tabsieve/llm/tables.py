"""Small pieces that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.plans.held import hold, new_folder

#: The six characters of [\x20\x09-\x0D]. Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a longest run without them.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns what the process has freed to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` for tasks whose Python workers serve later stages: they do not keep what it took."""

    def whole(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], label: str) -> DataFrame:
    """Adds, for each total, its running sum over all rows in the given order.

    Rows are dealt to blocks by ranges of the order columns, so equal leading
    keys may spread over many blocks. The only window that is not
    split has one row for each block. The blocks are written once: their
    numbers are then facts of a table and not of a particular run.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_parts(spark), *order)
    for name, value in totals.items():
        ranged = ranged.withColumn(name, value)
    ranged = hold(ranged.withColumn("__block", F.spark_partition_id()), label)

    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy("__block").agg(*[F.sum(n).alias(n) for n in totals])
    blocks = blocks.select("__block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in totals])
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each block: bounded by the number of shuffle partitions.
    out = ranged.join(F.broadcast(blocks), "__block")
    return out.select(
        *df.columns, *[(F.col(f"__before_{n}") + F.sum(n).over(inside)).alias(n) for n in totals]
    )


def join_with_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL, which equals NULL; keeps the left keys."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def publish(spark: SparkSession, label: str, data: bytes) -> str:
    """Writes a file of bounded size to the shared folder and hands it to all
    executors, later ones too; tasks find it by its name with ``SparkFiles.get``."""
    folder = new_folder(spark, label)
    name = folder.rsplit("/", 1)[1]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def least_count(counts: DataFrame, limit: int) -> int | None:
    """The count from which on the words of ``(word, n)`` are at most ``limit``, by whole steps
    of the count; None if those of the highest step are more."""
    # Counts in steps of an eighth of their highest power of two: some 500 rows.
    power = F.pow(2.0, F.floor(F.log2(F.col("n").cast("double"))))
    step = F.floor(F.floor(F.col("n") / power * 8) * power / 8).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.col("step").desc()).collect()
    least, total = None, 0
    for row in steps:
        total += row.words
        if total > limit:
            break
        least = row.step
    return least


def most_frequent(counts: DataFrame, limit: int) -> list:
    """The words of the highest counts in ``(word, n)``, as many whole steps of the count as fit
    into the limit: at most ``limit`` words come to the driver."""
    least = least_count(counts, limit)
    if least is None:
        return []
    return [r.word for r in counts.where(F.col("n") >= least).select("word").collect()]
