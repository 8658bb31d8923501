"""Left lookup of a unique-key table that does not suffer from hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.values import col
from tabsieve.operators.schema import is_nested

# A key is hot when it holds at least 1/HOT_SHARE of the weight, so there are
# at most HOT_SHARE hot keys whatever the size of the tables.
HOT_SHARE = 1000
# Sides of at most this size, as measured by the caller, are broadcast whole.
BROADCAST_BYTES = 64 << 20
# Lists of short keys are broadcast up to this length.
BROADCAST_ROWS = 200_000
_SPREAD = 1024
# Pieces of a hot key.
_HOT_SALTS = 64


def measured_bytes(df: DataFrame) -> int:
    """Size of a table of texts and numbers, by one aggregate over it."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        size = F.coalesce(F.octet_length(col(name)), F.lit(0)) if kind == "string" else F.lit(0)
        width = width + size + 16
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def lookup(
    left: DataFrame,
    key: Column,
    right: DataFrame,
    right_key: str,
    right_bytes: int,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left outer join of ``left`` with the columns of ``right`` on ``key``.

    ``right`` has one row per ``right_key``; its caller has counted its rows and
    knows its size. A small right side is broadcast. Otherwise both go through a
    shuffle join: rows of the keys in ``hot`` (the at most HOT_SHARE heaviest
    ones of ``right``) are spread by a salt, and so are rows without a key. Of
    the hot keys, only an 8-byte hash is broadcast.
    """
    names = [c for c in right.columns if c != right_key]
    if right_bytes <= BROADCAST_BYTES:
        side = F.broadcast(right.withColumnRenamed(right_key, "__key"))
        return left.join(side, key == F.col("__key"), "left").drop("__key")

    out = left.withColumn("__k", key)
    side = right.select(F.col(right_key).alias("__rk"), *[F.col(c).alias(f"__new_{c}") for c in names])
    out, side = out.withColumn("__h", F.xxhash64("__k")), side.withColumn("__h", F.xxhash64("__rk"))
    if hot is not None:
        # A key that shares its hash with a hot one is split as well: no harm.
        marked = F.broadcast(hot.select(F.xxhash64(right_key).alias("__h")).distinct().withColumn("__hot", F.lit(True)))
        out, side = out.join(marked, "__h", "left"), side.join(marked, "__h", "left")
    else:
        out, side = out.withColumn("__hot", F.lit(False)), side.withColumn("__hot", F.lit(False))
    # Same row, same partition: same salt, so a retried task sends rows the same way.
    plain = [col(f.name) for f in left.schema.fields if not is_nested(f)]
    row = F.xxhash64(*plain)
    lone = 1 + F.pmod(row % _SPREAD + F.spark_partition_id(), F.lit(_SPREAD))
    hot_salt = F.pmod(row + F.spark_partition_id(), F.lit(_HOT_SALTS))
    salt = F.when(F.col("__k").isNull(), lone).when(F.col("__hot"), hot_salt).otherwise(F.lit(0))
    out = out.withColumn("__salt", salt.cast("long"))
    # A constant would be taken out of the join keys, and rows without a key would
    # meet in one partition.
    zero = F.pmod(F.col("__h"), F.lit(1)).cast("long")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(_HOT_SALTS - 1)).cast("array<bigint>")).otherwise(F.array(zero))
    side = side.withColumn("__rsalt", F.explode(salts)).drop("__h", "__hot")
    out = out.join(side, (F.col("__k") == F.col("__rk")) & (F.col("__salt") == F.col("__rsalt")), "left")
    return out.select(*[col(c) for c in left.columns], *[F.col(f"__new_{c}").alias(c) for c in names])
