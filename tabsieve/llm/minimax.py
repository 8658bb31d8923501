"""Shards of nearly equal bytes whose groups of equal texts stay together.

Groups are put in order (smallest doc_id, then digest) and cut into contiguous
runs. The smallest capacity for which a greedy filling needs no more than
the given shards is found by search; the cuts of that filling are the shards.
Only DataFrame expressions: no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import running_totals, whole_text
from tabsieve.plans.held import hold

#: Capacities tried in one round of the search.
TRIES = 32


def text_rows(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def _fill(ends: DataFrame, largest: int, capacities: list[int], shards: int) -> list[list[int]]:
    """Greedy cuts for each capacity; ``ends`` has the running end of each group.

    A cut lies within one largest group below its limit, so each step reads
    only that stretch of the table, which is stored in order of the ends.
    """
    cuts: list[list[int]] = [[0] for _ in capacities]
    total = ends.agg(F.max("end")).first()[0] or 0
    for _ in range(shards):
        limits = [min(c[-1] + size, total) for c, size in zip(cuts, capacities, strict=True)]
        near = ends.where((F.col("end") > min(limits) - largest - 1) & (F.col("end") <= max(limits)))
        row = near.agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"c{k}") for k, x in enumerate(limits)]).first()
        for k, cut in enumerate(cuts):
            # No group ends in between: it is larger than the capacity.
            cut.append(max(cut[-1], row[k] or 0))
    return [c[1:] for c in cuts]


def smallest_capacity(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """``(capacity, cuts)`` for groups ``(end, size)`` in order of ``end``."""
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    low = max(-(-total // shards), largest)
    # A shard is closed early by less than one largest group.
    high = low + largest
    cuts = _fill(ends, largest, [low], shards)[0]
    if cuts[-1] == total:
        return low, cuts
    best = _fill(ends, largest, [high], shards)[0]
    while high - low > 1:
        tries = sorted({low + (high - low) * k // (TRIES + 1) for k in range(1, TRIES + 1)} - {low, high})
        for size, cut in zip(tries, _fill(ends, largest, tries, shards), strict=True):
            if cut[-1] == total:
                high, best = size, cut
                break
            low = size
    return high, best


def balanced_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row of ``docs``.

    A row counts its UTF-8 bytes plus 1; a missing text is an empty one. Slots
    number the rows of a shard from 0 in the order of the groups, then by id.
    Rows that are alike in all that counts are interchangeable. Shards may be
    empty when groups are few; an empty table gives none.
    """
    rows = hold(text_rows(docs), "texts")
    # Written, so that the join can split a text with very many copies.
    first = hold(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "groups")
    rows = rows.join(first, "digest")
    numbered = hold(
        running_totals(
            rows,
            ["first_id", "digest", "doc_id"],
            {"end": F.col("size"), "place": F.lit(1).cast("long")},
            "blocks",
        ),
        "order",
    )
    ends = numbered.groupBy("digest").agg(F.max("end").alias("end"), F.sum("size").alias("size")).select("end", "size")
    ends = hold(ends.repartitionByRange("end").sortWithinPartitions("end"), "ends")
    _, cuts = smallest_capacity(ends, shards)

    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("end") > cut).cast("int")
    placed = numbered.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    # One row for each shard.
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot")
    )
