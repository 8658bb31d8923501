"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.plans.held import drop_held, hold


def connected_components(links: DataFrame, label: str) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; the component is
    its smallest node.

    Alternating star contraction: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows, until nothing changes.
    Minima are pre-aggregated, and a node with very many links meets them in a
    join that adaptive execution can split. Each round is written to the shared
    folder, so lineage stays short. Missing ends and self-links are ignored; an
    empty table gives an empty table.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current, state = _round(pairs, label)
    while state[0]:
        wide, *used = _large_star(current, label)
        narrow, *more = _small_star(wide, label)
        made, new_state = _round(narrow, label)
        for table in (current, wide, *used, *more):
            drop_held(table)
        current = made
        if new_state == state:
            break
        state = new_state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _round(pairs: DataFrame, label: str):
    table = hold(pairs.distinct(), label)
    # A sum of 64-bit hashes as decimals: exact, the same in any order.
    row = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, (row[0], row[1])


# The smallest neighbours are written before they are joined: both sides then come
# from exchanges of their own, and the rows of a hub can be split.


def _large_star(pairs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = hold(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), label)
    made = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hold(made.distinct(), label), least


def _small_star(pairs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    least = hold(pairs.groupBy("u").agg(F.min("v").alias("m")), label)
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"), least
