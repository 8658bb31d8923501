"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and 2 that give each source its target
number of tokens, the ones nearest to 1 in relative entropy are
``min(2, exp(tilt * size / mean size))``. The tilt of each source is the zero of
the derivative of a convex dual; Newton steps for all sources run side by
side, each step one aggregation over the counted sizes. Rates are then rounded
into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm.tables import WORD, join_with_nulls, running_totals, whole_text
from tabsieve.plans.held import drop_held, hold

#: Weights of the sources in order of their names, repeating, and the share of
#: all tokens that the mix takes. Fixed values.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No document is taken more often than this.
MOST_COPIES = 2
#: A source's tokens may miss their target by this part before rounding.
PRECISION = 1e-9
MAX_STEPS = 60
#: Rates are rounded to one part in UNIT, so that their sums are exact.
UNIT = 1_000_000
#: Starting points of the rounding that are compared.
OFFSETS = 32


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Shares by weight are cut at MOST_COPIES times the source; what is cut goes
    to the others by weight until none is above. In order of limit over weight,
    the sources that are cut come first, so one pass of running sums finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place.cast("int") + 1)
    limits = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST_COPIES)).alias("cap"))
    whole = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weights = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = limits.withColumn("level", left / weights).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    # The first source that is not cut has the level of all that are not cut.
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * common["level"]).alias("target"))


def _rate(tilt: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(tilt * F.col("size") / F.col("mean"), F.lit(1.0))))


def fit_tilts(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, mean, tilt)`` by Newton steps on the dual of each source.

    ``counted`` has ``(source, size, n)``. A step that leaves the interval known
    to hold the zero is replaced by its middle. A source whose target is all it
    may give has no finite tilt: NULL, every rate is the limit. So
    has one without tokens.
    """
    mean = counted.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(MOST_COPIES) * (1 - 1e-12))
    state = join_with_nulls(targets, mean, ["source"]).select(
        "source",
        "target",
        "mean",
        F.when(open_, F.lit(0.0)).alias("tilt"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        F.lit(float("inf")).alias("miss"),
    )
    state = hold(state, "tilts")
    for _ in range(MAX_STEPS):
        worst = state.where("tilt IS NOT NULL").agg(F.max("miss")).first()[0]
        if worst is None or worst <= PRECISION:
            return state.select("source", "mean", "tilt")
        made = hold(_newton(counted, state), "tilts")
        drop_held(state)
        state = made
    raise ValueError(f"tilts did not settle in {MAX_STEPS} steps: {worst}")


def _newton(counted: DataFrame, state: DataFrame) -> DataFrame:
    """One step on the logarithm of the tokens, which is nearly linear in the tilt."""
    now = join_with_nulls(counted, state.where(f"tilt IS NOT NULL AND miss > {PRECISION}"), ["source"])
    rate, tokens = _rate(F.col("tilt")), F.col("size") * F.col("n")
    # Beyond the limit a rate no longer moves.
    moves = F.when(rate < MOST_COPIES, tokens * rate * F.col("size") / F.col("mean")).otherwise(0.0)
    sums = now.groupBy("source").agg(F.sum(tokens * rate).alias("taken"), F.sum(moves).alias("slope"))
    return _stepped(join_with_nulls(state, sums, ["source"], "left"))


def _stepped(found: DataFrame) -> DataFrame:
    miss = F.abs(F.col("taken") / F.col("target") - 1)
    over = F.col("taken") > F.col("target")
    found = found.withColumn("low", F.when(over, F.col("low")).otherwise(F.greatest("low", "tilt")))
    found = found.withColumn("high", F.when(over, F.least("high", "tilt")).otherwise(F.col("high")))
    step = F.col("tilt") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope")
    unbounded = F.col("low").isin(float("-inf")) | F.col("high").isin(float("inf"))
    middle = F.when(unbounded, F.when(over, F.col("tilt") * 2 - 1).otherwise(F.col("tilt") * 2 + 1)).otherwise(
        (F.col("low") + F.col("high")) / 2
    )
    inside = (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("tilt")) <= F.abs(F.col("tilt")) * 2 + 2)
    moved = F.when(F.coalesce(inside, F.lit(False)), step).otherwise(middle)
    settled = F.col("taken").isNull()
    return found.select(
        "source",
        "target",
        "mean",
        F.when(settled | (miss <= PRECISION), F.col("tilt")).otherwise(moved).alias("tilt"),
        "low",
        "high",
        F.when(settled, F.col("miss")).otherwise(miss).alias("miss"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, source, size, source_size, target, copies, taken, rate)``
    for each row.

    Rates are summed along each source in order of size; a document group gets
    as many copies as whole numbers lie in its stretch of the sum, so
    that a source misses its target by about one document at most. A missing text
    has no tokens; a missing source is a source, the last. Rows that are alike in
    id, source and size are interchangeable. An empty table gives none.
    """
    text = whole_text()
    rows = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    rows = hold(rows.withColumn("mixed", F.xxhash64("doc_id", "text_hash")), "rows")
    numbered = hold(running_totals(rows, ["source", "size", "mixed", "doc_id", "text_hash"], {"place": F.lit(1).cast("long")}, "sizes"), "places")
    counted = hold(numbered.groupBy("source", "size").agg(F.count("*").alias("n"), F.min("place").alias("first")), "counted")
    targets = hold(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    tilts = fit_tilts(counted, targets)

    known = join_with_nulls(join_with_nulls(counted, targets, ["source"]), tilts, ["source"])
    # Ten digits of a tilt do not depend on the order of a sum.
    tilt = F.round("tilt", 10)
    limit = F.when(F.col("target") > 0, F.lit(float(MOST_COPIES))).otherwise(0.0)
    rate = F.round(F.coalesce(_rate(tilt), limit) * UNIT).cast("long")
    # One row for each size that a source has.
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("rate", rate).withColumn("upto", F.sum(F.col("rate") * F.col("n")).over(along))
    known = hold(known.select("source", "size", "n", "first", "source_size", "target", "rate", "upto"), "rates")
    offsets = F.explode(F.expr(f"transform(sequence(0, {OFFSETS - 1}), k -> CAST((2 * k + 1) * {UNIT} DIV {2 * OFFSETS} AS BIGINT))"))
    off = known.select("source", "size", "n", "target", "rate", "upto", offsets.alias("offset"))
    off = off.groupBy("source", "offset").agg(F.abs(F.sum(_copies(F.col("offset")) * F.col("size")) - F.first("target")).alias("off"))
    best = off.groupBy("source").agg(F.min(F.struct("off", "offset"))["offset"].alias("offset"))
    known = join_with_nulls(known, best, ["source"])
    known = known.select("source", "size", "n", "first", "source_size", "target", "rate", _copies(F.col("offset")).alias("all"))

    out = join_with_nulls(numbered, known, ["source", "size"])
    copies = _dealt("place - first + 1") - _dealt("place - first")
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), (F.col("rate") / UNIT).alias("rate")
    )


def _dealt(rows: str) -> Column:
    """Copies that the first rows of a group get; the product may pass 64 bits."""
    return F.expr(f"CAST({rows} AS DECIMAL(19, 0)) * CAST(`all` AS DECIMAL(19, 0)) DIV n")


def _copies(offset: Column) -> Column:
    """Whole numbers in the stretch of the running rate, moved by an offset."""
    end, start = F.col("upto") + offset, F.col("upto") + offset - F.col("rate") * F.col("n")
    whole = lambda x: F.call_function("div", x, F.lit(UNIT))
    return whole(end) - whole(start)
