"""Records of text files that go over line ends, cut by many tasks.

A line of a CSV file is a function of one bit: whether it begins inside of a quoted cell
decides whether it ends inside of one. Most lines, those without a quote, leave
the bit alone. The functions of a block's lines are composed in the order of the lines, and
those of the blocks in the order of the file; then every line knows how it begins. Only
the lines of records that have several are brought together.

A JSON array goes by pieces that end in a closing brace, so that one on a single line is
split too. Quotes turn the bit, whatever it is; the depth of brackets is summed up for both
values of it, and the one that holds is chosen once the blocks before are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.plans.held import hold

# A quoted cell with all its quotes, and one that its line leaves open.
CLOSED_CELL = r'(^|,)"([^"]|"")*"(?=,|$)'
OPEN_CELL = r'(^|,)"'
# The rest of a quoted cell up to its closing quote.
REST_OF_CELL = r'^([^"]|"")*+"(?=,|\r?$)'


def ends_open(line: Column) -> Column:
    """Whether a quoted cell goes on after a line that begins outside of one."""
    bare = F.regexp_replace(line, r"\r$", "")
    return F.regexp_replace(bare, CLOSED_CELL, "$1").rlike(OPEN_CELL)


def stays_open(line: Column) -> Column:
    """Whether a quoted cell goes on after a line that begins inside of one."""
    closes = line.rlike(REST_OF_CELL)
    # What follows the closing quote begins like a line.
    return F.when(closes, ends_open(F.regexp_replace(line, REST_OF_CELL, ""))).otherwise(True)


def text_lines(spark: SparkSession, path: str | list[str], end: str = "\n") -> DataFrame:
    """``(file, block, place, line)``: lines by their ends, in the order of ``place`` within a
    block of a file, which one task reads from its start."""
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )


def _composed(inside: Column, first: Column, second: Column) -> Column:
    return F.when(inside, second).otherwise(first)


def csv_records(lines: DataFrame) -> DataFrame:
    """``record``: each record but the first of its file, the header, as one text.

    Lines move once, by their block; of each block one row goes to the window that
    orders the blocks of a file. Blank lines between records are left out.
    """
    block = Window.partitionBy("file", "block").orderBy("place")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quoted = F.contains("line", F.lit('"'))
    # What a line makes of the bit, where it begins outside and inside.
    rows = lines.withColumn("a", F.when(quoted, ends_open(F.col("line"))).otherwise(False)).withColumn(
        "b", F.when(quoted, stays_open(F.col("line"))).otherwise(True)
    )
    # A line that makes the bit what it makes of both sets it; lines that keep it are left
    # alone; the others turn it. After the last one that sets it, turns are counted.
    sets, turns = F.col("a") == F.col("b"), (F.col("a") & ~F.col("b")).cast("int")
    rows = rows.withColumn("last", F.last(F.when(sets, F.struct("place", F.col("a").alias("to"))), True).over(upto))
    rows = rows.withColumn("turned", F.sum(turns).over(upto))
    rows = rows.withColumn("set_turned", F.max(F.when(sets, F.col("turned"))).over(upto))
    odd = F.pmod(F.col("turned") - F.coalesce("set_turned", F.lit(0)), F.lit(2)) == 1
    start = F.coalesce(F.col("last.to"), F.lit(False))
    # The bit after the line if the block begins outside, and if it begins inside.
    rows = rows.withColumn("after0", start != odd).withColumn("after1", F.coalesce(F.col("last.to"), F.lit(True)) != odd)

    blocks = rows.groupBy("file", "block").agg(F.max_by("after0", "place").alias("a"), F.max_by("after1", "place").alias("b"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("a") == F.col("b"), (F.col("a") & ~F.col("b")).cast("int")
    blocks = blocks.withColumns({"set_to": F.when(sets, F.col("a")), "turn": turns})
    blocks = blocks.withColumn("turned", F.coalesce(F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    blocks = blocks.withColumn("to", F.last("set_to", True).over(before))
    blocks = blocks.withColumn("from", F.coalesce(F.max(F.when(F.col("set_to").isNotNull(), F.col("turned"))).over(before), F.lit(0)))
    previous = F.coalesce(F.lag("turned").over(order), F.lit(0))
    begins = F.coalesce(F.col("to"), F.lit(False)) != (F.pmod(previous - F.col("from"), F.lit(2)) == 1)
    blocks = blocks.select("file", "block", begins.alias("inside"))

    known = rows.select("file", "block", "place", "line", "after0", "after1").join(blocks, ["file", "block"])
    known = known.withColumn("after", _composed(F.col("inside"), F.col("after0"), F.col("after1")))
    known = known.withColumn("begun", F.coalesce(F.lag("after").over(block), F.col("inside")))
    # A record's number in its block; lines before the first record go on with one of an earlier block.
    number = F.sum(F.when(F.col("begun"), 0).otherwise(1)).over(upto)
    filled = ~F.col("begun") & (F.trim(F.regexp_replace("line", r"\r$", "")) != "")
    head = (F.col("block") == 0) & (F.col("place") == F.min(F.when(filled, F.col("place"))).over(Window.partitionBy("file", "block")))
    known = known.select("file", "block", "place", "line", "begun", "after", number.alias("number"), filled.alias("filled"), head.alias("head"))
    whole = known.where("filled AND NOT after AND NOT head").select(F.col("line").alias("record"))
    # A record ends outside of quotes: a carriage return there belongs to the line end.
    parts = known.where("begun OR after")
    # The last record of each block that has one, by the blocks that follow it.
    last = known.groupBy("file", "block").agg(F.max("number").alias("own"))
    at = F.when(F.col("own") > 0, F.struct("block", F.col("own").alias("number")))
    carried = last.select("file", F.col("block").alias("here"), F.last(at, True).over(before).alias("carried"))
    parts = parts.join(carried.withColumnRenamed("here", "block"), ["file", "block"])
    own = F.when(F.col("number") > 0, F.struct("block", "number")).otherwise(F.coalesce("carried", F.struct("block", "number")))
    pieces = F.sort_array(F.collect_list(F.struct("block", "place", "line")))
    joined = parts.groupBy("file", own.alias("record_at")).agg(pieces.alias("pieces"), F.bool_or("head").alias("head")).where("NOT head")
    records = whole.unionByName(joined.select(F.array_join(F.transform("pieces", lambda p: p["line"]), "\n").alias("record")))
    return records.select(F.regexp_replace("record", r"\r\z", "").alias("record"))


def json_records(pieces: DataFrame) -> DataFrame:
    """``(file, block, number, record)``: each element of the arrays, in this order in its file.

    ``pieces`` are ``text_lines`` that end in closing braces, and elements are objects. Pieces
    move once, by their block. What no element can be, such as an end that is cut
    off, is a record that no parser takes. The caller drops the held table behind it.
    """
    block = Window.partitionBy("file", "block").orderBy("place")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = F.regexp_replace("line", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'

    def change(outside: Column, ends_outside: Column) -> Column:
        opened = F.regexp_count(outside, F.lit(r"[{\[]")) - F.regexp_count(outside, F.lit(r"\]"))
        return opened - ends_outside.cast("int")

    rows = pieces.withColumns({"bare": bare, "odd": F.pmod(F.regexp_count(bare, F.lit('"')), F.lit(2))})
    # What a piece, with the brace after it, does to the depth if it begins outside of a text, and inside.
    inside = F.regexp_replace(F.regexp_replace("bare", r'\A[^"]*("|\z)', ""), strings, "")
    rows = rows.withColumn("d0", change(F.regexp_replace("bare", strings, ""), F.col("odd") == 0))
    rows = rows.withColumn("d1", change(inside, F.col("odd") == 1)).drop("bare")
    # The same by the bit at the beginning of the block.
    rows = rows.withColumn("turned", F.sum("odd").over(upto))
    alike = F.pmod(F.col("turned") - F.col("odd"), F.lit(2)) == 0
    rows = rows.withColumns({"c0": F.when(alike, F.col("d0")).otherwise(F.col("d1")), "c1": F.when(alike, F.col("d1")).otherwise(F.col("d0"))})
    rows = rows.withColumns({"run0": F.sum("c0").over(upto), "run1": F.sum("c1").over(upto)})

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    blocks = blocks.withColumn("bit", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    depth = F.sum(F.when(F.col("bit") == 0, F.col("c0")).otherwise(F.col("c1"))).over(before)
    blocks = blocks.select("file", "block", "bit", F.coalesce(depth, F.lit(0)).alias("depth"))

    known = rows.select("file", "block", "place", "line", "turned", "run0", "run1").join(blocks, ["file", "block"])
    depth = F.col("depth") + F.when(F.col("bit") == 0, F.col("run0")).otherwise(F.col("run1"))
    known = known.withColumn("ends", (F.pmod(F.col("bit") + F.col("turned"), F.lit(2)) == 0) & (depth == 1))
    known = known.withColumn("number", F.sum(F.col("ends").cast("int")).over(upto) - F.col("ends").cast("int"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda p: p["line"])
    cut = known.groupBy("file", "block", "number").agg(F.array_join(in_order, "}").alias("text"), F.bool_or("ends").alias("ended"))
    cut = hold(cut, "cut")

    ends = cut.groupBy("file", "block").agg(F.count_if("ended").alias("ends"))
    ends = ends.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("earlier"))
    whole = F.col("ended") & ((F.col("number") > 0) | (F.col("block") == 0))
    # Only what goes over the end of a block moves again, by its number in the file.
    parts = cut.where(~whole).join(ends, ["file", "block"]).withColumn("at", F.col("earlier") + F.col("number"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("block", "number", "text"))), lambda p: p["text"])
    first = F.min(F.struct("block", "number"))
    joined = parts.groupBy("file", "at").agg(first.alias("first"), F.array_join(in_order, "}").alias("text"), F.bool_or("ended").alias("ended"))
    found = cut.where(whole).select("file", "block", "number", "text", "ended").unionByName(
        joined.select("file", "first.block", "first.number", "text", "ended")
    )
    endless = found.groupBy("file").agg(F.bool_and("ended").alias("endless")).where("endless")
    # The end of a file: nothing but the end of the array, which may be empty.
    found = found.where(F.col("ended") | ~F.col("text").rlike(r"\A\s*(\ufeff?\s*\[\s*)?\]\s*\z"))
    lead = F.when((F.col("block") == 0) & (F.col("number") == 0), F.lit(r"\A\ufeff?\s*\[")).otherwise(F.lit(r"\A\s*,"))
    text = F.concat(F.regexp_replace("text", lead, F.lit("")), F.when(F.col("ended"), "}").otherwise(""))
    proper = F.col("ended") & F.regexp_like("text", lead)
    found = found.select("file", "block", "number", F.when(proper, text).otherwise(F.concat(F.lit("!"), text)).alias("record"))
    return found.unionByName(endless.select("file", F.lit(-1).alias("block"), F.lit(0).alias("number"), F.lit("!").alias("record")))
