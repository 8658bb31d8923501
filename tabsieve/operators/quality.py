"""Data-quality detectors: duplicates, missing values, outliers, text variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import col, finite_columns, number, present, text_id, text_key
from tabsieve.operators.frequency import distinct_and_mode
from tabsieve.operators.quantiles import Extent, exact_quantiles, extents
from tabsieve.operators.schema import (
    column_types,
    is_nested,
    is_numeric,
    numeric_columns,
    require_column,
    require_numeric,
    text_columns,
)
from tabsieve.plans.held import drop_held, hold, new_folder
from tabsieve.plans.lookup import BROADCAST_BYTES, BROADCAST_ROWS, HOT_SHARE, lookup
from tabsieve.plans.tall import tall
from tabsieve.plans.together import together

SAMPLE_ROWS = 6
# Rows at least this wide are hashed before they are compared in full.
WIDE_ROW_BYTES = 64
# Rows of a held file whose places are marked: at most 2 MB of bits.
FILE_ROWS = 1 << 24
DIGITS = 4


def _no_maps(df: DataFrame) -> None:
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            raise ValueError(f"Column '{f.name}' is a map; rows with maps cannot be compared.")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with its number of occurrences.

    Rows are combined within each task before they are shuffled, so a row that
    fills a third of the table crosses the network once per task. Wide tables
    first shuffle an 8-byte hash per row: only rows that share their hash with
    another row can be duplicates. If such hashes are few they are broadcast
    and only their rows are shuffled and compared in full; if they are many, rows are told
    apart by digests and one row of each group is fetched from its place.
    """
    _no_maps(df)
    rows = finite_columns(df)
    repeated = repeated_hashes(rows)
    if repeated is None and _by_place(rows):
        stored = _with_digests(rows)
        counted = hold(_counted(stored).where("__n > 1"), "groups")
        found = _rows_at(stored, counted)
        drop_held(stored)
        return found.join(counted.drop("__at"), "__d").drop("__d")
    if repeated is not None:
        rows = rows.withColumn("__h", _row_hash(rows)).join(F.broadcast(repeated), "__h", "left_semi").drop("__h")
    counted = rows.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > 1)


def repeated_hashes(rows: DataFrame) -> DataFrame | None:
    """A held table of the row hashes that occur more than once, if rows are wide
    and these hashes are few enough to be broadcast."""
    if _row_bytes(rows) < WIDE_ROW_BYTES:
        return None
    counted = rows.select(_row_hash(rows).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    repeated = hold(counted.where(F.col("__n") > 1).select("__h"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        return repeated
    drop_held(repeated)
    return None


def distinct_rows(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """The rows without their copies; only rows with a repeated hash are shuffled, and
    of wide rows with many such hashes none: those that stay are held."""
    if repeated is None and _by_place(rows):
        stored = _with_digests(rows)
        found = _rows_at(stored, _counted(stored))
        drop_held(stored)
        return found.drop("__d")
    if repeated is None:
        return rows.dropDuplicates()
    side = F.broadcast(repeated.withColumn("__again", F.lit(True)))
    marked = rows.withColumn("__h", _row_hash(rows)).join(side, "__h", "left").drop("__h")
    once = marked.where(F.col("__again").isNull()).drop("__again")
    return once.unionAll(marked.where(F.col("__again")).drop("__again").dropDuplicates())


def _by_place(rows: DataFrame) -> bool:
    """Whether rows are shuffled as digests with their places, never whole."""
    return _row_bytes(rows) >= WIDE_ROW_BYTES and not any(is_nested(f) for f in rows.schema.fields)


def _with_digests(rows: DataFrame) -> DataFrame:
    """The held rows with a 256-bit digest ``__d``, in files of at most FILE_ROWS rows.

    Each value is written behind its length, so that only equal rows are written alike.
    """
    texts = []
    for f in rows.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, T.BinaryType):
            value = F.hex(value)
        elif isinstance(f.dataType, T.TimestampType):  # an hour comes twice a year
            value = F.unix_micros(value)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = value + 0.0
        value = value.cast("string")
        texts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return hold(rows.withColumn("__d", F.unhex(F.sha2(F.concat(*texts), 256))), "rows", FILE_ROWS)


def _places(stored: DataFrame) -> DataFrame:
    """Adds ``__f`` and ``__r``, hash of the file and number of the row in it."""
    return stored.select("*", F.xxhash64("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))


def _counted(stored: DataFrame) -> DataFrame:
    """``(__d, __n, __at)``: rows of each digest, and the place of one of them. Only
    digests are read and shuffled, a hot one once for each task."""
    at = F.min(F.struct("__f", "__r")).alias("__at")
    return _places(stored).select("__d", "__f", "__r").groupBy("__d").agg(F.count(F.lit(1)).alias("__n"), at)


def _rows_at(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """A held table of the rows of ``stored`` that stand at ``__at``.

    Places are bitmaps, one bit for each row. Files are dealt to as many slices as
    keep the bitmaps of one within BROADCAST_BYTES; a slice reads its own files, so that every
    row is read once and none is shuffled.
    """
    spark = stored.sparkSession
    spots = counted.select("__at.__f", "__at.__r").withColumn("__b", F.bitmap_bucket_number("__r"))
    marks = hold(spots.groupBy("__f", "__b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("__r")).alias("__bits")), "marks")
    size = marks.agg(F.coalesce(F.sum(F.octet_length("__bits") + 64), F.lit(0))).first()[0]
    slices = F.lit(-(-size // BROADCAST_BYTES) or 1)
    path = new_folder(spark, "kept")
    place = F.bitmap_bit_position("__r").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    for k in range(-(-size // BROADCAST_BYTES) or 1):
        rows = _places(stored.where(F.pmod(F.xxhash64("_metadata.file_path"), slices) == k)).withColumn("__b", F.bitmap_bucket_number("__r"))
        side = F.broadcast(marks.where(F.pmod("__f", slices) == k))
        kept = rows.join(side, ["__f", "__b"]).where(F.getbit(byte, place % 8) == 1)
        kept.select(*[col(c) for c in stored.columns]).write.mode("append").parquet(path)
    drop_held(marks)
    return spark.read.schema(stored.schema).parquet(path)


def _row_bytes(df: DataFrame) -> int:
    """Typical width of a row by its types."""
    sizes = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "string": 20}
    return sum(sizes.get(t, 8 if "<" not in t else 100) for _, t in df.dtypes)


def _row_hash(df: DataFrame) -> Column:
    """Equal rows have equal hashes; adding zero makes -0.0 the zero it equals."""
    floats = ("float", "double")
    return F.xxhash64(*[col(c) + 0.0 if t in floats else col(c) for c, t in df.dtypes])


def duplicate_count(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: rows beyond the first of each group of identical rows."""
    groups = duplicate_groups(df) if groups is None else groups
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_sample(
    df: DataFrame, order_by: Sequence[str], k: int = SAMPLE_ROWS, groups: DataFrame | None = None
) -> DataFrame:
    """The first k rows, in row order, among all members of duplicate groups.

    The first k groups hold the first k rows, and no more than k copies of any
    group can be shown; larger groups are never expanded.
    """
    for c in order_by:
        require_column(df, c)
    rest = [col(f.name) for f in df.schema.fields if f.name not in order_by]
    keys = [col(c) for c in order_by] + rest
    groups = duplicate_groups(df) if groups is None else groups
    first = groups.orderBy(*keys).limit(k)
    copies = F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(k)).cast("int"))
    return (
        first.withColumn("__copy", F.explode(copies))
        .orderBy(*keys)
        .limit(k)
        .select(*[col(c) for c in df.columns])
    )


NULL_REPORT = (
    "column string, null_count bigint, pct double, spark_type string, "
    "mean double, median double, mode string, suggested string, suggested_value string"
)


def null_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, their share and the suggested fill.

    Numbers get mean and median and the suggestion 'mean'; other columns get the
    smallest most frequent value and the suggestion 'mode'.
    """
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(present(df, f.name).isNull()).alias(f"c{i}") for i, f in enumerate(fields)],
    ).first()
    rows = counts["rows"]
    missing = {f.name: counts[f"c{i}"] for i, f in enumerate(fields) if counts[f"c{i}"]}
    numeric = [f.name for f in fields if f.name in missing and is_numeric(f)]
    other = [
        f.name
        for f in fields
        if f.name in missing and not is_numeric(f) and not is_nested(f) and missing[f.name] < rows
    ]
    means, medians, modes = {}, {}, {}

    def for_numbers():
        if numeric:
            got = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            means.update({c: got[f"m{i}"] for i, c in enumerate(numeric)})
            found = exact_quantiles(df, {c: (0.5,) for c in numeric})
            medians.update({c: found[c][0.5] for c in numeric})

    def for_others():
        if other:
            modes.update({c: m for c, (_, m) in distinct_and_mode(df, other).items()})

    together(df.sparkSession, for_numbers, for_others)
    out = [
        (
            f.name,
            missing[f.name],
            100.0 * missing[f.name] / rows,
            f.dataType.simpleString(),
            means.get(f.name),
            medians.get(f.name),
            None if modes.get(f.name) is None else str(modes[f.name]),
            "mean" if is_numeric(f) else "mode",
        )
        for f in fields
        if f.name in missing
    ]
    schema = NULL_REPORT.rsplit(",", 1)[0]
    table = df.sparkSession.createDataFrame(out, schema)
    table = table.withColumns(
        {"pct": F.round("pct", 1), "mean": F.round("mean", DIGITS), "median": F.round("median", DIGITS)}
    )
    return table.withColumn(
        "suggested_value",
        F.when(F.col("suggested") == "mean", F.col("mean").cast("string")).otherwise(F.col("mode")),
    )


@dataclass
class Fences:
    """Quartiles of a column and the outlier bounds 1.5 IQR beyond them."""

    n: int
    low: float | None
    high: float | None
    p25: float | None
    p75: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.p25 is None else self.p75 - self.p25

    @property
    def lower(self) -> float:
        return self.p25 - 1.5 * self.iqr

    @property
    def upper(self) -> float:
        return self.p75 + 1.5 * self.iqr


def fences(df: DataFrame, columns: Sequence[str], known: Mapping[str, Extent] | None = None) -> dict[str, Fences]:
    known = known if known is not None else extents(df, columns)
    found = exact_quantiles(df, {c: (0.25, 0.75) for c in columns}, known)
    return {
        c: Fences(known[c].n, known[c].low, known[c].high, found[c][0.25], found[c][0.75]) for c in columns
    }


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns with values outside the IQR fences.

    Columns with fewer than four values, a zero IQR or no outlier are left out.
    The count uses the unrounded bounds.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    for c in columns:
        require_numeric(df, c)
    schema = (
        "column string, outliers bigint, lower_bound double, upper_bound double, col_min double, col_max double"
    )
    found = fences(df, columns) if columns else {}
    # A column whose range lies inside its fences has no outlier to count.
    used = {
        c: f
        for c, f in found.items()
        if f.n >= 4 and f.iqr != 0 and (f.low < f.lower or f.high > f.upper)
    }
    rows = []
    if used:
        counts = df.agg(
            *[
                F.count_if(~number(df, c).between(F.lit(f.lower), F.lit(f.upper))).alias(f"c{i}")
                for i, (c, f) in enumerate(used.items())
            ]
        ).first()
        rows = [
            (c, counts[f"c{i}"], f.lower, f.upper, f.low, f.high) for i, (c, f) in enumerate(used.items())
        ]
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.withColumns(
        {c: F.round(c, DIGITS) for c in ("lower_bound", "upper_bound", "col_min", "col_max")}
    )


def _column_name(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("idx") + 1).alias("column")


def _spellings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(idx, key_id, variant): the normal form's id and the text of every value."""
    rows = [(text_id(text_key(col(c))), col(c)) for c in columns]
    return tall(df, rows, ("key_id", "variant")).where(F.col("variant").isNotNull())


def text_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(idx, key_id, variants, affected) of normal forms with more than one spelling.

    Two aggregations over ids: first rows per spelling, then spellings per
    normal form. Long texts are represented by their hash in both.
    """
    ids = _spellings(df, columns).select("idx", "key_id", text_id(F.col("variant")).alias("variant_id"))
    counted = ids.groupBy("idx", "key_id", "variant_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("idx", "key_id")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("affected"))
        .where(F.col("variants") > 1)
    )


VARIANTS = "column string, key string, variant string, n bigint"
AFFECTED = "column string, groups bigint, total_affected bigint"


def text_variants(
    df: DataFrame, columns: Sequence[str] | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """(column, key, variant, n) for normal forms with more than one spelling.

    One row per spelling, so a normal form with very many spellings is never
    gathered in one place; order by (column, key, variant) to read it. ``ids``
    is a held ``text_ids`` table, if the caller has one.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], VARIANTS)
    keys = (hold(text_ids(df, columns), "variants") if ids is None else ids).select(
        F.struct("idx", "key_id").alias("id"), "variants"
    )
    size = keys.agg(
        F.sum("variants").alias("rows"),
        F.coalesce(F.sum(F.octet_length("id.key_id") + 64), F.lit(0)).alias("bytes"),
    ).first()
    # At most HOT_SHARE normal forms can own 1/HOT_SHARE of the spellings.
    hot = keys.where(F.col("variants") >= F.lit(size["rows"] or 1) / HOT_SHARE)
    values = _spellings(df, columns).withColumn("n", F.lit(1).cast("long"))
    if size["bytes"] > BROADCAST_BYTES:  # the lookup will shuffle: send every spelling once
        values = values.groupBy("idx", "key_id", "variant").agg(F.sum("n").alias("n"))
    marked = lookup(values, F.struct("idx", "key_id"), keys, "id", size["bytes"], hot)
    found = marked.where(F.col("variants").isNotNull()).groupBy("idx", "variant").agg(F.sum("n").alias("n"))
    return found.select(_column_name(columns), text_key(F.col("variant")).alias("key"), "variant", "n")


def text_affected(
    df: DataFrame, columns: Sequence[str] | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """(column, groups, total_affected): rows that hold one of several spellings."""
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], AFFECTED)
    found = text_ids(df, columns) if ids is None else ids
    sums = found.groupBy("idx").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("affected").alias("total_affected")
    )
    return sums.select(_column_name(columns), "groups", "total_affected")


def detect_issues(df: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    """All detectors of one table, each result a DataFrame.

    Duplicate groups and normal forms are counted once, held, and read by both of
    their detectors; the detectors' jobs run side by side.
    """
    spark, texts = df.sparkSession, text_columns(df)
    groups, ids, nulls, outliers = together(
        spark,
        lambda: hold(duplicate_groups(df), "duplicates"),
        lambda: hold(text_ids(df, texts), "variants") if texts else None,
        lambda: null_report(df),
        lambda: outlier_report(df),
    )
    return {
        "column_types": column_types(df),
        "duplicates": duplicate_count(df, groups),
        "duplicate_sample": duplicate_sample(df, order_by, groups=groups),
        "nulls": nulls,
        "outliers": outliers,
        "text_affected": text_affected(df, texts, ids),
        "text_variants": text_variants(df, texts, ids),
    }


def suggest_operations(
    df: DataFrame,
    casts: Mapping[str, str] | None = None,
    duplicates: bool = False,
    fills: Mapping[str, str] | None = None,
    outliers: Sequence[str] = (),
    fix_text: bool = True,
) -> list[dict]:
    """An ordered list of cleaning operations from the detectors' findings.

    Order: casts, duplicates, fills, outliers, text. Missing values are filled
    as suggested unless ``fills`` names another method or 'skip'; outlier and
    duplicate removal are opt-in; every spelling is mapped to its normal form.
    """
    fills = dict(fills or {})
    ops: list[dict] = [
        {"type": "cast_type", "column": c, "dtype": d} for c, d in (casts or {}).items() if d
    ]
    if duplicates and duplicate_count(df).first()["duplicates"]:
        ops.append({"type": "remove_duplicates"})
    for r in null_report(df).select("column", "suggested").collect():
        method = fills.get(r["column"], r["suggested"])
        if method != "skip":
            ops.append({"type": "fill_nulls", "column": r["column"], "method": method})
    flagged = {r["column"] for r in outlier_report(df).select("column").collect()} if outliers else set()
    ops += [{"type": "remove_outliers", "column": c} for c in outliers if c in flagged]
    texts = text_columns(df)
    if fix_text and texts:
        # Normal forms and spellings of all columns are found once.
        ids = hold(text_ids(df, texts), "variants")
        bad = {r["column"] for r in text_affected(df, texts, ids).select("column").collect()}
        spelled = hold(text_variants(df, texts, ids).where(F.col("variant") != F.col("key")), "spellings") if bad else None
        drop_held(ids)
        for c in texts:
            if c in bad:
                mine = spelled.where(F.col("column") == c)
                mapping = mine.select(F.col("variant").alias("value"), F.col("key").alias("replacement"))
                ops.append({"type": "fix_text", "column": c, "mapping": mapping})
    return ops
