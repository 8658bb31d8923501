"""Loading tables: CSV and JSON with inferred types, Parquet and ORC as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.values import (
    INTEGER_PATTERN,
    col,
    finite_columns,
    missing_to_null,
    plain_number,
    strip_text,
)
from tabsieve.operators.schema import text_columns
from tabsieve.plans.held import drop_held, new_folder
from tabsieve.plans.tall import tall
from tabsieve.sources.records import csv_records, ends_open, json_records, text_lines

FORMATS = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".parquet": "parquet",
    ".orc": "orc",
}
# Spellings of truth values.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")


def load_table(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a table by format or file extension; other formats are a ValueError."""
    if fmt is None:
        ending = PurePosixPath(path).suffix.lower()
        if ending not in FORMATS:
            raise ValueError(f"Unsupported type '{ending}'. Use one of {', '.join(FORMATS)}.")
        fmt = FORMATS[ending]
    if fmt == "csv":
        return read_csv(spark, path, multi_line)
    if fmt in ("json", "jsonl"):
        return read_json(spark, path, records_array=None if fmt == "json" else False)
    if fmt in ("parquet", "orc"):
        return distinct_names(finite_columns(spark.read.format(fmt).load(path)))
    raise ValueError(f"Unsupported type '{fmt}'.")


def distinct_names(df: DataFrame) -> DataFrame:
    """The table, or ValueError if two names differ only by case."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    names = df.columns if sensitive else [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("Column names must differ by more than case.")
    return df


_BROKEN = "__unparsed"


def _csv_reader(spark: SparkSession, multi_line: bool):
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.option("emptyValue", "").option("encoding", "UTF-8")


def _first_lines(spark: SparkSession, path: str, found: Column, end: str | None = None) -> list:
    """``(line, found, blocks)`` for each file: its first line that is not blank, whether
    ``found`` holds for any, and in how many blocks lines begin. A block of a file is read by one task, from its start."""
    lines = spark.read.text(path, lineSep=end).where("trim(value) <> ''")
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", "value", found.alias("found"))
    blocks = lines.groupBy("file_path", "file_block_start").agg(F.first("value").alias("line"), F.bool_or("found").alias("found"))
    return blocks.groupBy("file_path").agg(
        F.min_by("line", "file_block_start").alias("line"), F.bool_or("found").alias("found"), F.count("*").alias("blocks")
    ).collect()


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; missing tokens become NULL before types are inferred.

    Outer blanks of text are kept and doubled quotes are one quote. ISO dates
    stay text until they are cast. Rows with too few cells end in NULLs. Rows with
    too many, and files whose headers differ, are a ValueError. Files with line
    breaks in quoted cells, found by a first look or named by ``multi_line``, are
    cut into records by many tasks as well, at the price of a shuffle of their lines. Two
    passes come before the first use: that look, and the one that infers types.
    """
    if not _csv_reader(spark, multi_line).csv(path).columns:
        raise ValueError(f"Could not parse {path} as CSV: it has no header.")
    # Whether a quoted cell goes on after the end of its line.
    files = _first_lines(spark, path, ends_open(F.col("value")))
    if len({f["line"].strip() for f in files}) > 1:
        raise ValueError(f"Could not parse {path} as CSV: its files have different headers.")
    broken = [f["file_path"] for f in files if multi_line or f["found"]]
    plain = [f["file_path"] for f in files if not (multi_line or f["found"])]
    names = _csv_reader(spark, bool(broken)).csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in [*names, _BROKEN]]
    parts = []
    if plain or not broken:
        reader = _csv_reader(spark, False).schema(T.StructType(fields)).option("columnNameOfCorruptRecord", _BROKEN)
        parts.append(reader.csv(plain if broken else path))
    if broken:
        shape = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in fields)
        options = {"escape": '"', "emptyValue": "", "multiLine": "true", "columnNameOfCorruptRecord": _BROKEN}
        records = csv_records(text_lines(spark, broken if plain else path))
        parts.append(records.select(F.from_csv("record", shape, options).alias("cells")).select("cells.*"))
    df = reduce(DataFrame.unionByName, parts)
    cells = F.length(F.regexp_replace(F.regexp_replace(_BROKEN, '"([^"]|"")*"', ""), "[^,]", "")) + 1

    def refuse(long: int) -> None:
        if long:
            raise ValueError(f"Could not parse {path} as CSV: {long} row(s) have more than {len(names)} cells.")

    distinct_names(df)
    # A row is parsed in full, and found to be too long, as all its cells are asked for.
    return infer_types(df, names, cells > len(names), refuse).drop(_BROKEN)


def normalize_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spellings of 'missing' in text columns become NULL."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df
    return df.select(*[missing_to_null(col(c)).alias(c) if c in columns else col(c) for c in df.columns])


def _truth(text: Column) -> Column:
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def _whole(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_PATTERN), text).try_cast("long")


_INFINITE = r"^[+-]?(?i)(inf|infinity)$"


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, bad: Column | None = None, refuse: Callable[[int], None] | None = None
) -> DataFrame:
    """Text columns read as long, double or boolean where every value fits.

    One aggregate counts, per column, how many values each type can hold; the
    casts themselves stay lazy. A column with no value at all becomes double. The
    same aggregate counts ``bad`` rows, and ``refuse`` is called with their number.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    clean = normalize_missing(df, columns)
    tests = [
        (
            col(c).isNotNull(),
            _whole(strip_text(col(c))).isNotNull(),
            plain_number(strip_text(col(c))).isNotNull() | strip_text(col(c)).rlike(_INFINITE),
            _truth(col(c)).isNotNull(),
            F.lit(False) if bad is None or i else F.coalesce(bad, F.lit(False)),
        )
        for i, c in enumerate(columns)
    ]
    names = ("n", "whole", "float", "truth", "bad")
    counts = tall(clean, tests, names).groupBy("idx").agg(*[F.count_if(n).alias(n) for n in names])
    fits = {columns[r["idx"]]: r for r in counts.collect()}
    if refuse is not None:
        refuse(fits[columns[0]]["bad"] if columns[0] in fits else 0)
    out = []
    for c in clean.columns:
        if c not in columns:
            out.append(col(c))
            continue
        found, bare = fits.get(c), strip_text(col(c))
        n = found["n"] if found else 0
        if n == 0 or (found["whole"] < n and found["float"] == n):
            out.append(plain_number(bare).alias(c))
        elif found["whole"] == n:
            out.append(_whole(bare).alias(c))
        elif found["truth"] == n:
            out.append(_truth(col(c)).alias(c))
        else:
            out.append(col(c))
    return clean.select(*out)


def _json(spark: SparkSession, path: str | list[str], whole: bool) -> DataFrame:
    df = spark.read.option("multiLine", whole).json(path)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"Could not parse {path} as JSON records.")
    return df


def _array_lines(spark: SparkSession, files: list[str]) -> str:
    """A held folder of lines ``{file, block, number, record}``, one for each record of the arrays."""
    found = json_records(text_lines(spark, files, "}"))
    head = F.regexp_replace(F.to_json(F.struct("file", "block", "number")), r"\}$", "")
    # Line ends stand between the tokens of a record, never inside of one.
    body = F.regexp_replace("record", r"[\r\n]+", " ")
    folder = new_folder(spark, "records")
    found.select(F.concat(head, F.lit(',"record":'), body, F.lit("}"))).write.text(folder)
    drop_held(found)
    return folder


def read_json(spark: SparkSession, path: str, records_array: bool | None = None) -> DataFrame:
    """JSON records: one per line, or one array of records per file.

    Unless ``records_array`` says which, it is decided for each file: a folder may
    hold both. Lines are split among tasks. An array that fills several blocks of its file is
    cut into records by many tasks, and these are held as lines; smaller ones are read
    whole. Date-like text stays text until it is cast.
    """
    cut: list[str] = []
    if records_array is None:
        files = _first_lines(spark, path, F.lit(True), "}")
        arrays = {f["file_path"]: f["line"].lstrip("\ufeff \t\r\n").startswith("[") for f in files}
        cut = [f["file_path"] for f in files if arrays[f["file_path"]] and f["blocks"] > 1]
        kinds = [([f for f, a in arrays.items() if a == whole and f not in cut], whole) for whole in (False, True)]
        kinds = [k for k in kinds if k[0]]
    else:
        kinds = [(path, records_array)]
    if not kinds and not cut:
        return _json(spark, path, False)
    parts = [_json(spark, files, whole) for files, whole in kinds]
    lines = _array_lines(spark, cut) if cut else None
    if lines:
        records = _json(spark, lines, False)
        if not isinstance(records.schema["record"].dataType, T.StructType):
            raise ValueError(f"Could not parse {path} as JSON records.")
        parts.append(records.select("record.*"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    order = key_order(spark, kinds, lines)
    # Columns that the folders name come last.
    names = [c for c in order if c in out.columns] + [c for c in out.columns if c not in order]
    return distinct_names(finite_columns(out.select(*[col(c) for c in names])))


def key_order(spark: SparkSession, kinds: Sequence[tuple[str | list[str], bool]], lines: str | None = None) -> list[str]:
    """The keys of JSON records by their first places: file, record, place in the record.

    ``kinds`` are files and whether each is one array, ``lines`` those of arrays that were cut. One aggregate in which every task
    keeps the first place of each key; as many rows as there are keys are fetched.
    """

    def places(files: str | list[str], whole: bool) -> DataFrame:
        # Elements of a field are read as texts, those of a bare array are not.
        field = F.from_json(F.concat(F.lit('{"records":'), F.col("value"), F.lit("}")), "records array<string>")
        records = field["records"] if whole else F.array("value")
        rows = spark.read.text(files, wholetext=whole).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.posexplode(records).alias("number", "record"),
        )
        return rows.select(F.struct("file", "block", "place", "number").alias("at"), F.posexplode(F.json_object_keys("record")).alias("pos", "key"))

    tables = [places(*k) for k in kinds]
    if lines:
        read = F.from_json("value", "file string, block long, number long, record string").alias("r")
        rows = spark.read.text(lines).select(read).select("r.file", "r.block", F.lit(0).cast("long").alias("place"), "r.number", "r.record")
        at = F.struct("file", "block", "place", F.col("number").cast("int").alias("number"))
        tables.append(rows.select(at.alias("at"), F.posexplode(F.json_object_keys("record")).alias("pos", "key")))
    found = reduce(DataFrame.unionAll, tables)
    firsts = found.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first"))
    return [r["key"] for r in sorted(firsts.collect(), key=lambda r: r["first"])]
