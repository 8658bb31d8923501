"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.checks.views import WIDE, table, view
from tabsieve.functions.values import finite_columns
from tabsieve.operators import association, chartdata, cleaning, frequency, profile, quality, report, schema, sketches
from tabsieve.operators.quantiles import quantile_table
from tabsieve.operators.ranks import rank_table
from tabsieve.plans.held import new_folder
from tabsieve.sources import readers, writers
from tabsieve.streaming.cleaning import clean_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def comparable(value: Column | str, digits: int = 4) -> Column:
    """Digits that do not depend on the order of summation: 4 decimals below a
    million, whole numbers above, both a little off the tie between two results."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(value) >= 1e6, F.round(value + 1e-4, 0)).otherwise(F.round(value + 1e-9, digits))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[comparable(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- Sources and sinks -------------------------------------------------------------


@query
def csv_round_trip(spark, folder):
    """Write as CSV, read back with missing tokens and inferred types."""
    path = new_folder(spark, "csv")
    writers.write_csv(view(spark, folder, "tokens"), path)
    return readers.load_table(spark, path, "csv")


@query
def csv_text_kept(spark, folder):
    """Outer blanks, quotes and non-ASCII text survive CSV."""
    path = new_folder(spark, "csv")
    padded = table(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('  \"', c_mktsegment, '\", é東京 ') AS `población`"
    )
    writers.write_csv(padded, path)
    return readers.load_table(spark, path, "csv")


@query
def json_round_trip(spark, folder):
    """JSON lines; names come back in alphabetical order."""
    path = new_folder(spark, "json")
    view(spark, folder, "nulls").write.json(path)
    return readers.load_table(spark, path, "jsonl")


@query
def csv_line_breaks(spark, folder):
    """Line breaks, commas and quotes inside cells survive CSV."""
    path = new_folder(spark, "csv")
    writers.write_csv(view(spark, folder, "broken_lines"), path)
    return readers.load_table(spark, path, "csv")


@query
def csv_rejected(spark, folder):
    """What is said of a table whose rows are longer than its header."""
    path = new_folder(spark, "csv")
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey", "concat('y', IF(s_suppkey % 5 = 0, ',x', '')) AS b")
    # Written without quotes, some rows have a cell too many.
    rows.write.option("header", True).option("quote", "").csv(path)
    try:
        readers.load_table(spark, path, "csv")
    except ValueError as error:
        return spark.createDataFrame([(str(error).split(": ", 1)[1],)], "text string")


@query
def csv_nested(spark, folder):
    """Arrays and structs come back as JSON text."""
    path = new_folder(spark, "csv")
    nested = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "array(s_nationkey, s_suppkey) AS keys", "named_struct('nation', s_nationkey) AS place"
    )
    writers.write_csv(nested, path)
    return readers.load_table(spark, path, "csv")


def _json_arrays(spark, folder, path):
    """Arrays of records, one to a file."""
    parts = table(spark, folder, "supplier").groupBy((F.col("s_suppkey") % 4).alias("part"))
    records = F.to_json(F.collect_list(F.struct("s_suppkey", "s_name")))
    parts.agg(records.alias("value")).write.partitionBy("part").text(path)


@query
def json_array(spark, folder):
    path = new_folder(spark, "json")
    _json_arrays(spark, folder, path)
    return readers.load_table(spark, path, "json").select("s_suppkey", "s_name")


@query
def json_key_order(spark, folder):
    """Columns come in the order of the keys in the files, not of their names."""
    path = new_folder(spark, "json")
    lines = table(spark, folder, "supplier").selectExpr("s_suppkey", "s_name AS name", "IF(s_suppkey % 2 = 0, s_acctbal, NULL) AS balance")
    lines.orderBy("s_suppkey").coalesce(1).write.json(path)
    found = readers.load_table(spark, path, "json")
    return found.selectExpr("s_suppkey", "name", "balance", f"'{','.join(found.columns)}' AS columns")


@query
def json_mixed(spark, folder):
    """A folder of arrays and of lines loses neither."""
    path = new_folder(spark, "json")
    _json_arrays(spark, folder, path)
    lines = table(spark, folder, "supplier").selectExpr("s_suppkey + 1000000 AS s_suppkey", "s_nationkey")
    lines.write.json(f"{path}/part=9")
    return readers.load_table(spark, path, "json").select("s_suppkey", "s_name", "s_nationkey")


@query
def orc_round_trip(spark, folder):
    path = new_folder(spark, "orc")
    view(spark, folder, "gaps").write.orc(path)
    return readers.load_table(spark, path, "orc")


@query
def missing_tokens(spark, folder):
    return readers.normalize_missing(view(spark, folder, "tokens"))


@query
def inferred_types(spark, folder):
    return readers.infer_types(view(spark, folder, "tokens"))


@query
def finite_values(spark, folder):
    return finite_columns(view(spark, folder, "not_finite"))


@query
def preview_rows(spark, folder):
    return writers.preview(view(spark, folder, "nulls"), ["l_orderkey", "l_linenumber"])


# -- Schema, projection, filters ---------------------------------------------------


@query
def dataset_overview(spark, folder):
    return schema.dataset_overview(table(spark, folder, "orders"))


@query
def column_types(spark, folder):
    """Logical type of every column with its number of values."""
    orders = table(spark, folder, "orders")
    counts = orders.agg(*[F.count(c).alias(c) for c in orders.columns])
    names = ", ".join(f"'{c}', {c}" for c in orders.columns)
    filled = counts.selectExpr(f"stack({len(orders.columns)}, {names}) AS (column, filled)")
    return schema.column_types(orders).drop("spark_type").join(F.broadcast(filled), "column")


@query
def numeric_projection(spark, folder):
    return schema.select_numeric(table(spark, folder, "orders"))


@query
def text_projection(spark, folder):
    return schema.select_text(table(spark, folder, "part"))


@query
def complete_rows(spark, folder):
    return schema.complete_rows(view(spark, folder, "nulls"), "qty", "flag")


@query
def range_inside(spark, folder):
    return schema.range_filter(view(spark, folder, "nulls"), "qty", 10.0, 20.0)


@query
def range_outside(spark, folder):
    return schema.range_filter(view(spark, folder, "nulls"), "qty", 10.0, 20.0, inside=False)


# -- Column statistics ---------------------------------------------------------------


@query
def profile_lineitem(spark, folder):
    return _rounded(profile.profile_columns(table(spark, folder, "lineitem")))


@query
def profile_nullable(spark, folder):
    return _rounded(profile.profile_columns(view(spark, folder, "wide_gaps")))


@query
def profile_events(spark, folder):
    return _rounded(profile.profile_columns(view(spark, folder, "gaps"), ["value"]))


@query
def statistics_integer(spark, folder):
    return _rounded(profile.column_statistics(table(spark, folder, "documents"), "n_chars"))


@query
def statistics_text(spark, folder):
    return profile.column_statistics(view(spark, folder, "nulls"), "flag")


@query
def numeric_summary(spark, folder):
    return _rounded(profile.numeric_summary(table(spark, folder, "customer")))


@query
def categorical_summary(spark, folder):
    found = profile.categorical_summary(table(spark, folder, "customer"), ["c_custkey"])
    return found.withColumn("sample", F.concat_ws("|", "sample"))


@query
def value_counts(spark, folder):
    return frequency.value_counts(view(spark, folder, "nulls"), "flag")


@query
def frequency_table(spark, folder):
    return frequency.frequency_table(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"])


@query
def mode_tie_break(spark, folder):
    return frequency.top_values(table(spark, folder, "orders"), "o_orderpriority", 1)


@query
def quantiles_distributed(spark, folder):
    columns = ["l_extendedprice", "l_quantity", "l_orderkey"]
    found = quantile_table(table(spark, folder, "lineitem"), columns, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])
    return _rounded(found)


@query
def quantiles_wide(spark, folder):
    """150 ranks of 30 columns from two scans."""
    return _rounded(quantile_table(view(spark, folder, "wide_holes"), WIDE, [0.05, 0.25, 0.5, 0.75, 0.95]))


@query
def average_ranks(spark, folder):
    return rank_table(view(spark, folder, "gaps"), "value", bucket_values=1000)


# -- Quality -------------------------------------------------------------------------


@query
def duplicate_count(spark, folder):
    return quality.duplicate_count(view(spark, folder, "dups"))


@query
def duplicate_sample(spark, folder):
    return quality.duplicate_sample(view(spark, folder, "dups"), ["l_orderkey", "l_partkey"])


@query
def null_report(spark, folder):
    return quality.null_report(view(spark, folder, "nulls")).drop("spark_type")


@query
def outlier_report_events(spark, folder):
    return quality.outlier_report(table(spark, folder, "events"))


@query
def outlier_report_documents(spark, folder):
    return quality.outlier_report(table(spark, folder, "documents"))


@query
def outlier_report_gaps(spark, folder):
    return quality.outlier_report(view(spark, folder, "gaps"), ["value"])


@query
def text_variants(spark, folder):
    return quality.text_variants(view(spark, folder, "variants"))


@query
def text_affected(spark, folder):
    return quality.text_affected(view(spark, folder, "messy"))


@query
def suggested_operations(spark, folder):
    ops = quality.suggest_operations(view(spark, folder, "messy"), outliers=["qty"], duplicates=True)
    rows = [(i, op["type"], op.get("column"), op.get("method")) for i, op in enumerate(ops, 1)]
    return spark.createDataFrame(rows, "step int, type string, column string, method string")


# -- Cleaning ------------------------------------------------------------------------


def _cleaned(spark, folder, name, *operations):
    return cleaning.apply_cleaning(view(spark, folder, name), list(operations))[0]


def _fill(column, method):
    return {"type": "fill_nulls", "column": column, "method": method}


def _cast(column, dtype, **more):
    return {"type": "cast_type", "column": column, "dtype": dtype, **more}


@query
def clean_dedup(spark, folder):
    return _cleaned(spark, folder, "dups", {"type": "remove_duplicates"})


@query
def fill_mean(spark, folder):
    return _rounded(_cleaned(spark, folder, "nulls", _fill("qty", "mean")))


@query
def fill_median(spark, folder):
    return _rounded(_cleaned(spark, folder, "nulls", _fill("qty", "median")))


@query
def fill_zero(spark, folder):
    return _rounded(_cleaned(spark, folder, "nulls", _fill("qty", "zero")))


@query
def fill_mode(spark, folder):
    return _rounded(_cleaned(spark, folder, "nulls", _fill("flag", "mode"), _fill("qty", "mode")))


@query
def fill_drop(spark, folder):
    return _rounded(_cleaned(spark, folder, "nulls", _fill("flag", "drop")))


@query
def remove_outliers(spark, folder):
    return _cleaned(spark, folder, "gaps", {"type": "remove_outliers", "column": "value"})


@query
def normalize_minmax(spark, folder):
    done = _cleaned(spark, folder, "nulls", {"type": "normalize", "column": "price", "method": "minmax"})
    return _rounded(done, 6)


@query
def normalize_zscore(spark, folder):
    done = _cleaned(spark, folder, "nulls", {"type": "normalize", "column": "qty", "method": "zscore"})
    return _rounded(done, 6)


@query
def fix_text(spark, folder):
    mapping = {" BUILDING ": "building", "BUILDING": "building", "furniture": "FURNITURE"}
    return _cleaned(spark, folder, "variants", {"type": "fix_text", "column": "segment", "mapping": mapping})


@query
def fix_text_found(spark, folder):
    """Every spelling replaced by its normal form, mapping taken from the detector."""
    messy = view(spark, folder, "variants")
    ops = [op for op in quality.suggest_operations(messy) if op["type"] == "fix_text"]
    return cleaning.apply_cleaning(messy, ops)[0]


@query
def cast_numeric(spark, folder):
    return _cleaned(spark, folder, "money", _cast("amount", "numeric"))


@query
def cast_datetime_us(spark, folder):
    """The format that fits the most values is found."""
    return _cleaned(spark, folder, "us_dates", _cast("day", "datetime"))


@query
def cast_datetime_warning(spark, folder):
    lines = cleaning.apply_cleaning(view(spark, folder, "us_dates"), [_cast("day", "datetime")])[1]
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines, 1)], "line int, text string")


@query
def cast_numeric_warning(spark, folder):
    lines = cleaning.apply_cleaning(
        view(spark, folder, "money"),
        [_cast("amount", "numeric"), _cast("p_partkey", "text"), _fill("p_partkey", "mean")],
    )[1]
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines, 1)], "line int, text string")


@query
def cast_datetime(spark, folder):
    return _cleaned(spark, folder, "dates", _cast("day", "datetime", formats=["yyyy-MM-dd"]))


@query
def cast_datetime_iso(spark, folder):
    return _cleaned(spark, folder, "dates", _cast("day", "datetime"))


@query
def cast_datetime_shapes(spark, folder):
    """Formats follow from the shapes: half days, names, fractions, two-digit years, order of day and month."""
    columns = ("us_clock", "spoken", "fraction", "packed", "days_first")
    return _cleaned(spark, folder, "shaped_dates", *[_cast(c, "datetime") for c in columns])


@query
def cast_datetime_offsets(spark, folder):
    """Texts with offsets are moved to UTC."""
    return _cleaned(spark, folder, "offset_dates", _cast("at", "datetime"), _cast("mixed", "datetime"))


@query
def cast_datetime_lost(spark, folder):
    """What could not be read, and times without a zone among others, are warned of."""
    done = cleaning.apply_cleaning(view(spark, folder, "shaped_dates"), [_cast("days_first", "datetime")])[1]
    done += cleaning.apply_cleaning(view(spark, folder, "offset_dates"), [_cast("at", "datetime"), _cast("mixed", "datetime")])[1]
    return spark.createDataFrame([(i, t) for i, t in enumerate(done, 1)], "line int, text string")


@query
def cast_text(spark, folder):
    return cleaning.apply_cleaning(table(spark, folder, "orders"), [_cast("o_custkey", "text")])[0]


@query
def cast_category(spark, folder):
    """A category is no number: the profile no longer lists the column."""
    done = cleaning.apply_cleaning(table(spark, folder, "part"), [_cast("p_size", "category")])[0]
    return _rounded(profile.profile_columns(done)).select("column", "count", "mean")


CHAIN = [
    {"type": "remove_duplicates"},
    _fill("qty", "median"),
    _fill("flag", "mode"),
    {"type": "remove_outliers", "column": "qty"},
    {"type": "normalize", "column": "qty", "method": "minmax"},
    {"type": "fix_text", "column": "flag", "mapping": {"a": "A", "A ": "A", "n": "N", "N ": "N"}},
]


@query
def clean_chain(spark, folder):
    return _rounded(_cleaned(spark, folder, "messy", *CHAIN), 6)


@query
def clean_report(spark, folder):
    messy = view(spark, folder, "messy")
    found = cleaning.clean(messy, [*CHAIN, {"type": "normalize", "column": "flag", "method": "zscore"}])
    cleaning.require_rows(found.table)
    return cleaning.cleaning_report(messy, found)


# -- Association ---------------------------------------------------------------------


@query
def pearson_pairs(spark, folder):
    return association.correlations(table(spark, folder, "lineitem")).drop("p_value", "rank")


@query
def pearson_gaps(spark, folder):
    return association.correlations(view(spark, folder, "wide_gaps")).drop("p_value")


@query
def spearman_pairs(spark, folder):
    return association.correlations(table(spark, folder, "lineitem"), "spearman").drop("p_value", "rank")


@query
def spearman_gaps(spark, folder):
    return association.correlations(view(spark, folder, "wide_gaps"), "spearman").drop("p_value")


@query
def pearson_wide(spark, folder):
    """Thirty columns, 435 pairs."""
    return association.correlations(view(spark, folder, "wide")).drop("p_value", "rank")


@query
def pearson_gaps_wide(spark, folder):
    """435 pairs of columns with gaps from one matrix."""
    return association.correlations(view(spark, folder, "wide_holes"), "pearson", WIDE).drop("p_value", "rank")


@query
def spearman_gaps_wide(spark, folder):
    """190 pairs of columns with gaps."""
    return association.correlations(view(spark, folder, "wide_holes"), "spearman", WIDE[:20]).drop("p_value", "rank")


@query
def spearman_wide(spark, folder):
    """Fourteen columns, 91 pairs."""
    return association.correlations(view(spark, folder, "wide"), "spearman", WIDE[:14]).drop("p_value", "rank")


@query
def spearman_empty_columns(spark, folder):
    return association.correlations(view(spark, folder, "empty_column"), "spearman").drop("p_value")


@query
def p_values_spearman(spark, folder):
    return association.correlations(table(spark, folder, "events"), "spearman")


@query
def p_values(spark, folder):
    return association.correlations(table(spark, folder, "events"))


@query
def corr_matrix(spark, folder):
    cells = association.correlation_matrix(view(spark, folder, "wide_gaps"))
    return cells.withColumn("r", F.round("r", 6))


@query
def linear_regression(spark, folder):
    return _rounded(association.linear_regression(view(spark, folder, "nulls"), "qty", "price"))


@query
def regression_report(spark, folder):
    return association.regression_report(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


# -- Chart data ----------------------------------------------------------------------


@query
def line_points(spark, folder):
    return chartdata.line_points(view(spark, folder, "gaps"), "value", "event_id")


@query
def area_points(spark, folder):
    return chartdata.area_points(view(spark, folder, "gaps"), "value", "event_id")


@query
def scatter_sample(spark, folder):
    lines = table(spark, folder, "lineitem")
    return chartdata.scatter_sample(lines, "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"], 500, seed=7)


@query
def box_outlier_sample(spark, folder):
    return chartdata.box_outlier_sample(view(spark, folder, "gaps"), "value", ["event_id"], 100, seed=3)


def _against_exact(df, found):
    """The exact figures of an approximate profile, and whether the others are within their bounds."""
    rows = found.collect()
    exact = frequency.distinct_counts(df, [r["column"] for r in rows])
    out = []
    for r in rows:
        c, marks = r["column"], (r["p25"], r["median"], r["p75"])
        close = abs(r["distinct"] - exact[c]) <= sketches.DISTINCT_ERROR * exact[c] + 1
        ranks = df.agg(*[F.avg((F.col(c) < m).cast("int")) for m in marks], *[F.avg((F.col(c) <= m).cast("int")) for m in marks]).first() if marks[0] is not None else None
        near = ranks is None or all(
            ranks[i] - sketches.RANK_ERROR <= p <= ranks[i + 3] + sketches.RANK_ERROR for i, p in enumerate(sketches.PROBABILITIES)
        )
        out.append((c, r["n"], r["nulls"], r["low"], r["high"], close, near))
    return df.sparkSession.createDataFrame(out, "column string, n long, nulls long, low double, high double, distinct_close boolean, quartiles_close boolean")


@query
def approx_profile(spark, folder):
    """Sketches of a file, checked against the exact figures by their error bounds."""
    events = table(spark, folder, "events")
    return _against_exact(events, sketches.approx_profile(sketches.sketch_columns(events)))


@query
def approx_profile_merged(spark, folder):
    """Two deliveries, each scanned once; the merged profile is one over the whole."""
    data, store = new_folder(spark, "deliveries"), new_folder(spark, "sketches")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    read = []
    for half in (0, 1):
        lines.where(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(data)
        read.append(sketches.update_store(spark, data, store))
    again = sketches.update_store(spark, data, store)
    files = len(spark.read.parquet(data).inputFiles())
    found = _against_exact(spark.read.parquet(data), sketches.approx_profile(sketches.stored(spark, store)))
    return found.withColumn("each_file_once", F.lit(sum(read) == files and min(read) > 0 and again == 0))


@query
def scatter_data(spark, folder):
    return chartdata.scatter_data(table(spark, folder, "events"), "value", "user_id")


@query
def line_series(spark, folder):
    return _rounded(chartdata.line_series(view(spark, folder, "gaps"), "value", "event_id", 100))


@query
def line_series_time(spark, folder):
    found = chartdata.line_series(table(spark, folder, "events"), "value", "ts", 50)
    return found.select("bucket", "n", comparable("avg").alias("avg"), comparable("max").alias("max"))


@query
def area_series(spark, folder):
    return _rounded(chartdata.area_series(view(spark, folder, "gaps"), "value", "event_id", 100))


@query
def histogram_auto(spark, folder):
    return _rounded(chartdata.histogram(table(spark, folder, "events"), "value"))


@query
def histogram_integers(spark, folder):
    return _rounded(chartdata.histogram(table(spark, folder, "part"), "p_size"))


@query
def bar_top20(spark, folder):
    return chartdata.bar_counts(table(spark, folder, "part"), "p_brand")


@query
def pie_share_top10(spark, folder):
    return chartdata.pie_shares(table(spark, folder, "orders"), "o_orderpriority")


@query
def box_stats(spark, folder):
    return _rounded(chartdata.box_stats(view(spark, folder, "gaps"), "value"))


@query
def box_outliers(spark, folder):
    return chartdata.box_outliers(view(spark, folder, "gaps"), "value")


@query
def scatter_points(spark, folder):
    return chartdata.scatter_points(table(spark, folder, "lineitem"), "l_discount", "l_quantity")


@query
def scatter_grid(spark, folder):
    return _rounded(chartdata.scatter_grid(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", 20))


@query
def density_curve(spark, folder):
    return chartdata.density_curve(view(spark, folder, "gaps"), "value").select(
        "point", F.round("x", 4).alias("x"), F.round("density", 7).alias("density")
    )


@query
def histogram_curve(spark, folder):
    return chartdata.histogram_curve(view(spark, folder, "gaps"), "value").select(
        "point", F.round("height", 2).alias("height")
    )


@query
def violin_curve(spark, folder):
    return chartdata.violin_curve(table(spark, folder, "documents"), "n_chars").select(
        "point", F.round("x", 3).alias("x"), F.round("density", 9).alias("density")
    )


# -- Reports -------------------------------------------------------------------------


@query
def recommendations(spark, folder):
    """Proposals from the schema, next to the size of the table they are for."""
    documents = table(spark, folder, "documents")
    return report.recommendations(documents).withColumn("n_rows", F.lit(documents.count()).cast("long"))


@query
def dataset_profile(spark, folder):
    found = report.dataset_profile(view(spark, folder, "gaps"), ["event_id"])
    return _rounded(found.withColumn("sample", F.concat_ws("|", "sample")))


@query
def profile_wide(spark, folder):
    """More columns than a text would detail."""
    df = view(spark, folder, "wide").selectExpr("*", *[f"-{c} AS m{c}" for c in WIDE])
    return report.dataset_profile(df, [WIDE[0]]).select("position", "column", "kind", "min", "max", "nulls")


@query
def profile_text_nested(spark, folder):
    df = table(spark, folder, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 5 > 0 THEN embedding END AS embedding")
    lines = report.profile_text(df, ["vec_id"]).split("\n")
    return spark.createDataFrame([(lines[-1],)], "text string")


@query
def report_overview(spark, folder):
    path = new_folder(spark, "report")
    writers.write_report(table(spark, folder, "supplier"), path, ["s_suppkey"], "json")
    return spark.read.json(f"{path}/overview").selectExpr("n_rows", "CAST(n_columns AS INT) AS n_columns")


@query
def report_markdown(spark, folder):
    path = new_folder(spark, "report")
    writers.write_report(table(spark, folder, "supplier"), path, ["s_suppkey"], "markdown")
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.where("text LIKE '#%' OR text LIKE '- Rows%'")


@query
def errors(spark, folder):
    """What is said of calls that are refused, next to the rows of the table."""
    df = table(spark, folder, "supplier")
    calls = {
        "chart": lambda: chartdata.chart_data(df, "Sankey", "s_name"),
        "column": lambda: chartdata.histogram(df, "s_none"),
        "empty": lambda: cleaning.require_rows(df.where("s_suppkey < 0")),
        "heat map": lambda: association.correlation_matrix(df, ["s_suppkey"]),
        "operation": lambda: cleaning.clean(df, [{"type": "shuffle"}]),
        "text": lambda: chartdata.histogram(df, "s_name"),
    }
    rows, n_rows = [], df.count()
    for name, call in calls.items():
        try:
            call()
        except ValueError as error:
            rows.append((name, str(error), n_rows))
    return spark.createDataFrame(rows, "call string, text string, n_rows bigint")


@query
def profile_text(spark, folder):
    lines = report.profile_text(table(spark, folder, "customer"), ["c_custkey"]).split("\n")
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines, 1)], "line int, text string")


@query
def report_summary(spark, folder):
    """The numeric summary of a written report, read back."""
    path = new_folder(spark, "report")
    writers.write_report(table(spark, folder, "supplier"), path, ["s_suppkey"])
    return _rounded(spark.read.parquet(f"{path}/numeric_summary"))


# -- Streaming -----------------------------------------------------------------------


@query
def stream_cleaned(spark, folder):
    """Steps fitted on the stored table, applied to the same rows as a stream."""
    stored = table(spark, folder, "events")
    found = cleaning.clean(
        stored,
        [
            {"type": "remove_outliers", "column": "value"},
            {"type": "normalize", "column": "value", "method": "minmax"},
            {"type": "fix_text", "column": "event_type", "mapping": {"view": "click"}},
        ],
    )
    source = spark.readStream.schema(stored.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out, marks = new_folder(spark, "stream"), new_folder(spark, "stream-state")
    job = (
        clean_stream(source.select("event_id", "event_type", "value"), found.steps)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", marks)
        .format("parquet")
        .start(out)
    )
    job.awaitTermination()
    return _rounded(spark.read.parquet(out), 6)
