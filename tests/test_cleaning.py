import pytest
from pyspark.sql import functions as F

from tabsieve.functions.dates import parse_timestamp
from tabsieve.operators import cleaning, profile, quality, schema
from tabsieve.operators.cleaning import apply_cleaning, clean


def fill(column, method):
    return {"type": "fill_nulls", "column": column, "method": method}


def cast(column, dtype, **more):
    return {"type": "cast_type", "column": column, "dtype": dtype, **more}


def values(df, column):
    return [r[column] for r in df.collect()]


def test_dedup_and_mean_fill(people):
    result = clean(people, [{"type": "remove_duplicates"}, fill("price", "mean")])
    assert result.table.count() == 4
    assert sorted(values(result.table, "price")) == pytest.approx([3.0, 5.0, 26 / 3, 18.0])
    report = cleaning.cleaning_report(people, result).first().asDict()
    assert report == {
        "rows_before": 5,
        "rows_after": 4,
        "rows_removed": 1,
        "columns_before": 3,
        "columns_after": 3,
        "warnings": "",
    }


@pytest.mark.parametrize(
    "op",
    [{"type": "remove_dupes"}, fill("price", "avg"), cast("name", "bogus")],
)
def test_unknown_words_are_rejected(people, op):
    with pytest.raises(ValueError, match="Unknown"):
        apply_cleaning(people, [op])


def test_unknown_column_and_unfitting_method_do_nothing(people):
    done, warnings = apply_cleaning(
        people, [fill("nope", "mean"), {"type": "normalize", "column": "score", "method": "mean"}, fill("price", "minmax")]
    )
    assert warnings == [] and sorted(values(done, "score")) == [6, 6, 11, 16, 21] and None in values(done, "price")


def test_type_mismatch_warns_in_order(people):
    ops = [
        fill("name", "mean"),
        {"type": "remove_outliers", "column": "name"},
        {"type": "normalize", "column": "name", "method": "zscore"},
        fill("name", "zero"),
    ]
    _, warnings = apply_cleaning(people, ops)
    assert [w.split(" on ")[0].split(" —")[0] for w in warnings] == [
        "Fill nulls (mean) skipped",
        "Remove outliers skipped",
        "Normalize skipped",
        "Fill nulls (zero) skipped",
    ]


def test_mean_of_an_integer_column_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    done, _ = apply_cleaning(df, [fill("x", "mean")])
    assert done.schema["x"].dataType.simpleString() == "double" and sorted(values(done, "x")) == [1.0, 1.5, 2.0]
    kept, _ = apply_cleaning(df.where("x > 0"), [fill("x", "median")])
    assert kept.schema["x"].dataType.simpleString() == "int"


def test_fill_with_nothing_to_fill_from(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, t string")
    done, warnings = apply_cleaning(df, [fill("x", "mean"), fill("t", "mode"), fill("x", "zero")])
    assert values(done, "x") == [0.0, 0.0] and values(done, "t") == [None, None] and warnings == []


def test_outlier_removal_drops_missing_rows_too(people):
    done, _ = apply_cleaning(people, [{"type": "remove_outliers", "column": "price"}])
    assert sorted(values(done, "price")) == [3.0, 3.0, 5.0]
    flat, _ = apply_cleaning(people.withColumn("price", F.when(F.col("score") > 6, 2.0)), [{"type": "remove_outliers", "column": "price"}])
    assert flat.count() == 5  # no spread, nothing removed


def test_normalisation_edge_cases(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "same double, x double")
    done, _ = apply_cleaning(
        df,
        [
            {"type": "normalize", "column": "same", "method": "minmax"},
            {"type": "normalize", "column": "same", "method": "zscore"},
            {"type": "normalize", "column": "x", "method": "minmax"},
        ],
    )
    assert sorted(done.collect()) == [(5.0, 0.0), (5.0, 1.0)]
    single, _ = apply_cleaning(df.limit(1), [{"type": "normalize", "column": "x", "method": "zscore"}])
    assert values(single, "x") == [None]


def test_steps_see_the_results_of_earlier_steps(spark):
    df = spark.createDataFrame([("1",), ("3",), (None,), ("x",)], "v string")
    done, warnings = apply_cleaning(df, [cast("v", "numeric"), fill("v", "mean"), {"type": "normalize", "column": "v", "method": "minmax"}])
    assert sorted(values(done, "v")) == [0.0, 0.5, 0.5, 1.0]
    assert warnings == ["Cast 'v' to number: 1 value(s) couldn't be parsed as numbers and were set to null."]


def test_figures_after_row_removal(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (None, 90.0)], "a double, b double")
    done, _ = apply_cleaning(df, [fill("a", "drop"), {"type": "normalize", "column": "b", "method": "minmax"}])
    assert sorted(values(done, "b")) == [0.0, 1.0]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("$1,234.56", 1234.56),
        ("45%", 45.0),
        ("(1,234)", -1234.0),
        (" 7 ", 7.0),
        (" 8\t", 8.0),
        ("1e3", 1000.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("+2", 2.0),
        ("1.0d", None),
        ("1f", None),
        ("nan", None),
        ("inf", None),
        ("", None),
        ("abc", None),
        ("()", None),
        ("1 2", None),
        ("0x10", None),
    ],
)
def test_lenient_numbers(spark, text, wanted):
    done, _ = apply_cleaning(spark.createDataFrame([(text,)], "v string"), [cast("v", "numeric")])
    assert values(done, "v") == [wanted]


def test_text_to_number_of_names(people):
    done, warnings = apply_cleaning(people, [cast("name", "numeric")])
    assert "name" in schema.numeric_columns(done) and set(values(done, "name")) == {None}
    assert "5 value(s)" in warnings[0]


def test_dates_categories_and_text(spark, people):
    df = spark.createDataFrame([("launch", "1999-12-31"), ("mishap", "unknown"), ("return", "2001-03-08")], "event string, day string")
    done, warnings = apply_cleaning(df, [cast("day", "datetime"), cast("event", "category")])
    days = [r["day"] for r in done.orderBy("event").collect()]
    assert str(days[2]) == "2001-03-08 00:00:00" and days[1] is None and "1 value(s)" in warnings[0]
    kinds = {r["column"]: r["logical_type"] for r in schema.column_types(done).collect()}
    assert kinds == {"event": "Category", "day": "Date/Time"}
    assert schema.text_columns(done) == [] and schema.text_columns(done, with_category=True) == ["event"]
    text, _ = apply_cleaning(people, [cast("score", "text"), cast("price", "text")])
    assert schema.numeric_columns(text) == [] and None in values(text, "price")


def test_date_formats_are_tried_in_order(spark):
    df = spark.createDataFrame([("15.01.2024",), ("2024/02/01",), ("?",)], "d string")
    done, _ = apply_cleaning(df, [cast("d", "datetime", formats=["dd.MM.yyyy", "yyyy/MM/dd"])])
    assert [str(d) for d in values(done, "d")] == ["2024-01-15 00:00:00", "2024-02-01 00:00:00", "None"]


def dates_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    done, warnings = apply_cleaning(df, [cast("d", "datetime")])
    return [None if r["d"] is None else str(r["d"]) for r in done.orderBy("i").collect()], warnings


@pytest.mark.parametrize(
    "texts, wanted",
    [
        (["3/4/24 1:05 PM", "12/31/99 12:00 am"], ["2024-03-04 13:05:00", "1999-12-31 00:00:00"]),
        (["13/4/2024", "3/4/2024"], ["2024-04-13 00:00:00", "2024-04-03 00:00:00"]),
        (["4/13/2024", "3/4/2024"], ["2024-04-13 00:00:00", "2024-03-04 00:00:00"]),
        (["3.4.2024", "30.4.24"], ["2024-04-03 00:00:00", "2024-04-30 00:00:00"]),
        (["99-12-31", "01-02-03"], ["1999-12-31 00:00:00", "2001-02-03 00:00:00"]),
        (["Tuesday, March 5th, 2024", "may 1 2024", "Jun. 2, 2024"], ["2024-03-05 00:00:00", "2024-05-01 00:00:00", "2024-06-02 00:00:00"]),
        (["5 Mar 2024 07:08", "05-Sept-2024"], ["2024-03-05 07:08:00", "2024-09-05 00:00:00"]),
        (["2024-03-05T07:08:09.123456789Z", "2024-03-05 07:08:09,5"], ["2024-03-05 07:08:09.123456", "2024-03-05 07:08:09.500000"]),
        (["20240305", "20240305070809", "20240305T070809"], ["2024-03-05 00:00:00", "2024-03-05 07:08:09", "2024-03-05 07:08:09"]),
        (["2024-01-05T10:00:00+02:00", "2024-01-05T10:00:00Z", "2024-01-05 10:00 -0800"], ["2024-01-05 08:00:00", "2024-01-05 10:00:00", "2024-01-05 18:00:00"]),
        (["2024", "2024-07"], ["2024-01-01 00:00:00", "2024-07-01 00:00:00"]),
        (["2024-02-30", "2024-02-28", "12:30", "x 2024-02-28", ""], [None, "2024-02-28 00:00:00", None, None, None]),
    ],
)
def test_formats_from_shapes(spark, texts, wanted):
    got, warnings = dates_of(spark, texts)
    assert got == wanted
    assert any("couldn't be parsed" in w for w in warnings) == (None in wanted)


def test_dates_do_not_depend_on_the_session_zone(spark):
    texts = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 01:30:00+00:00"]
    want = (["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 01:30:00"], dates_of(spark, texts)[1])
    assert len(want[1]) == 1 and "2 value(s) name no time zone" in want[1][0]
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert dates_of(spark, texts) == want
        df = spark.createDataFrame([(t,) for t in texts], "d string")
        for formats in (["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX"], None):
            done = df.select(parse_timestamp(df.d, formats).alias("d"))
            assert [str(d) for d in values(done, "d")] == want[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_category_survives_a_held_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, None)], "k string, x double")
    done, _ = apply_cleaning(df, [cast("k", "category"), {"type": "remove_duplicates"}, fill("x", "mean"), fill("k", "mode")])
    assert schema.is_category(done.schema["k"]) and sorted(done.collect()) == [("a", 1.0), ("a", 1.0)]


def test_text_mapping(people):
    done, _ = apply_cleaning(people, [{"type": "fix_text", "column": "name", "mapping": {" Oslo ": "Oslo", "zzz": "y"}}])
    assert sorted(values(done, "name")) == ["OSLO", "Oslo", "Oslo", "Rome", "oslo"]
    same, _ = apply_cleaning(people, [{"type": "fix_text", "column": "name", "mapping": {}}])
    assert sorted(values(same, "name")) == sorted(values(people, "name"))
    number, _ = apply_cleaning(people, [{"type": "fix_text", "column": "score", "mapping": {"1": "9"}}])
    assert sorted(values(number, "score")) == [6, 6, 11, 16, 21]


def test_large_mappings_are_joined(spark):
    df = spark.range(3000).select(F.format_string("v%d", F.col("id") % 1500).alias("t"))
    mapping = {f"v{i}": f"w{i}" for i in range(1000)}
    result = clean(df, [{"type": "fix_text", "column": "t", "mapping": mapping}])
    assert result.steps[0].kind == "replace_joined"
    counts = dict(result.table.groupBy(F.col("t").substr(1, 1).alias("k")).count().collect())
    assert counts == {"w": 2000, "v": 1000}


def test_suggested_operations_clean_the_table(people):
    ops = quality.suggest_operations(people, duplicates=True, outliers=["price"])
    assert [op["type"] for op in ops] == ["remove_duplicates", "fill_nulls", "remove_outliers", "fix_text"]
    done, _ = apply_cleaning(people, ops)
    assert set(values(done, "name")) <= {"oslo", "Rome"}
    assert quality.text_affected(done).count() == 0
    casted = quality.suggest_operations(people, casts={"score": "text"}, fills={"price": "skip"}, fix_text=False)
    assert casted == [{"type": "cast_type", "column": "score", "dtype": "text"}]


def test_empty_result_is_an_error(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    done, _ = apply_cleaning(df, [fill("x", "drop")])
    with pytest.raises(ValueError, match="remove all rows"):
        cleaning.require_rows(done)


def test_profile_of_a_cleaned_table(people):
    done, _ = apply_cleaning(people, [{"type": "remove_duplicates"}, cast("score", "category")])
    assert [r["column"] for r in profile.profile_columns(done).collect()] == ["price"]
