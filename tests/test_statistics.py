import pytest
from pyspark.sql import functions as F

from tabsieve.operators import association, profile, quality, report, schema
from tabsieve.operators.quantiles import exact_quantiles
from tabsieve.sources import writers


def one(df):
    return df.first().asDict()


def test_integer_column(people):
    s = one(profile.column_statistics(people, "score"))
    assert (s["count"], s["null_count"], s["unique"], s["mode"], s["min"], s["max"]) == (5, 0, 4, 6, 6, 21)
    assert (s["mean"], s["median"], s["std"], s["variance"]) == (12.0, 11.0, 6.5192, 42.5)
    assert (s["p25"], s["p75"], s["iqr"]) == (6.0, 16.0, 10.0)
    assert (s["skewness"], s["kurtosis"]) == (0.5414, -1.4879)
    assert isinstance(s["min"], int) and isinstance(s["mode"], int)


def test_column_with_missing_values(people):
    s = one(profile.column_statistics(people, "price"))
    assert (s["count"], s["null_count"], s["mean"], s["median"], s["p25"], s["p75"]) == (4, 1, 7.25, 4.0, 3.0, 8.25)


def test_unknown_and_text_columns_are_errors(people):
    with pytest.raises(ValueError, match="not found"):
        schema.require_numeric(people, "nope")
    with pytest.raises(ValueError, match="not numeric"):
        schema.require_numeric(people, "name")


def test_degenerate_columns(spark):
    df = spark.createDataFrame(
        [(1.5, None, True, 2), (1.5, None, False, None), (1.5, None, True, 4)],
        "same double, none double, flag boolean, gap int",
    )
    rows = {r["column"]: r.asDict() for r in profile.profile_columns(df).collect()}
    assert set(rows) == {"same", "none", "gap"}  # a boolean is no number
    assert (rows["same"]["std"], rows["same"]["skewness"], rows["same"]["kurtosis"]) == (0.0, 0.0, None)
    none = rows["none"]
    assert none["count"] == 0 and none["null_count"] == 3 and none["unique"] == 0
    assert all(none[k] is None for k in ("mode", "min", "max", "mean", "median", "std", "iqr"))
    assert (rows["gap"]["median"], rows["gap"]["std"], rows["gap"]["skewness"]) == (3.0, 1.4142, None)


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    s = one(profile.profile_columns(df))
    assert (s["median"], s["std"], s["variance"]) == (3.0, None, None)
    e = one(profile.profile_columns(df.where("x < 0")))
    assert e["count"] == 0 and e["null_count"] == 0 and e["median"] is None


def test_non_finite_values_are_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (3.0,)], "x double")
    s = one(profile.profile_columns(df))
    assert (s["count"], s["null_count"], s["max"], s["median"]) == (2, 2, 3.0, 2.0)


def test_mode_takes_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert one(profile.column_statistics(df, "v"))["mode"] == "a"


def test_large_integers_keep_their_digits(spark):
    big = 2**60
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,)], "id bigint")
    s = one(profile.column_statistics(df, "id"))
    assert (s["min"], s["max"], s["mode"], s["unique"]) == (big, big + 1, big + 1, 2)


def test_names_with_dots_quotes_and_letters(spark):
    df = spark.createDataFrame([(1, 0.1, "München"), (2, 0.2, "東京")], "`a.b` bigint, `θ``angle` double, `población` string")
    assert {r["column"] for r in profile.profile_columns(df).collect()} == {"a.b", "θ`angle"}
    assert association.correlations(df).first()["correlation"] == 1.0
    assert quality.duplicate_count(df).first()[0] == 0
    assert report.profile_text(df, ["a.b"]).count("\n") == 5
    assert writers.preview(df, ["a.b"]).count() == 2


def test_overview_and_types(people):
    assert one(schema.dataset_overview(people)) == {"n_rows": 5, "n_columns": 3, "n_numeric": 2, "n_text": 1}
    kinds = {r["column"]: r["logical_type"] for r in schema.column_types(people).collect()}
    assert kinds == {"name": "Text", "score": "Number", "price": "Number"}


def test_issues(people):
    found = quality.detect_issues(people, ["score", "name"])
    assert found["duplicates"].first()[0] == 1
    assert [r["name"] for r in found["duplicate_sample"].collect()] == [" Oslo ", " Oslo "]
    nulls = one(found["nulls"])
    assert (nulls["column"], nulls["null_count"], nulls["pct"], nulls["mean"], nulls["median"]) == ("price", 1, 20.0, 7.25, 4.0)
    assert (nulls["suggested"], nulls["suggested_value"]) == ("mean", "7.25")
    out = one(found["outliers"])
    assert (out["column"], out["outliers"], out["upper_bound"]) == ("price", 1, 16.125)
    assert one(found["text_affected"]) == {"column": "name", "groups": 1, "total_affected": 4}
    spelled = found["text_variants"].orderBy("variant").collect()
    assert [(r["key"], r["variant"], r["n"]) for r in spelled] == [
        ("oslo", " Oslo ", 2),
        ("oslo", "OSLO", 1),
        ("oslo", "oslo", 1),
    ]


def test_unicode_white_space_in_spellings(spark):
    df = spark.createDataFrame([("x",), ("\tX ",), ("　x\n",)], "v string")
    assert quality.text_affected(df).first()["total_affected"] == 3


def test_null_report_of_empty_column(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0)], "t string, x double")
    rows = {r["column"]: r for r in quality.null_report(df).collect()}
    assert rows["t"]["mode"] is None and rows["t"]["pct"] == 100.0 and rows["x"]["mean"] == 1.0


def test_rows_with_maps_are_refused(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    with pytest.raises(ValueError, match="map"):
        quality.duplicate_count(df)


def test_outlier_report_needs_four_values_and_a_spread(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (100.0, 1.0), (None, 1.0), (None, 90.0)], "few double, flat double")
    assert quality.outlier_report(df).count() == 0


def test_interpolated_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    got = exact_quantiles(df, {"x": (0.0, 0.25, 0.5, 0.75, 1.0)})["x"]
    assert list(got.values()) == [1.0, 1.75, 2.5, 3.25, 4.0]


def test_profile_text(people):
    lines = report.profile_text(people, ["score", "name"]).split("\n")
    assert lines[0] == "Dataset: 5 rows × 3 columns."
    assert lines[1] == "Columns: name, score, price."
    assert lines[3].startswith("- 'name' (categorical): 4 unique values, sample=[' Oslo ', ' Oslo ', 'oslo'")
    assert lines[4] == "- 'score' (numeric): min=6, max=21, mean=12, median=11, std=6.519, nulls=0"
    assert lines[5] == "- 'price' (numeric): min=3, max=18, mean=7.25, median=4, std=7.228, nulls=1"


def test_profile_lists_columns_beyond_the_detailed_ones(spark):
    df = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(43)])
    text = report.profile_text(df, ["c0"])
    assert "(+3 more columns not detailed here" in text and "c42" in text.split("\n")[1]
    kinds = [r["kind"] for r in report.dataset_profile(df, ["c0"], 40).orderBy("position").collect()]
    assert kinds == ["numeric"] * 40 + ["omitted"] * 3
    assert {r["kind"] for r in report.dataset_profile(df, ["c0"]).collect()} == {"numeric"}


def test_profile_of_an_all_missing_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x double, k int")
    assert "- 'x' (numeric): all values are null." in report.profile_text(df, ["k"])


def test_recommendations_for_time_and_text(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "b")], "x double, y double, date string, city string")
    rows = report.recommendations(df).collect()
    charts = [r["text"] for r in rows if r["kind"] == "visualization"]
    assert charts[2] == "Line Plot — ['x', 'y'] over time" and len(charts) == 5
    assert [r["text"] for r in rows if r["kind"] == "analysis"][-1] == "Value Counts — 'date'"


def test_report_markdown(people):
    text = report.report_markdown(people, ["score"])
    assert "- Rows: 5" in text and "- price: mean=7.25, std=7.228, min=3, max=18, nulls=1" in text
