import math

import pytest
from pyspark.sql import functions as F

from tabsieve.functions.student import correlation_p_value
from tabsieve.operators import association


def test_pearson_and_spearman_by_hand(people):
    p = association.correlations(people).first()
    assert (p["column_a"], p["column_b"], p["correlation"], p["p_value"], p["n"]) == ("score", "price", 0.8531, 0.146885, 4)
    s = association.correlations(people, "spearman").first()
    assert (s["correlation"], s["p_value"], s["n"]) == (1.0, 0.0, 4)
    with pytest.raises(ValueError):
        association.correlations(people, "bogus")


def test_constant_and_sparse_columns_are_left_out(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, 1.0), (2.0, 5.0, None, 4.0), (3.0, 5.0, 1.0, 9.0)], "a double, same double, rare double, b double"
    )
    for method in association.METHODS:
        rows = association.correlations(df, method).collect()
        assert [(r["column_a"], r["column_b"]) for r in rows] == [("a", "b")]


def test_two_points(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert association.correlations(df).first()["p_value"] == 1.0
    assert association.correlations(df, "spearman").first()["p_value"] is None


def test_order_of_equal_strengths(spark):
    df = spark.range(5).select(*[(F.col("id") * k).cast("double").alias(n) for n, k in (("c", 1), ("a", -2), ("b", 3))])
    rows = association.correlations(df).collect()
    assert [(r["rank"], r["column_a"], r["column_b"], r["correlation"]) for r in rows] == [
        (1, "c", "a", -1.0),
        (2, "c", "b", 1.0),
        (3, "a", "b", -1.0),
    ]


def test_matrix(spark, people):
    cells = {(r["row"], r["col"]): r["r"] for r in association.correlation_matrix(people).collect()}
    assert cells[("score", "score")] == 1.0 and cells[("score", "price")] == cells[("price", "score")]
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cells = {(r["row"], r["col"]): r["r"] for r in association.correlation_matrix(same).collect()}
    assert cells == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    with pytest.raises(ValueError, match="2 numeric"):
        association.correlation_matrix(people.select("name", "score"))


def test_many_pairs_take_several_scans(spark, monkeypatch, people):
    monkeypatch.setattr(association, "PAIRS_PER_SCAN", 2)
    df = spark.range(50).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(4)])
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in association.correlations(df).collect()}
    wide = df.toPandas().corr()
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r == pytest.approx(wide.loc[a, b], abs=5.1e-5)


def test_regression_by_hand(people):
    r = association.regression_report(people, "score", "price").first()
    assert (r["n"], r["coefficient"], r["intercept"], r["r2_score"], r["rmse"]) == (4, 0.8222, -2.8222, 0.7278, 3.266)
    assert r["interpretation"] == (
        "For each unit increase in 'score', 'price' increases by 0.8222. "
        "The model explains 72.8% of variance (strong fit)."
    )


def test_regression_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (1.0, 4.0, 7.0), (1.0, 6.0, 7.0)], "one double, y double, flat double")
    flat_x = association.linear_regression(df, "one", "y").first()
    assert (flat_x["coefficient"], flat_x["intercept"], flat_x["r2_score"]) == (0.0, 4.0, 0.0)
    assert flat_x["rmse"] == pytest.approx(math.sqrt(8 / 3))
    flat_y = association.linear_regression(df, "y", "flat").first()
    assert (flat_y["coefficient"], flat_y["r2_score"], flat_y["rmse"]) == (0.0, 1.0, 0.0)
    same = association.linear_regression(df, "y", "y").first()
    assert (same["coefficient"], same["intercept"], same["r2_score"]) == (1.0, 0.0, 1.0)
    with pytest.raises(Exception, match="at least 2"):
        association.linear_regression(df.limit(1), "y", "flat").collect()
    with pytest.raises(ValueError):
        association.linear_regression(df, "y", "nope")


@pytest.mark.parametrize(
    ("r", "n", "p"),
    [(0.5, 3, 2 / 3), (0.0, 10, 1.0), (1.0, 5, 0.0), (-0.3, 10, 0.3996914687), (0.1, 50, 0.4895925518), (0.9, 8, 0.00231625)],
)
def test_p_values(r, n, p):
    assert correlation_p_value(r, n) == pytest.approx(p, abs=1e-9)


def test_p_values_of_very_long_tables():
    for n in (10**7, 10**7 + 1, 10**12):
        assert correlation_p_value(2 / math.sqrt(n), n) == pytest.approx(math.erfc(math.sqrt(2)), abs=2e-6)
