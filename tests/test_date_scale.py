"""Dates at scale: cheap conditions change no result, and texts are counted by their skeletons."""

import pytest
from pyspark.sql import functions as F

from tabsieve.functions import dates

ODD = [
    "Monday, March 3rd, 2024", "  thurs. Sept. 21st 2024 ", " Aug. 2, 2024\x85", "3 Jan 2024 5:06 a.m.", "3/4/24 5:06:07,1234567891 PM",
    "2024-01-02T03:04:05-0530", "2024-01-02 03:04 GMT+2", "2024-01-02 03:04:05 utc", "2024-01-02\t 03:04:05 +09", "2024-01-02 3:04z", "20240102",
    "31/02/2024", "1.2.2024 3:04:05.6", "stuff 12:30", "2nd", "", "1" * 200, "2024-01-02" + " " * 100 + "03:04", "2024\n-1", "+12024-01-02", "0.5.0 MON", "SAT", "5-Sept.-2024",
]


def test_prepared_texts_are_the_same_by_stages(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = dates.prepared_columns(df, {"u": F.col("t")}).select("u", dates.prepared(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_texts_are_counted_by_skeletons(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    found = {r["shape"]: r["n"] for r in dates.shape_counts(df, ["t"])["t"]}
    each = df.select(dates.shape(dates.prepared(F.col("t"))).alias("s")).groupBy("s").count().collect()
    assert found == {r["s"]: r["count"] for r in each}


@pytest.mark.parametrize("fmt", ["yyyy-M-d", "yyyyMMddHHmmss", "MMMM d, yyyy", "d.M.yyyy H:m:s.SSSSSSSSS", "M/d/yy h:m:s a", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d H:mXXX", "d/M/yyyy", "yyyy"])
def test_conditions_before_parsing_lose_nothing(spark, fmt):
    more = ["MARCH 3, 2024", "march 3, 2024", "1.2.2024 3:04:05.6", "3/4/24 5:06:07 PM", "2024-01-02T03:04:05+05:30", "2024-01-02t03:04:05Z", "2024-1-2 3:04Z", "20240102030405", "-2024-1-2", "+12024-01-02"]
    df = spark.createDataFrame([(t,) for t in ODD + more], "t string")
    rows = df.select(dates.parsed(F.col("t"), fmt).cast("string"), dates._parsed(F.col("t"), fmt).cast("string")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_texts_of_other_kinds_are_no_failures(spark):
    # A failure to parse costs twenty times the condition.
    shown = spark.range(1).select(dates.parsed(F.col("id").cast("string"), "yyyy-M-d H:m:s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in shown.upper()
