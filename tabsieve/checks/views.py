"""Derived tables with missing values, duplicates, spellings and odd numbers.

The supplied tables are clean, so these views give the detectors and cleaning
operations something to do. Their text runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "nulls": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
               l_extendedprice AS price,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag
        FROM lineitem""",
    "dups": """
        SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1""",
    "variants": """
        SELECT c_custkey,
               CASE c_custkey % 3 WHEN 0 THEN c_mktsegment
                                  WHEN 1 THEN lower(c_mktsegment)
                                  ELSE ' ' || c_mktsegment || ' ' END AS segment
        FROM customer""",
    "money": """
        SELECT p_partkey,
               CASE p_partkey % 4
                 WHEN 0 THEN '$1,' || lpad(CAST(p_size AS STRING), 3, '0')
                 WHEN 1 THEN '(' || CAST(p_size AS STRING) || ')'
                 WHEN 2 THEN CAST(p_size AS STRING) || '%'
                 ELSE 'n/a' END AS amount
        FROM part""",
    "dates": """
        SELECT event_id,
               CASE WHEN event_id % 10 = 0 THEN 'not-a-date'
                    ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day
        FROM events""",
    "us_dates": """
        SELECT event_id,
               CASE WHEN event_id % 10 = 0 THEN 'soon'
                    ELSE concat(CAST(month(ts) AS STRING), '/', CAST(day(ts) AS STRING), '/', CAST(year(ts) AS STRING)) END AS day
        FROM events""",
    "shaped_dates": """
        SELECT event_id,
               concat(CAST(month(ts) AS STRING), '/', CAST(day(ts) AS STRING), '/', substr(CAST(year(ts) AS STRING), 3, 2), ' ',
                      CAST((hour(ts) + 11) % 12 + 1 AS STRING), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'),
                      CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' pm' END) AS us_clock,
               concat(CASE event_id % 2 WHEN 0 THEN 'Monday, ' ELSE '' END,
                      CASE month(ts) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
                                     WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
                                     WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END,
                      ' ', CAST(day(ts) AS STRING), CASE WHEN day(ts) IN (1, 21, 31) THEN 'st' ELSE '' END, ', ', CAST(year(ts) AS STRING)) AS spoken,
               concat(CAST(day(ts) AS STRING), '.', CAST(month(ts) AS STRING), '.', CAST(year(ts) AS STRING), ' ',
                      CAST(hour(ts) AS STRING), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':30.', CAST(event_id % 900 + 100 AS STRING)) AS fraction,
               concat(CAST(year(ts) AS STRING), lpad(CAST(month(ts) AS STRING), 2, '0'), lpad(CAST(day(ts) AS STRING), 2, '0')) AS packed,
               CASE WHEN event_id % 10 = 0 THEN '31/02/' ELSE concat(CAST(day(ts) AS STRING), '/', CAST(month(ts) AS STRING), '/') END
                   || CAST(year(ts) AS STRING) AS days_first
        FROM events""",
    "offset_dates": """
        SELECT event_id,
               concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8),
                      CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-0530' WHEN 3 THEN ' +09' ELSE ' UTC' END) AS at,
               concat(substr(CAST(ts AS STRING), 1, 19), CASE event_id % 3 WHEN 0 THEN '+01:00' ELSE '' END) AS mixed
        FROM events""",
    "broken_lines": """
        SELECT c_custkey, concat(c_name, CASE c_custkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN ', "' ELSE '' END, c_mktsegment) AS note
        FROM customer""",
    "empty_column": """
        SELECT l_quantity AS qty, l_extendedprice AS price, CAST(NULL AS DOUBLE) AS none FROM lineitem""",
    "gaps": """
        SELECT event_id, ts, event_type,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
        FROM events""",
    "wide_gaps": """
        SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
               l_extendedprice AS price,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS disc,
               l_suppkey AS supp,
               1.5 + 0 * l_tax AS fixed
        FROM lineitem""",
    "messy": """
        SELECT l_orderkey,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
               CASE WHEN l_linenumber = 3 THEN NULL
                    WHEN l_linenumber = 4 THEN lower(l_returnflag)
                    WHEN l_linenumber = 5 THEN l_returnflag || ' '
                    ELSE l_returnflag END AS flag
        FROM lineitem
        UNION ALL
        SELECT l_orderkey, 5000.0 AS qty, 'A' AS flag FROM lineitem WHERE l_linenumber = 7""",
    "tokens": """
        SELECT o_orderkey,
               CASE o_orderkey % 6
                 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN '#N/A'
                 ELSE CAST(o_custkey AS STRING) END AS cust,
               CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_orderpriority END AS priority
        FROM orders""",
    "not_finite": """
        SELECT event_id,
               CASE event_id % 9 WHEN 0 THEN CAST('NaN' AS DOUBLE)
                                 WHEN 1 THEN CAST('Infinity' AS DOUBLE)
                                 WHEN 2 THEN CAST('-Infinity' AS DOUBLE)
                                 ELSE value END AS value
        FROM events""",
}

# Thirty numeric columns.
WIDE = [f"c{k:02d}" for k in range(30)]
VIEWS["wide"] = (
    "SELECT "
    + ", ".join(
        f"CAST((l_orderkey * {2 * k + 3} + l_partkey * {k + 1} + l_linenumber) % {89 + k} AS DOUBLE) AS {c}"
        for k, c in enumerate(WIDE)
    )
    + " FROM lineitem"
)

# The same columns, each with gaps of its own.
VIEWS["wide_holes"] = (
    "SELECT "
    + ", ".join(
        f"CASE WHEN (l_orderkey * 7 + l_linenumber * {k + 1} + l_suppkey) % {k + 5} <> 0 THEN"
        f" CAST((l_orderkey * {2 * k + 3} + l_partkey * {k + 1} + l_linenumber) % {89 + k} AS DOUBLE) END AS {c}"
        for k, c in enumerate(WIDE)
    )
    + " FROM lineitem"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the derived tables, over the tables of ``folder``."""
    text = VIEWS[name]
    sources = sorted(set(re.findall(r"FROM (\w+)", text)))
    for source in sources:
        text = text.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{s: table(spark, folder, s) for s in sources})
