"""DuckDB SQL with the rows each query must return."""

from __future__ import annotations

from tabsieve.checks.views import VIEWS, WIDE

ORACLE: dict[str, str] = {}


def _with(view: str, body: str) -> str:
    """The body after a WITH clause that defines the derived table."""
    body = body.strip()
    start = f"WITH {view} AS ({VIEWS[view].strip()})"
    return f"{start}, {body[5:]}" if body.startswith("WITH ") else f"{start} {body}"


def _near(x: str, digits: int = 4) -> str:
    """Rounded a little above the tie, where the last bits of a sum do not matter."""
    return f"round(({x}) + 1e-9, {digits})"


def _big(x: str, digits: int = 4) -> str:
    return f"CASE WHEN abs({x}) >= 1e6 THEN round(({x}) + 1e-4, 0) ELSE {_near(x, digits)} END"


def _skewness(c: str) -> str:
    return f"CASE WHEN count({c}) < 3 THEN NULL WHEN var_samp({c}) = 0 THEN 0.0 ELSE skewness({c}) END"


def _kurtosis(c: str) -> str:
    return f"CASE WHEN count({c}) < 4 THEN NULL WHEN var_samp({c}) = 0 THEN 0.0 ELSE kurtosis({c}) END"


def _statistics(source: str, c: str, label: bool = True, typed: str = "DOUBLE") -> str:
    mode = f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    d = f"CAST({c} AS DOUBLE)"
    quarter, three = f"quantile_cont({d}, 0.25)", f"quantile_cont({d}, 0.75)"
    name = f"'{c}' AS \"column\", " if label else ""
    return f"""
        SELECT {name}count({c}) AS count, count(*) - count({c}) AS null_count,
               count(DISTINCT {c}) AS "unique", CAST({mode} AS {typed}) AS mode,
               CAST(min({c}) AS {typed}) AS min, CAST(max({c}) AS {typed}) AS max,
               {_big(f"avg({d})")} AS mean, {_big(f"quantile_cont({d}, 0.5)")} AS median,
               {_big(f"stddev_samp({d})")} AS std, {_big(f"var_samp({d})")} AS variance,
               {_big(quarter)} AS p25, {_big(three)} AS p75, {_big(f"({three} - {quarter})")} AS iqr,
               {_big(_skewness(d))} AS skewness, {_big(_kurtosis(d))} AS kurtosis
        FROM {source}"""


def _profile(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(_statistics(source, c) for c in columns)


_LINEITEM = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
_GAPS = ["qty", "price", "disc", "supp", "fixed"]

# -- Sources and sinks -------------------------------------------------------------

_TOKENS = "('', '#N/A', 'NA', 'null', 'n/a')"
_READ = f"""
    SELECT o_orderkey, CAST(CASE WHEN cust IN {_TOKENS} THEN NULL ELSE cust END AS BIGINT) AS cust,
           CASE WHEN priority IN {_TOKENS} THEN NULL ELSE priority END AS priority
    FROM tokens"""
ORACLE["csv_round_trip"] = _with("tokens", _READ)
ORACLE["inferred_types"] = _with("tokens", _READ)
ORACLE["csv_text_kept"] = (
    "SELECT c_custkey, '  \"' || c_mktsegment || '\", é東京 ' AS \"población\" FROM customer"
)
ORACLE["json_round_trip"] = _with(
    "nulls", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, qty, price, flag FROM nulls"
)
ORACLE["missing_tokens"] = _with(
    "tokens",
    f"""
    SELECT o_orderkey, CASE WHEN cust IN {_TOKENS} THEN NULL ELSE cust END AS cust,
           CASE WHEN priority IN {_TOKENS} THEN NULL ELSE priority END AS priority
    FROM tokens""",
)
ORACLE["finite_values"] = _with(
    "not_finite", "SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM not_finite"
)
ORACLE["preview_rows"] = _with("nulls", "SELECT * FROM nulls ORDER BY l_orderkey, l_linenumber LIMIT 8")

# -- Schema, projection, filters ---------------------------------------------------

ORACLE["dataset_overview"] = (
    "SELECT count(*) AS n_rows, 6 AS n_columns, 3 AS n_numeric, 3 AS n_text FROM orders"
)
ORACLE["column_types"] = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count({c}) AS filled,
        CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'Text' WHEN 'BIGINT' THEN 'Number'
             WHEN 'DOUBLE' THEN 'Number' ELSE 'Date/Time' END AS logical_type FROM orders"""
    for i, c in enumerate(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    )
)
ORACLE["numeric_projection"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
ORACLE["text_projection"] = "SELECT p_name, p_brand, p_type FROM part"
ORACLE["complete_rows"] = _with("nulls", "SELECT * FROM nulls WHERE qty IS NOT NULL AND flag IS NOT NULL")
ORACLE["range_inside"] = _with("nulls", "SELECT * FROM nulls WHERE qty >= 10 AND qty <= 20")
ORACLE["range_outside"] = _with("nulls", "SELECT * FROM nulls WHERE qty < 10 OR qty > 20")

# -- Column statistics ---------------------------------------------------------------

ORACLE["profile_lineitem"] = _profile("lineitem", _LINEITEM)
ORACLE["profile_nullable"] = _with("wide_gaps", _profile("wide_gaps", _GAPS))
ORACLE["profile_events"] = _with("gaps", _profile("gaps", ["value"]))
ORACLE["statistics_integer"] = _statistics("documents", "n_chars", False, "BIGINT")
ORACLE["statistics_text"] = _with(
    "nulls",
    """
    SELECT count(flag) AS count, count(*) - count(flag) AS null_count, count(DISTINCT flag) AS "unique",
           (SELECT flag FROM nulls WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) AS mode
    FROM nulls""",
)
def _summary(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {_big(f"avg({c})")} AS mean, {_big(f"stddev_samp({c})")} AS std,
            {_big(f"CAST(min({c}) AS DOUBLE)")} AS min, {_big(f"CAST(max({c}) AS DOUBLE)")} AS max,
            count(*) - count({c}) AS nulls FROM {source}"""
        for c in columns
    )


ORACLE["numeric_summary"] = _summary("customer", ["c_custkey", "c_nationkey", "c_acctbal"])
ORACLE["report_summary"] = _summary("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
ORACLE["categorical_summary"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", count(*) - count({c}) AS nulls,
        (SELECT string_agg({c}, '|' ORDER BY c_custkey)
         FROM (SELECT * FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)) AS sample
        FROM customer"""
    for c in ["c_name", "c_mktsegment"]
)
ORACLE["value_counts"] = _with(
    "nulls", "SELECT flag AS value, count(*) AS n FROM nulls WHERE flag IS NOT NULL GROUP BY flag"
)
ORACLE["frequency_table"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY {c}"""
    for c in ["p_brand", "p_type", "p_size"]
)
ORACLE["mode_tie_break"] = """
    SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 1"""
ORACLE["quantiles_distributed"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS probability,
        {_big(f"quantile_cont(CAST({c} AS DOUBLE), {q})")} AS value FROM lineitem"""
    for c in ["l_extendedprice", "l_quantity", "l_orderkey"]
    for q in [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
)
ORACLE["quantiles_wide"] = _with(
    "wide_holes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS probability, {_big(f"quantile_cont({c}, {q})")} AS value FROM wide_holes"""
        for c in WIDE
        for q in [0.05, 0.25, 0.5, 0.75, 0.95]
    ),
)
ORACLE["average_ranks"] = _with(
    "gaps",
    """
    SELECT value, n, sum(n) OVER (ORDER BY value) - n + (n + 1) / 2.0 AS rank
    FROM (SELECT value, count(*) AS n FROM gaps WHERE value IS NOT NULL GROUP BY value)""",
)

# -- Quality -------------------------------------------------------------------------

ORACLE["duplicate_count"] = _with(
    "dups", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dups)) AS duplicates FROM dups"
)
ORACLE["duplicate_sample"] = _with(
    "dups",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity
    FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber, l_quantity) AS c FROM dups)
    WHERE c > 1 ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity LIMIT 6""",
)
ORACLE["null_report"] = _with(
    "nulls",
    """
    SELECT 'qty' AS "column", count(*) - count(qty) AS null_count,
           round(100.0 * (count(*) - count(qty)) / count(*), 1) AS pct,
           round(avg(qty), 4) AS mean, round(quantile_cont(qty, 0.5), 4) AS median, NULL AS mode,
           'mean' AS suggested, CAST(round(avg(qty), 4) AS VARCHAR) AS suggested_value
    FROM nulls
    UNION ALL
    SELECT 'flag', count(*) - count(flag), round(100.0 * (count(*) - count(flag)) / count(*), 1),
           NULL, NULL, any_value(m), 'mode', any_value(m)
    FROM nulls, (SELECT flag AS m FROM nulls WHERE flag IS NOT NULL
                 GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)""",
)


def _outliers(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""
        SELECT '{c}' AS "column", count(*) FILTER (CAST({c} AS DOUBLE) < lo OR CAST({c} AS DOUBLE) > hi) AS outliers,
               round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
               round(CAST(min({c}) AS DOUBLE), 4) AS col_min, round(CAST(max({c}) AS DOUBLE), 4) AS col_max
        FROM {source}, (
            SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, a, b
            FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a,
                         quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {source}))
        HAVING count({c}) >= 4 AND any_value(a) <> any_value(b) AND outliers > 0"""
        for c in columns
    )


ORACLE["outlier_report_events"] = _outliers("events", ["event_id", "user_id", "value"])
ORACLE["outlier_report_documents"] = _outliers("documents", ["doc_id", "n_chars"])
ORACLE["outlier_report_gaps"] = _with("gaps", _outliers("gaps", ["value"]))
ORACLE["text_variants"] = _with(
    "variants",
    """
    WITH counted AS (SELECT lower(trim(segment)) AS key, segment AS variant, count(*) AS n
                     FROM variants WHERE segment IS NOT NULL GROUP BY ALL)
    SELECT 'segment' AS "column", key, variant, n FROM counted
    WHERE key IN (SELECT key FROM counted GROUP BY key HAVING count(*) > 1)""",
)
ORACLE["text_affected"] = _with(
    "messy",
    """
    WITH counted AS (SELECT lower(trim(flag)) AS key, flag, count(*) AS n
                     FROM messy WHERE flag IS NOT NULL GROUP BY ALL),
         several AS (SELECT key, sum(n) AS n FROM counted GROUP BY key HAVING count(*) > 1)
    SELECT 'flag' AS "column", count(*) AS groups, CAST(sum(n) AS BIGINT) AS total_affected FROM several""",
)
ORACLE["suggested_operations"] = _with(
    "messy",
    """
    WITH facts AS (
        SELECT (SELECT count(*) FROM messy) > (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS dup,
               (SELECT count(*) FROM messy WHERE qty IS NULL) > 0 AS q,
               (SELECT count(*) FROM messy WHERE flag IS NULL) > 0 AS f,
               (SELECT max(qty) > quantile_cont(qty, 0.75) + 1.5 * (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25))
                FROM messy) AS far,
               (SELECT count(DISTINCT flag) > count(DISTINCT lower(trim(flag))) FROM messy) AS spelled),
    ops AS (
        SELECT 1 AS o, 'remove_duplicates' AS type, NULL AS "column", NULL AS method FROM facts WHERE dup
        UNION ALL SELECT 2, 'fill_nulls', 'qty', 'mean' FROM facts WHERE q
        UNION ALL SELECT 3, 'fill_nulls', 'flag', 'mode' FROM facts WHERE f
        UNION ALL SELECT 4, 'remove_outliers', 'qty', NULL FROM facts WHERE far
        UNION ALL SELECT 5, 'fix_text', 'flag', NULL FROM facts WHERE spelled)
    SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS step, type, "column", method FROM ops""",
)

# -- Cleaning ------------------------------------------------------------------------

ORACLE["clean_dedup"] = _with("dups", "SELECT DISTINCT * FROM dups")
_KEEP = "l_orderkey, l_linenumber"


def _filled(value: str) -> str:
    return _with(
        "nulls",
        f"SELECT {_KEEP}, round(coalesce(qty, {value}) + 1e-9, 4) AS qty, round(price, 4) AS price, flag FROM nulls",
    )


ORACLE["fill_mean"] = _filled("(SELECT avg(qty) FROM nulls)")
ORACLE["fill_median"] = _filled("(SELECT quantile_cont(qty, 0.5) FROM nulls)")
ORACLE["fill_zero"] = _filled("0")
ORACLE["fill_mode"] = _with(
    "nulls",
    f"""
    SELECT {_KEEP}, round(price, 4) AS price,
           coalesce(qty, (SELECT qty FROM nulls WHERE qty IS NOT NULL
                          GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)) AS qty,
           coalesce(flag, (SELECT flag FROM nulls WHERE flag IS NOT NULL
                           GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag
    FROM nulls""",
)
ORACLE["fill_drop"] = _with("nulls", "SELECT * FROM nulls WHERE flag IS NOT NULL")
_FENCES = """
    SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi
    FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"""
ORACLE["remove_outliers"] = _with(
    "gaps",
    f"SELECT gaps.* FROM gaps, ({_FENCES.format(c='value', t='gaps')}) WHERE value >= lo AND value <= hi",
)
ORACLE["normalize_minmax"] = _with(
    "nulls",
    f"""
    SELECT {_KEEP}, qty, flag,
           round(1e-9 + (price - (SELECT min(price) FROM nulls))
                 / ((SELECT max(price) FROM nulls) - (SELECT min(price) FROM nulls)), 6) AS price
    FROM nulls""",
)
ORACLE["normalize_zscore"] = _with(
    "nulls",
    f"""
    SELECT {_KEEP}, price, flag,
           round(1e-9 + (qty - (SELECT avg(qty) FROM nulls)) / (SELECT stddev_samp(qty) FROM nulls), 6) AS qty
    FROM nulls""",
)
ORACLE["fix_text"] = _with(
    "variants",
    """
    SELECT c_custkey, CASE segment WHEN ' BUILDING ' THEN 'building' WHEN 'BUILDING' THEN 'building'
                                   WHEN 'furniture' THEN 'FURNITURE' ELSE segment END AS segment
    FROM variants""",
)
ORACLE["fix_text_found"] = _with("variants", "SELECT c_custkey, lower(trim(segment)) AS segment FROM variants")
ORACLE["cast_numeric"] = _with(
    "money",
    r"""
    SELECT p_partkey, TRY_CAST(regexp_replace(regexp_replace(trim(amount), '[,$%]', '', 'g'),
                                              '^\((.+)\)$', '-\1') AS DOUBLE) AS amount
    FROM money""",
)
ORACLE["cast_numeric_warning"] = _with(
    "money",
    """
    SELECT 1 AS line, 'Cast ''amount'' to number: ' || count(*) ||
           ' value(s) couldn''t be parsed as numbers and were set to null.' AS text
    FROM money WHERE amount = 'n/a'
    UNION ALL
    SELECT 2, 'Fill nulls (mean) skipped on ''p_partkey'' — column is not numeric.'""",
)
_DAYS = "SELECT event_id, try_strptime(day, '%Y-%m-%d') AS day FROM dates"
ORACLE["cast_datetime"] = _with("dates", _DAYS)
ORACLE["cast_datetime_iso"] = _with("dates", _DAYS)
ORACLE["cast_datetime_us"] = _with("us_dates", "SELECT event_id, try_strptime(day, '%m/%d/%Y') AS day FROM us_dates")
ORACLE["cast_datetime_warning"] = _with(
    "us_dates",
    """
    SELECT 1 AS line, 'Cast ''day'' to datetime: ' || count(*) ||
           ' value(s) couldn''t be parsed as dates and were set to null.' AS text
    FROM us_dates WHERE day = 'soon'""",
)
ORACLE["cast_datetime_shapes"] = """
    SELECT event_id, date_trunc('minute', ts) AS us_clock, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS spoken,
           date_trunc('minute', ts) + to_milliseconds(30000 + event_id % 900 + 100) AS fraction,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) AS packed,
           CASE WHEN event_id % 10 <> 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS days_first
    FROM events"""
ORACLE["cast_datetime_offsets"] = """
    SELECT event_id,
           date_trunc('second', ts) - CASE event_id % 5 WHEN 1 THEN INTERVAL 2 HOUR WHEN 2 THEN INTERVAL '-330' MINUTE
                                                        WHEN 3 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS at,
           date_trunc('second', ts) - CASE event_id % 3 WHEN 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS mixed
    FROM events"""
ORACLE["cast_datetime_lost"] = """
    SELECT 1 AS line, 'Cast ''days_first'' to datetime: ' || count(*) ||
           ' value(s) couldn''t be parsed as dates and were set to null.' AS text
    FROM events WHERE event_id % 10 = 0
    UNION ALL
    SELECT 2, 'Cast ''mixed'' to datetime: ' || count(*) || ' value(s) name no time zone and were taken as UTC like the others.'
    FROM events WHERE event_id % 3 <> 0"""
ORACLE["cast_text"] = """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice,
           o_orderdate, o_orderpriority FROM orders"""
ORACLE["cast_category"] = f"""
    SELECT 'p_partkey' AS "column", count(p_partkey) AS count, {_big("avg(p_partkey)")} AS mean FROM part
    UNION ALL
    SELECT 'p_retailprice', count(p_retailprice), {_big("avg(p_retailprice)")} FROM part"""
_CHAIN = f"""
    WITH once AS (SELECT DISTINCT * FROM messy),
         filled AS (
            SELECT l_orderkey, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM once)) AS qty,
                   coalesce(flag, (SELECT flag FROM once WHERE flag IS NOT NULL
                                   GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag
            FROM once),
         near AS (SELECT filled.* FROM filled, ({_FENCES.format(c='qty', t='filled')})
                  WHERE qty >= lo AND qty <= hi)"""
ORACLE["clean_chain"] = _with(
    "messy",
    f"""{_CHAIN.strip()}
    SELECT l_orderkey,
           round(1e-9 + (qty - (SELECT min(qty) FROM near))
                 / ((SELECT max(qty) FROM near) - (SELECT min(qty) FROM near)), 6) AS qty,
           CASE flag WHEN 'a' THEN 'A' WHEN 'A ' THEN 'A' WHEN 'n' THEN 'N' WHEN 'N ' THEN 'N' ELSE flag END AS flag
    FROM near""",
)
ORACLE["clean_report"] = _with(
    "messy",
    f"""{_CHAIN.strip()}
    SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed, 3 AS columns_before, 3 AS columns_after,
           'Normalize skipped on ''flag'' — column is not numeric.' AS warnings
    FROM (SELECT (SELECT count(*) FROM messy) AS b, (SELECT count(*) FROM near) AS a)""",
)

# -- Association ---------------------------------------------------------------------


def _pairs(columns: list[str]) -> list[tuple[int, str, str]]:
    both = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return [(i, a, b) for i, (a, b) in enumerate(both)]


def _pearson(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r,
            count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"""
        for i, a, b in _pairs(columns)
    )


def _spearman(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{a}' AS column_a, '{b}' AS column_b, corr(ra, rb) AS r, count(*) AS n
            FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
                  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a, b in _pairs(columns)
    )


def _ranked(pairs: str, rank: bool = True) -> str:
    number = "CAST(row_number() OVER (ORDER BY abs(round(r, 4)) DESC, pos) AS INTEGER) AS rank, " if rank else ""
    return f"""
    SELECT {number}column_a, column_b, round(r, 4) AS correlation, n
    FROM ({pairs}) WHERE n >= 2 AND r IS NOT NULL AND NOT isnan(r)"""


ORACLE["pearson_pairs"] = _ranked(_pearson("lineitem", _LINEITEM), rank=False)
ORACLE["spearman_pairs"] = _ranked(_spearman("lineitem", _LINEITEM), rank=False)
ORACLE["pearson_gaps"] = _with("wide_gaps", _ranked(_pearson("wide_gaps", _GAPS)))
ORACLE["spearman_gaps"] = _with("wide_gaps", _ranked(_spearman("wide_gaps", _GAPS)))
# The tail of Student's t with v degrees of freedom, with sin(u) = r:
# the integral of cos(u)^(v - 1) from asin|r| to pi/2, over that from 0 (Simpson's rule).
ORACLE["p_values"] = f"""
    WITH pairs AS ({_pearson("events", ["event_id", "user_id", "value"])}),
    nodes AS (SELECT CAST(i AS DOUBLE) / 40000 AS s, CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
              FROM range(40001) t(i)),
    areas AS (
        SELECT pos, any_value(column_a) AS column_a, any_value(column_b) AS column_b, any_value(r) AS r, any_value(n) AS n,
               sum(w * power(greatest(cos(asin(abs(r)) + s * (pi() / 2 - asin(abs(r)))), 0), n - 3))
                   * (pi() / 2 - asin(abs(any_value(r)))) AS tail,
               sum(w * power(greatest(cos(s * pi() / 2), 0), n - 3)) * (pi() / 2) AS whole
        FROM pairs, nodes GROUP BY pos)
    SELECT CAST(row_number() OVER (ORDER BY abs(round(r, 4)) DESC, pos) AS INTEGER) AS rank, column_a, column_b,
           round(r, 4) AS correlation, round(tail / whole, 6) AS p_value, n
    FROM areas"""
ORACLE["p_values_spearman"] = ORACLE["p_values"].replace(
    _pearson("events", ["event_id", "user_id", "value"]), _spearman("events", ["event_id", "user_id", "value"])
)
ORACLE["pearson_wide"] = _with("wide", _ranked(_pearson("wide", WIDE), rank=False))
ORACLE["spearman_wide"] = _with("wide", _ranked(_spearman("wide", WIDE[:14]), rank=False))
ORACLE["pearson_gaps_wide"] = _with("wide_holes", _ranked(_pearson("wide_holes", WIDE), rank=False))
ORACLE["spearman_gaps_wide"] = _with("wide_holes", _ranked(_spearman("wide_holes", WIDE[:20]), rank=False))
ORACLE["spearman_empty_columns"] = _with("empty_column", _ranked(_spearman("empty_column", ["qty", "price"])))
ORACLE["corr_matrix"] = _with(
    "wide_gaps",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS col,
            {"CASE WHEN var_pop(" + a + ") > 0 THEN 1.0 END" if a == b else
             f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END"} AS r FROM wide_gaps"""
        for a in _GAPS
        for b in _GAPS
    ),
)
_FIT = """
    CAST(regr_count({y}, {x}) AS BIGINT) AS n, round(regr_r2({y}, {x}), 4) AS r2_score, round(regr_slope({y}, {x}), 4) AS coefficient,
    round(regr_intercept({y}, {x}), 4) AS intercept,
    round(sqrt((regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x})) / regr_count({y}, {x})), 4) AS rmse"""
ORACLE["linear_regression"] = _with(
    "nulls", f"SELECT {_FIT.format(y='price', x='qty').replace(', 4)', ' + 1e-9, 4)')} FROM nulls"
)
ORACLE["regression_report"] = f"""
    SELECT *, 'For each unit increase in ''l_quantity'', ''l_extendedprice'' '
              || CASE WHEN coefficient > 0 THEN 'increases' ELSE 'decreases' END
              || printf(' by %.4f. The model explains %.1f%% of variance (', abs(slope), 100 * r2)
              || CASE WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.4 THEN 'moderate' ELSE 'weak' END || ' fit).' AS interpretation
    FROM (SELECT {_FIT.format(y='l_extendedprice', x='l_quantity')},
                 regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r2
          FROM lineitem)"""
ORACLE["regression_report"] = ORACLE["regression_report"].replace(
    "SELECT *, 'For", "SELECT n, r2_score, coefficient, intercept, rmse, 'For"
)

# -- Chart data ----------------------------------------------------------------------


def _series(y: str, cells: int) -> str:
    return f"""
    WITH p AS (SELECT CAST(event_id AS DOUBLE) AS x, {y} AS y FROM gaps WHERE {y} IS NOT NULL),
         s AS (SELECT min(x) AS lo, max(x) AS hi FROM p)
    SELECT CAST(least(floor((x - lo) / (hi - lo) * {cells}), {cells - 1}) AS INTEGER) AS bucket,
           round(min(x) + 1e-9, 4) AS x_min, round(max(x), 4) AS x_max, count(*) AS n,
           round(min(y), 4) AS min, round(avg(y) + 1e-9, 4) AS avg, round(max(y) + 1e-9, 4) AS max
    FROM p, s GROUP BY bucket"""


ORACLE["line_series"] = _with("gaps", _series("value", 100))
ORACLE["area_series"] = _with("gaps", _series("coalesce(value, 0)", 100))
ORACLE["line_series_time"] = """
    WITH p AS (SELECT CAST(epoch_us(ts) AS DOUBLE) AS x, value AS y FROM events),
         s AS (SELECT min(x) AS lo, max(x) AS hi FROM p)
    SELECT CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bucket, count(*) AS n,
           round(avg(y) + 1e-9, 4) AS avg, round(max(y) + 1e-9, 4) AS max
    FROM p, s GROUP BY bucket"""


def _bins(source: str, c: str, whole: bool) -> str:
    """Bin count, width and range by the 'auto' rule."""
    raw = "least(greatest(2 * iqr / cbrt(n), spread / sqrt(n) / 2), spread / (log2(n) + 1))"
    width = f"greatest({raw}, 1)" if whole else raw
    return f"""
    WITH d AS (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL),
         a AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, max(v) - min(v) AS spread,
                      quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM d),
         b AS (SELECT *, CAST(ceil(spread / ({width})) AS BIGINT) AS k FROM a)"""


def _histogram(source: str, c: str, whole: bool) -> str:
    return f"""{_bins(source, c, whole).strip()},
         e AS (SELECT i AS bin, lo + i * (spread / k) AS l, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * (spread / k) END AS h
               FROM b, range(100000) t(i) WHERE i < k)
    SELECT bin, {_big("any_value(l)")} AS lo, {_big("any_value(h)")} AS hi, count(v) AS n
    FROM e LEFT JOIN d ON v >= l AND (v < h OR (v = h AND bin = (SELECT k - 1 FROM b)))
    GROUP BY bin"""


ORACLE["histogram_auto"] = _histogram("events", "value", False)
ORACLE["histogram_integers"] = _histogram("part", "p_size", True)
ORACLE["bar_top20"] = """
    SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20"""
ORACLE["pie_share_top10"] = """
    SELECT value, n, round(100.0 * n / sum(n) OVER (), 1) AS share
    FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 10)"""
ORACLE["box_stats"] = _with(
    "gaps",
    f"""
    SELECT count(value) AS n, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median,
           round(quantile_cont(value, 0.75), 4) AS p75,
           round(min(value) FILTER (value >= lo AND value <= hi), 4) AS whisker_low,
           round(max(value) FILTER (value >= lo AND value <= hi), 4) AS whisker_high,
           count(*) FILTER (value < lo OR value > hi) AS outliers
    FROM gaps, ({_FENCES.format(c='value', t='gaps')})""",
)
ORACLE["box_outliers"] = _with(
    "gaps",
    f"""
    SELECT value, count(*) AS n FROM gaps, ({_FENCES.format(c='value', t='gaps')})
    WHERE value < lo OR value > hi GROUP BY value""",
)
ORACLE["scatter_sample"] = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice AS y FROM lineitem
    ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_orderkey, l_linenumber, l_partkey, x, y LIMIT 500"""
ORACLE["box_outlier_sample"] = _with(
    "gaps",
    f"""
    SELECT event_id, value FROM gaps, ({_FENCES.format(c='value', t='gaps')})
    WHERE value < lo OR value > hi ORDER BY md5('3:' || event_id) LIMIT 100""",
)


def _sketched(table: str, numbers: list[str], others: list[str], more: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls,
            {f"CAST(min({c}) AS DOUBLE)" if c in numbers else "CAST(NULL AS DOUBLE)"} AS low,
            {f"CAST(max({c}) AS DOUBLE)" if c in numbers else "CAST(NULL AS DOUBLE)"} AS high,
            TRUE AS distinct_close, TRUE AS quartiles_close {more} FROM {table}"""
        for c in numbers + others
    )


ORACLE["approx_profile"] = _sketched("events", ["event_id", "user_id", "value"], ["ts", "event_type", "props"])
ORACLE["approx_profile_merged"] = _sketched("lineitem", ["l_orderkey", "l_quantity"], ["l_returnflag"], ", TRUE AS each_file_once")
ORACLE["line_points"] = _with(
    "gaps", "SELECT CAST(event_id AS DOUBLE) AS x, value AS y FROM gaps WHERE value IS NOT NULL"
)
ORACLE["area_points"] = _with("gaps", "SELECT CAST(event_id AS DOUBLE) AS x, coalesce(value, 0) AS y FROM gaps")
ORACLE["scatter_data"] = "SELECT count(*) AS n, CAST(user_id AS DOUBLE) AS x, value AS y FROM events GROUP BY ALL"
ORACLE["scatter_points"] = """
    SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL"""
ORACLE["scatter_grid"] = f"""
    WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                      max(l_extendedprice) AS y1 FROM lineitem)
    SELECT CAST(least(floor((l_quantity - x0) / (x1 - x0) * 20), 19) AS INTEGER) AS x_bin,
           CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 20), 19) AS INTEGER) AS y_bin,
           count(*) AS n, {_big("avg(l_quantity)")} AS x, {_big("avg(l_extendedprice)")} AS y
    FROM lineitem, s GROUP BY x_bin, y_bin"""


def _density(source: str, c: str, extend: int) -> str:
    """The exact kernel density: every value counts at its own place."""
    return f"""
    WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL),
         k AS (SELECT count(*) AS m, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*), -0.2) AS h FROM v),
         c AS (SELECT v, count(*) AS n FROM v GROUP BY v),
         g AS (SELECT CAST(i AS INTEGER) AS point,
                      (lo - {extend} * h) + i * ((hi + {extend} * h - (lo - {extend} * h)) / 199) AS x
               FROM k, range(200) t(i)),
         f AS (SELECT point, any_value(x) AS x, sum(n * exp(-0.5 * ((x - v) / h) ** 2)) / any_value(m * h * sqrt(2 * pi())) AS density
               FROM g, c, k GROUP BY point)"""


ORACLE["density_curve"] = _with(
    "gaps",
    f"{_density('gaps', 'value', 0).strip()} SELECT point, round(x, 4) AS x, round(density, 7) AS density FROM f",
)
ORACLE["violin_curve"] = (
    f"{_density('documents', 'n_chars', 2)} SELECT point, round(x, 3) AS x, round(density, 9) AS density FROM f"
)
ORACLE["histogram_curve"] = _with(
    "gaps",
    f"""{_density('gaps', 'value', 0).strip()},
        bins AS (SELECT n * spread / k AS area FROM ({_bins('gaps', 'value', False)} SELECT n, spread, k FROM b))
        SELECT point, round(density * area, 2) AS height FROM f, bins""",
)

# -- Reports -------------------------------------------------------------------------

ORACLE["recommendations"] = """
    SELECT kind, CAST(rank AS INTEGER) AS rank, text, n_rows FROM (SELECT count(*) AS n_rows FROM documents), (VALUES
        ('visualization', 1, 'Histogram — distribution of [''doc_id'', ''n_chars'']'),
        ('visualization', 2, 'Scatter Plot — doc_id vs n_chars'),
        ('visualization', 3, 'Box Plot — outliers in [''doc_id'', ''n_chars'']'),
        ('visualization', 4, 'Heatmap — correlation matrix'),
        ('visualization', 5, 'Bar Chart — frequency of ''text'''),
        ('analysis', 1, 'Linear Regression — doc_id vs n_chars'),
        ('analysis', 2, 'Statistical Summary — [''doc_id'', ''n_chars'']'),
        ('analysis', 3, 'Value Counts — ''text''')) t(kind, rank, text)"""


def _profile_rows(source: str, columns: list[tuple[str, bool]], order: str) -> str:
    parts = []
    for i, (c, numeric) in enumerate(columns):
        d = f"CAST({c} AS DOUBLE)"
        if numeric:
            parts.append(f"""
            SELECT {i} AS position, '{c}' AS "column", 'numeric' AS kind, {_big(f"min({d})")} AS min, {_big(f"max({d})")} AS max,
                   {_big(f"avg({d})")} AS mean, {_big(f"quantile_cont({d}, 0.5)")} AS median,
                   {_big(f"stddev_samp({d})")} AS std, NULL AS "unique", '' AS sample, count(*) - count({c}) AS nulls
            FROM {source}""")
        else:
            parts.append(f"""
            SELECT {i}, '{c}', 'categorical', NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
                   (SELECT string_agg(CAST(s AS VARCHAR), '|' ORDER BY o)
                    FROM (SELECT {c} AS s, {order} AS o FROM {source} WHERE {c} IS NOT NULL ORDER BY o LIMIT 5)),
                   count(*) - count({c}) FROM {source}""")
    return " UNION ALL ".join(parts)


ORACLE["dataset_profile"] = _with(
    "gaps",
    _profile_rows("gaps", [("event_id", True), ("ts", False), ("event_type", False), ("value", True)], "event_id"),
)


def _text_line(i: int, c: str, numeric: bool) -> str:
    if numeric:
        parts = [
            ("min", f"min({c})"),
            ("max", f"max({c})"),
            ("mean", f"avg({c})"),
            ("median", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"),
            ("std", f"stddev_samp({c})"),
        ]
        made = " || ', ' || ".join(f"'{n}=' || format('{{:.4g}}', CAST({e} AS DOUBLE))" for n, e in parts)
        return f"""SELECT {i}, '- ''{c}'' (numeric): ' || {made} || ', nulls=' || (count(*) - count({c})) FROM customer"""
    return f"""SELECT {i}, '- ''{c}'' (categorical): ' || count(DISTINCT {c}) || ' unique values, sample=['
        || (SELECT string_agg('''' || {c} || '''', ', ' ORDER BY c_custkey)
            FROM (SELECT * FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5))
        || '], nulls=' || (count(*) - count({c})) FROM customer"""


ORACLE["profile_text"] = """
    SELECT 1 AS line, 'Dataset: ' || format('{:,}', count(*)) || ' rows × 5 columns.' AS text FROM customer
    UNION ALL SELECT 2, 'Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment.'
    UNION ALL SELECT 3, ''
    UNION ALL """ + " UNION ALL ".join(
    _text_line(i, c, n)
    for i, (c, n) in enumerate(
        [("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False)], 4
    )
)

ORACLE["profile_wide"] = _with(
    "wide",
    " UNION ALL ".join(
        f"""SELECT {k} AS position, '{c}' AS "column", 'numeric' AS kind, min({v}) AS min, max({v}) AS max, 0 AS nulls FROM wide"""
        for k, (c, v) in enumerate([*((c, c) for c in WIDE), *((f"m{c}", f"-{c}") for c in WIDE)])
    ),
)
ORACLE["profile_text_nested"] = """
    SELECT '- ''embedding'' (array): nested, nulls=' || count(*) FILTER (vec_id % 5 = 0) AS text FROM embeddings"""
ORACLE["report_overview"] = "SELECT count(*) AS n_rows, 4 AS n_columns FROM supplier"
ORACLE["report_markdown"] = """
    SELECT unnest(['# Analysis report', '## Dataset overview', '- Rows: ' || format('{:,}', count(*)), '## Data profile',
                   '## Numeric column summary']) AS text FROM supplier"""
ORACLE["errors"] = """
    SELECT call, text, (SELECT count(*) FROM supplier) AS n_rows FROM (VALUES
        ('chart', 'Unknown chart type: Sankey'),
        ('column', 'Column ''s_none'' not found.'),
        ('empty', 'Cleaning would remove all rows. Relax your settings and try again.'),
        ('heat map', 'Need at least 2 numeric columns for a heat map.'),
        ('operation', 'Unknown operation type ''shuffle''.'),
        ('text', 'Column ''s_name'' is not numeric.')) t(call, text)"""
ORACLE["csv_line_breaks"] = _with("broken_lines", "SELECT c_custkey, note FROM broken_lines")
ORACLE["csv_rejected"] = """
    SELECT count(*) || ' row(s) have more than 2 cells.' AS text FROM supplier WHERE s_suppkey % 5 = 0"""
ORACLE["csv_nested"] = """
    SELECT s_suppkey, '[' || s_nationkey || ',' || s_suppkey || ']' AS keys, '{"nation":' || s_nationkey || '}' AS place
    FROM supplier"""
ORACLE["json_array"] = "SELECT s_suppkey, s_name FROM supplier"
ORACLE["json_key_order"] = """
    SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance, 's_suppkey,name,balance' AS columns
    FROM supplier"""
ORACLE["json_mixed"] = """
    SELECT s_suppkey, s_name, CAST(NULL AS INTEGER) AS s_nationkey FROM supplier
    UNION ALL SELECT s_suppkey + 1000000, NULL, s_nationkey FROM supplier"""
ORACLE["orc_round_trip"] = _with("gaps", "SELECT * FROM gaps")

# -- Streaming -----------------------------------------------------------------------

ORACLE["stream_cleaned"] = f"""
    WITH kept AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS event_type, value
                  FROM events, ({_FENCES.format(c='value', t='events')}) WHERE value >= lo AND value <= hi)
    SELECT event_id, event_type,
           round(1e-9 + (value - (SELECT min(value) FROM kept)) / ((SELECT max(value) FROM kept) - (SELECT min(value) FROM kept)), 6) AS value
    FROM kept"""
