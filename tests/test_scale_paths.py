"""The code paths for large tables, forced on small ones, and plan checks."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import FOLDER, ROOT
from tabsieve.checks.views import table, view
from tabsieve.operators import association, chartdata, cleaning, frequency, profile, quality, quantiles, ranks, sketches
from tabsieve.plans import held
from tabsieve.plans import lookup as lookups


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_limits(monkeypatch):
    for module in (lookups, quality, association):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    # Only the mapping counts as large; its few hot values still fit.
    monkeypatch.setattr(cleaning, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(quantiles, "FETCH_ROWS", 4)
    monkeypatch.setattr(quantiles, "CELLS", 8)
    monkeypatch.setattr(quantiles, "INTERVALS_PER_PASS", 2)


def skewed(spark, n=3000):
    """A third of the rows share one value; the rest spans many magnitudes."""
    x = F.col("id")
    return spark.range(n).select(
        F.when(x % 3 == 0, 7.0).otherwise(F.exp((x % 83 - 40).cast("double")) * F.when(x % 2 == 0, 1).otherwise(-1)).alias("a"),
        F.when(x % 3 != 1, (x * 37 % 101).cast("double")).alias("b"),
        (x * x % 997).alias("c"),
    )


def test_quantiles_match_sorting(spark, small_limits):
    df = skewed(spark)
    shares = [0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1]
    got = quantiles.exact_quantiles(df, {c: shares for c in df.columns})
    wanted = df.toPandas().quantile(shares)
    for c in df.columns:
        assert list(got[c].values()) == pytest.approx(list(wanted[c]), rel=1e-12)


def test_many_quantiles_take_two_scans(spark, monkeypatch):
    x = F.col("id")
    df = spark.range(20_000).select(*[F.when(x % (k + 2) != 0, (x * (k + 3) * 7919 % 10_007).cast("double")).alias(f"c{k}") for k in range(40)])
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    calls, real = [], quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda *a: calls.append(real(*a)) or calls[-1])
    monkeypatch.setattr(quantiles, "_count_cells", lambda *a: pytest.fail("a sketch has missed a rank"))
    got = quantiles.exact_quantiles(df, {c: shares for c in df.columns})
    wanted = df.toPandas().quantile(shares)
    assert all(list(got[c].values()) == pytest.approx(list(wanted[c]), rel=1e-12) for c in df.columns)
    assert len(calls) == 1 and plan(calls[0]).split("Initial Plan")[0].count("Range (") == 1


def test_ranks_that_a_sketch_missed_are_found(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ERROR", -0.2)
    monkeypatch.setattr(quantiles, "INTERVALS_PER_PASS", 2)
    monkeypatch.setattr(quantiles, "FETCH_ROWS", 50)
    df = skewed(spark)
    got = quantiles.exact_quantiles(df, {c: [0.1, 0.5, 0.9] for c in df.columns})
    wanted = df.toPandas().quantile([0.1, 0.5, 0.9])
    assert all(list(got[c].values()) == pytest.approx(list(wanted[c]), rel=1e-12) for c in df.columns)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_order_statistics_of_any_doubles(spark, small_limits, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = quantiles.extents(df, ["x"])
    got = quantiles.order_statistics(df, {"x": range(len(values))}, known)
    assert [got[("x", i)] for i in range(len(values))] == sorted(values)


def test_ranks_over_many_buckets(spark):
    df = skewed(spark)
    got = {r["value"]: r["rank"] for r in ranks.rank_table(df, "a", bucket_values=10).collect()}
    pdf = df.toPandas()
    wanted = dict(zip(pdf["a"], pdf["a"].rank()))
    assert got == wanted


def test_spearman_with_shuffled_lookups(spark, small_limits):
    df = skewed(spark)
    got = {(r["column_a"], r["column_b"]): (r["correlation"], r["n"]) for r in association.correlations(df, "spearman").collect()}
    pdf = df.toPandas()
    for (a, b), (r, n) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both) and r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=5.1e-5)
    assert len(got) == 3


def holes(spark, columns, rows=400):
    """Columns with gaps of their own, one of them constant where another is present."""
    x = F.col("id")
    made = [F.when((x * (k + 3)) % (k + 4) != 1, (x * x * (k + 1) + x * 7) % (31 + k) + 1e6 * k).alias(f"c{k}") for k in range(columns)]
    return spark.range(rows).select(*made, F.when(x % 2 == 0, 5.0).when(x % 3 == 0, 6.0).alias("two"), F.when(x % 2 == 0, x * 1.0).alias("even"))


@pytest.mark.parametrize("method", association.METHODS)
def test_gaps_of_many_columns(spark, method, monkeypatch):
    df = holes(spark, 7)
    wanted = df.toPandas()
    # The ranks fit a broadcast, and then they do not.
    for limit in (1 << 20, 0) if method == "spearman" else (0,):
        monkeypatch.setattr(association, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", limit)
        got = {(r["column_a"], r["column_b"]): (r["correlation"], r["n"]) for r in association.correlations(df, method).collect()}
        assert len(got) == 35 and ("two", "even") not in got  # constant wherever the other one is present
        for (a, b), (r, n) in got.items():
            both = wanted[[a, b]].dropna()
            assert n == len(both) and r == pytest.approx((both.rank() if method == "spearman" else both)[[a, b]].corr().iloc[0, 1], abs=5.1e-5)


def test_gap_pairs_come_from_one_matrix(spark, monkeypatch):
    df, calls = holes(spark, 6).drop("two"), []
    real = association._gram_matrix
    monkeypatch.setattr(association, "_gram_matrix", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(association, "_pair_moments", lambda df, pairs: [] if not pairs else pytest.fail("pairs were computed one by one"))
    assert association.correlations(df).count() == 21 and calls == [1]


def test_spearman_in_place_writes_no_rows(spark, monkeypatch):
    labels = []
    real = association.hold
    monkeypatch.setattr(association, "hold", lambda df, label: labels.append(label) or real(df, label))
    association.correlations(holes(spark, 5), "spearman").collect()
    assert labels == ["counts", "ranks"]


def test_variants_with_one_key_of_many_spellings(spark, small_limits):
    word = F.expr("concat(repeat(' ', int(id % 500)), if(id % 2 = 0, 'Hot', 'hot'))")
    cold = F.format_string("v%d", F.col("id") % 700)
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, word).otherwise(cold).alias("t"))
    found = quality.text_variants(df)
    assert found.select("key").distinct().collect() == [("hot",)]
    assert found.agg(F.sum("n")).first()[0] == df.where("lower(trim(t)) = 'hot'").count()
    assert found.count() == df.where("lower(trim(t)) = 'hot'").distinct().count()


def test_large_mapping_with_hot_values(spark, small_limits):
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.format_string("v%d", "id")).alias("t")
    )
    mapping = spark.range(9000).select(F.format_string("v%d", "id").alias("value"), F.lit("cold").alias("replacement"))
    mapping = mapping.union(spark.createDataFrame([("hot", "warm")], "value string, replacement string"))
    done, _ = cleaning.apply_cleaning(df, [{"type": "fix_text", "column": "t", "mapping": mapping}])
    assert dict(done.groupBy("t").count().collect()) == {"warm": 3000, "cold": 3000, None: 3000}
    assert done.select("id").distinct().count() == 9000


def test_lookup_spreads_rows_without_key(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    left = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("x", 2)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookups.lookup(left, F.col("k"), right, "k", 2, right.where("k = 'hot'"))
        sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 8000 and max(sizes) < 4000
    assert out.where("v = 1").count() == left.where("k = 'hot'").count()


def test_frequencies_are_combined_before_the_shuffle(spark):
    found = plan(frequency.value_counts(table(spark, FOLDER, "lineitem"), "l_returnflag"))
    assert found.index("partial_count") > found.index("Exchange hashpartitioning")


def test_scans_read_only_the_needed_columns(spark):
    lineitem = table(spark, FOLDER, "lineitem")
    for df, wanted in (
        (frequency.top_values(lineitem, "l_returnflag", 3), "struct<l_returnflag:string>"),
        (association.linear_regression(lineitem, "l_quantity", "l_tax"), "struct<l_quantity:double,l_tax:double>"),
        (chartdata.scatter_grid(lineitem, "l_tax", "l_quantity"), "struct<l_quantity:double,l_tax:double>"),
    ):
        assert f"ReadSchema: {wanted}" in plan(df)


def test_range_filters_reach_the_scan(spark):
    from tabsieve.operators.schema import range_filter

    found = plan(range_filter(table(spark, FOLDER, "lineitem"), "l_linenumber", 2, 3))
    assert "PushedFilters: [IsNotNull(l_linenumber)" in found


def test_plans_stay_in_the_jvm_and_need_no_cross_join(spark):
    gaps, lineitem = view(spark, FOLDER, "gaps"), table(spark, FOLDER, "lineitem")
    dups = view(spark, FOLDER, "dups")
    frames = [
        quality.duplicate_count(dups),
        quality.duplicate_sample(dups, ["l_orderkey"]),
        quality.text_variants(view(spark, FOLDER, "variants")),
        chartdata.histogram(gaps, "value"),
        chartdata.density_curve(gaps, "value"),
        chartdata.box_stats(gaps, "value"),
        chartdata.line_series(gaps, "value", "ts"),
        chartdata.pie_shares(lineitem, "l_returnflag"),
        ranks.rank_table(gaps, "value", bucket_values=100),
        cleaning.apply_cleaning(dups, [{"type": "remove_duplicates"}])[0],
    ]
    for df in frames:
        found = plan(df)
        for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in found
        for line in found.splitlines():
            if "Window " in line:
                assert "windowspecdefinition(idx" in line  # partitioned by column and bucket


def test_profile_needs_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("profile", "profile")
    try:
        profile.profile_columns(table(spark, FOLDER, "lineitem")).collect()
        jobs = len(tracker.getJobIdsForGroup("profile"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 14


def test_density_curve_against_brute_force(spark):
    import numpy as np

    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(300)] + [25.0] * 150
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = chartdata.density_curve(df, "x").orderBy("point").toPandas()
    x = np.array(values)
    h = x.std(ddof=1) * len(x) ** -0.2
    wanted = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in got["x"]]
    assert np.abs(got["density"] - wanted).max() < 1e-4 * max(wanted)
    wide = chartdata.violin_curve(df, "x").orderBy("point").toPandas()
    area = np.trapezoid(wide["density"], wide["x"])
    assert area == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("limit", [0, 1000])
def test_mode_of_long_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(frequency, "BROADCAST_ROWS", limit)
    long = [chr(ord("z") - i) * 100 for i in range(6)]
    once = spark.createDataFrame([(t,) for t in long] + [(None,)], "t string")
    assert frequency.distinct_and_mode(once, ["t"])["t"] == (6, long[-1])
    tied = once.union(once.where(F.col("t").isin(long[1], long[3]))).union(spark.createDataFrame([("short",)] * 2, "t string"))
    assert frequency.distinct_and_mode(tied, ["t"])["t"] == (7, "short")
    more = tied.union(once.where(F.col("t").isin(long[1], long[3])))
    assert frequency.distinct_and_mode(more, ["t"])["t"] == (7, long[3])
    assert frequency.distinct_counts(more, ["t"]) == {"t": 7}


def test_mode_of_the_documents(spark):
    documents = table(spark, FOLDER, "documents")
    found = profile.column_statistics(documents, "text").first()
    texts = [r["text"] for r in documents.select("text").collect()]
    top = max(texts.count(t) for t in texts)
    assert found["unique"] == len(set(texts))
    assert found["mode"] == min(t for t in texts if texts.count(t) == top)


def test_held_tables_live_in_the_named_folder(spark, monkeypatch):
    df = spark.range(5).select("id", F.lit(None).alias("nothing"))
    table_ = held.hold(df, "check")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in table_.inputFiles()) and table_.columns == ["id", "nothing"]
    assert table_.count() == 5
    held.drop_held(table_)
    with pytest.raises(Exception):
        spark.read.parquet(table_.inputFiles()[0]).count()
    monkeypatch.setattr(held, "_named_folder", lambda session: None)
    with held.held(df, "check") as other:
        assert other.count() == 5 and folder not in other.inputFiles()[0]
    held.release_held(spark)


def test_spearman_without_values(spark):
    none = spark.createDataFrame([(None, None, "a")], "x double, y int, t string")
    assert association.correlations(none, "spearman").count() == 0
    assert association.correlations(none.limit(0), "spearman").count() == 0
    assert association.correlations(none).count() == 0


def test_nothing_is_left_behind(spark):
    before = held._tables(spark)
    df = spark.range(50).selectExpr("id AS a", "id % 7 AS b", "IF(id % 3 = 0, NULL, id) AS c")
    association.correlations(df, "spearman").collect()
    assert held._tables(spark) == before
    with held.released(spark):
        held.hold(df, "x")
        assert len(held._tables(spark)) == len(before) + 1
    assert held._tables(spark) == before


def test_hot_keys_are_split_in_shuffled_lookups(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    left = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 3 = 1, NULL, CAST(id AS STRING))) AS k", "id")
    right = spark.createDataFrame([("hot", "H"), ("2", "two"), ("none", "N")], "key string, new string")
    hot = spark.createDataFrame([("hot",)], "key string")
    got = lookups.lookup(left, F.col("k"), right, "key", 1, hot)
    counts = {r["new"]: r["count"] for r in got.groupBy("new").count().collect()}
    assert got.columns == ["k", "id", "new"] and counts == {"H": 1000, "two": 1, None: 1999}


def test_cleaning_deletes_what_it_wrote(spark):
    df = spark.range(40).selectExpr("id % 20 AS a", "IF(id % 4 = 0, NULL, id % 20) AS b", "repeat('wide ', 40) AS t")
    ops = [{"type": "remove_duplicates"}, {"type": "fill_nulls", "column": "b", "method": "mean"}]
    before = held._tables(spark)
    result = cleaning.clean(df, ops)
    assert result.table.count() == 20 and held._tables(spark) > before
    result.release()
    assert held._tables(spark) == before


def test_wide_copies_are_removed(spark):
    rows = [(i % 7 if i < 30 else i, *["x" * 90] * 4) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, t string, u string, v string, w string")
    assert quality.repeated_hashes(df) is not None
    assert sorted(cleaning.clean(df, [{"type": "remove_duplicates"}]).table.collect()) == sorted(set(rows))


def test_samples_of_all_columns_take_one_scan(spark):
    df = spark.range(500).select("id", *[F.when(F.col("id") % (k + 2) != 0, F.concat(F.lit(f"{k}-"), F.col("id"))).alias(f"t{k}") for k in range(9)])
    first = profile.first_values(df, df.columns[1:], ["id"], 3)
    assert plan(first).split("Initial Plan")[0].count("Range (") == 1 and "WindowGroupLimit" in plan(first)
    got = {r["column"]: r["sample"] for r in profile.categorical_summary(df, ["id"], k=3).collect()}
    assert got["t0"] == ["0-1", "0-3", "0-5"] and got["t8"] == ["8-1", "8-2", "8-3"] and len(got) == 9
    assert profile.categorical_summary(df.limit(0), ["id"]).first()["sample"] == []


def test_sketches_are_stored_by_file(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    rows = spark.range(30_000).selectExpr("id", "id % 1000 AS k", "IF(id % 3 = 0, NULL, CAST(id AS DOUBLE)) AS x", "CAST(id % 7 AS STRING) AS t")
    assert sketches.stored(spark, store) is None
    for part in range(2):
        rows.where(f"id % 2 = {part}").coalesce(1).write.mode("append").parquet(data)
        assert sketches.update_store(spark, data, store) == 1
    assert sketches.update_store(spark, data, store) == 0
    got = {r["column"]: r for r in sketches.approx_profile(sketches.stored(spark, store)).collect()}
    assert (got["x"]["n"], got["x"]["nulls"], got["x"]["low"], got["x"]["high"]) == (20_000, 10_000, 1.0, 29_999.0)
    assert abs(got["k"]["distinct"] - 1000) <= 1000 * sketches.DISTINCT_ERROR and got["t"]["distinct"] == 7
    assert abs(got["id"]["median"] - 15_000) <= 30_000 * sketches.RANK_ERROR + 1 and got["t"]["median"] is None
    # A file in a newer state counts in that state only.
    later = sketches.stored(spark, store).limit(4).selectExpr("*").withColumn("modified", F.col("modified") + F.expr("INTERVAL 1 HOUR"))
    assert sketches.approx_profile(later).count() > 0
    empty = spark.read.parquet(data).where("id < 0")
    assert sketches.approx_profile(sketches.sketch_columns(empty)).collect() == []


def test_seeded_samples_do_not_depend_on_partitions(spark):
    df = spark.range(400).selectExpr("id % 300 AS id", "id * 1.0 AS x", "id * 2.0 AS y")
    one = chartdata.scatter_sample(df.coalesce(1), "y", "x", ["id"], 50, seed=1).collect()
    assert chartdata.scatter_sample(df.repartition(7), "y", "x", ["id"], 50, seed=1).collect() == one and len(one) == 50
    assert chartdata.scatter_sample(df, "y", "x", ["id"], 50, seed=2).collect() != one
    assert chartdata.box_outlier_sample(df, "x", ["id"], 5).collect() == []


def test_queries_stay_where_a_library_is_missing(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), e.LEFT_OUT)"
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=ROOT, timeout=100).stdout
    assert int(said.split()[0]) > 100 and "zstandard" in said


def test_wide_rows_with_many_copies_are_never_shuffled(spark, monkeypatch):
    rows = [(i % 40 if i < 120 else i, None if i % 40 == 3 else -0.0 if i % 40 % 2 else 0.0, "1:x" if i % 40 % 3 else "x", "y" * 90) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, t string, u string").repartition(5)
    df = df.withColumns({"z": F.timestamp_micros(F.col("a").cast("long")), "y": F.encode("t", "utf-8")})
    wanted = {(r.a, r.t) for r in df.collect()}
    plain = sorted((r.a, r["__n"]) for r in quality.duplicate_groups(df).collect())
    for broadcast_bytes in (64 << 20, 5_000):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(quality, "BROADCAST_BYTES", broadcast_bytes)
        assert quality.repeated_hashes(df) is None
        before = held._tables(spark)
        result = cleaning.clean(df, [{"type": "remove_duplicates"}])
        got = [(r.a, r.t) for r in result.table.collect()]
        assert len(got) == len(wanted) == 220 and set(got) == wanted
        assert "Exchange" not in plan(result.table)
        result.release()
        assert held._tables(spark) == before
        assert sorted((r.a, r["__n"]) for r in quality.duplicate_groups(df).collect()) == plain and len(plain) == 40
        assert quality.duplicate_count(df).first()[0] == 80


def test_slices_of_places_read_their_own_files(spark):
    stored = held.hold(spark.range(4000).repartition(8), "files")
    for k in range(4):
        part = stored.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(4)) == k)
        physical = part._jdf.queryExecution().executedPlan()
        physical.executeCollect()
        read = physical.collectLeaves().apply(0).metrics().apply("numFiles").value()
        assert read == part.select("_metadata.file_path").distinct().count() < 8


def test_many_repeated_hashes(spark):
    df = spark.range(500_000).selectExpr("id % 250000 AS a", "repeat('wide', 20) AS t", "id % 250000 AS b", "'u' AS u", "'v' AS v")
    with held.released(spark):
        assert quality.repeated_hashes(df) is None
        assert quality.duplicate_count(df).first()[0] == 250_000
        assert cleaning.clean(df, [{"type": "remove_duplicates"}]).table.agg(F.count("*"), F.sum("a")).first()[:] == (250_000, 250_000 * 249_999 // 2)


def test_hundreds_of_ranks_are_found_where_the_values_are(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FETCH_ROWS", 16)
    df = spark.range(20_001).select(F.col("id").cast("double").alias("v"))
    shares = [i / 1000 for i in range(1, 1000)]
    got = quantiles.exact_quantiles(df, {"v": shares})["v"]
    assert all(abs(got[q] - 20_000 * q) < 1e-6 for q in shares)


def test_files_without_rows_are_sketched_once(spark, tmp_path):
    data, store = f"{tmp_path}/some data%1", f"{tmp_path}/store"
    for n in (10, 0):
        spark.range(n).withColumn("t", F.lit("a")).coalesce(1).write.mode("append").parquet(data)
    assert sketches.update_store(spark, data, store) == 2
    assert sketches.update_store(spark, data, store) == 0
    got = {r["column"]: r for r in sketches.approx_profile(sketches.stored(spark, store)).collect()}
    assert (got["id"]["n"], got["id"]["nulls"], got["id"]["distinct"], got["t"]["distinct"]) == (10, 0, 10, 1)
    nothing = f"{tmp_path}/nothing"
    spark.range(0).write.parquet(nothing)
    assert sketches.update_store(spark, nothing, f"{tmp_path}/other") == 1
    got = sketches.approx_profile(sketches.stored(spark, f"{tmp_path}/other")).first()
    assert (got["n"], got["distinct"], got["median"]) == (0, 0, None)


def test_one_large_column_meets_the_others_by_its_values(spark, monkeypatch):
    x = F.col("id")
    df = spark.range(3000).select(
        F.when(x % 5 != 0, x * 7919 % 2999).alias("large"), F.when(x % 3 != 0, x % 11).alias("a"), (x * x % 13).alias("b"), F.lit(None).cast("double").alias("none")
    )
    labels, real = [], association.hold
    monkeypatch.setattr(association, "hold", lambda df, label: labels.append(label) or real(df, label))
    monkeypatch.setattr(association, "BROADCAST_BYTES", 4000)
    got = {(r["column_a"], r["column_b"]): (r["correlation"], r["n"]) for r in association.correlations(df, "spearman").collect()}
    assert labels == ["counts", "ranks"] and len(got) == 3
    wanted = df.toPandas()
    for (a, b), (r, n) in got.items():
        both = wanted[[a, b]].dropna()
        assert n == len(both) and r == pytest.approx(both.rank().corr().iloc[0, 1], abs=5.1e-5)


def test_means_of_many_columns(spark, monkeypatch):
    df = holes(spark, 14).withColumn("none", F.lit(None).cast("double"))
    wanted = df.toPandas()
    got = {(r["column_a"], r["column_b"]): (r["correlation"], r["n"]) for r in association.correlations(df).collect()}
    assert not any("none" in p for p in got)
    for (a, b), (r, n) in got.items():
        both = wanted[[a, b]].dropna()
        assert n == len(both) and r == pytest.approx(both.corr().iloc[0, 1], abs=5.1e-5)
    assert association.correlations(df.limit(0)).count() == 0


def test_wide_stages_are_split_into_methods_that_are_compiled(spark, monkeypatch):
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(limit)
    for module, name in ((association, "_gram_matrix"), (quantiles, "_sketched")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, real=real: seen.append(spark.conf.get(limit)) or real(df, *a))
    df = holes(spark, 14, 6000)
    association.correlations(df)
    quantiles.exact_quantiles(df, {c: [0.1, 0.3, 0.7] for c in df.columns[:14]})
    assert seen == ["8000", "8000"] and spark.conf.get(limit) == before
