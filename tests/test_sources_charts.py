import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import chartdata, cleaning, frequency
from tabsieve.sources import readers, records, writers
from tabsieve.sources.records import text_lines
from tabsieve.streaming.cleaning import clean_stream


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_blanks_and_missing_values(spark, tmp_path):
    path = put(tmp_path, "t.csv", "depth,site,load\n-4.25, north,7\n,south ,12\n0.5,n/a,-3\n")
    df = readers.load_table(spark, path)
    assert df.dtypes == [("depth", "double"), ("site", "string"), ("load", "bigint")]
    rows = writers.preview(df, ["load"]).collect()
    assert [tuple(r) for r in rows] == [(0.5, None, -3), (-4.25, " north", 7), (None, "south ", 12)]


def test_csv_inference_rules(spark, tmp_path):
    text = 'a,b,c,d,e,f\n1,True,x,2024-01-05,NA,"say ""hi"""\nNULL,FALSE,1,2024-01-06,,"a,b"\n 2 ,true,#N/A,NaN,null,"l\nm"\n'
    df = readers.load_table(spark, put(tmp_path, "t.csv", text), multi_line=True)
    assert df.dtypes == [
        ("a", "bigint"),
        ("b", "boolean"),
        ("c", "string"),
        ("d", "string"),
        ("e", "double"),
        ("f", "string"),
    ]
    rows = df.collect()
    assert [r["a"] for r in rows] == [1, None, 2] and [r["f"] for r in rows] == ['say "hi"', "a,b", "l\nm"]
    assert [r["c"] for r in rows] == ["x", "1", None] and {r["e"] for r in rows} == {None}


def test_empty_files_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Could not parse"):
        readers.load_table(spark, put(tmp_path, "t.csv", ""))


def test_infinite_text_is_missing_number(spark):
    df = readers.infer_types(spark.createDataFrame([("1.5",), ("inf",), ("-Infinity",)], "x string"))
    assert [r["x"] for r in df.collect()] == [1.5, None, None]


def test_unicode_names_round_trip(spark, tmp_path):
    path = put(tmp_path, "u.csv", "größe,Δt,место\n170,-0.5,Ħamrun\n9,12.25,서울\n")
    df = readers.load_table(spark, path)
    writers.write_csv(df, str(tmp_path / "out.csv"))
    again = readers.load_table(spark, str(tmp_path / "out.csv"))
    assert again.columns == ["größe", "Δt", "место"] and sorted(again.collect()) == sorted(df.collect())


def test_json_arrays_and_lines(spark, tmp_path):
    array = put(tmp_path, "r.json", '[{"b": 1, "a": "x", "n": null}, {"b": null, "a": "y", "n": null}]')
    lines = put(tmp_path, "r.jsonl", '{"b": 1, "a": "x"}\n{"b": 2, "a": "y"}\n')
    df = readers.load_table(spark, array)
    assert df.columns == ["b", "a", "n"] and df.count() == 2  # as in the file
    assert readers.load_table(spark, lines).count() == 2
    assert readers.load_table(spark, put(tmp_path, "l.json", '{"b": 1}\n{"b": 2}\n')).count() == 2
    with pytest.raises(ValueError, match="Could not parse"):
        readers.load_table(spark, put(tmp_path, "bad.jsonl", "not json\n"))


def test_formats(spark, tmp_path, people):
    for fmt in ("parquet", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        people.write.format(fmt).save(path)
        assert readers.load_table(spark, path).count() == 5
    with pytest.raises(ValueError, match="Unsupported"):
        readers.load_table(spark, "t.xlsx")
    with pytest.raises(ValueError, match="Unsupported"):
        readers.load_table(spark, "t", "avro")


def test_names_that_differ_by_case_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="case"):
        readers.distinct_names(spark.range(1).selectExpr("1 AS a", "2 AS A"))
    # CSV headers are made distinct by the reader itself.
    assert readers.load_table(spark, put(tmp_path, "t.csv", "a,A\n1,2\n")).columns == ["a0", "A1"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_reports_are_written(spark, tmp_path, people, fmt):
    path = str(tmp_path / "report")
    writers.write_report(people, path, ["score"], fmt)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    assert reader.format(fmt).load(f"{path}/numeric_summary").count() == 2
    with pytest.raises(ValueError):
        writers.write_report(people, path, ["score"], "docx")


def test_markdown_report(spark, tmp_path, people):
    writers.write_report(people, str(tmp_path / "r"), ["score"], "markdown")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert "## Numeric column summary" in lines


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_histogram_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    data = [rng.normal(size=500), rng.integers(0, 40, 700), np.round(rng.exponential(size=900), 1)][seed]
    kind = "bigint" if data.dtype.kind == "i" else "double"
    df = spark.createDataFrame([(v.item(),) for v in data] + [(None,)], f"x {kind}")
    edges = np.histogram_bin_edges(data, "auto")
    counts = np.histogram(data, edges)[0]
    got = chartdata.histogram(df, "x").orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["lo"] for r in got] == pytest.approx(edges[:-1].tolist()) and got[-1]["hi"] == pytest.approx(edges[-1])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in chartdata.histogram(df, "x").collect()] == [(0, 2.5, 3.5, 2)]


def test_curves_need_a_spread(spark):
    df = spark.createDataFrame([(3.0, "a"), (3.0, "b")], "x double, t string")
    assert chartdata.density_curve(df, "x").count() == 0
    with pytest.raises(ValueError, match="not numeric"):
        chartdata.violin_curve(df, "t")


def test_box(people):
    box = chartdata.box_stats(people, "price").first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (3.0, 5.0, 1)
    assert [tuple(r) for r in chartdata.box_outliers(people, "price").collect()] == [(18.0, 1)]


def test_line_area_and_scatter(spark, people):
    line = chartdata.line_series(people, "price", "score", 3).orderBy("bucket").collect()
    assert [(r["bucket"], r["n"], r["avg"]) for r in line] == [(0, 2, 3.0), (2, 2, 11.5)]
    area = chartdata.area_series(people, "price", "score", 3).agg(F.sum("n")).first()[0]
    assert area == 5 and chartdata.area_series(people, "name", "score").count() == 0
    points = {tuple(r) for r in chartdata.scatter_data(people, "price", "score").collect()}
    assert points == {(2, 6.0, 3.0), (1, 16.0, 5.0), (1, 21.0, 18.0)}
    grid = chartdata.scatter_data(people, "price", "score", grid=True)
    assert grid.agg(F.sum("n")).first()[0] == 4


def test_all_chart_types(people):
    for kind in chartdata.CHART_TYPES:
        tables = chartdata.chart_data(people, kind, "price", x_column="score", order_col="score")
        assert all(t.count() > 0 for t in tables.values())
    with pytest.raises(ValueError, match="Unknown chart type"):
        chartdata.chart_data(people, "Radar", "price")
    with pytest.raises(ValueError, match="order column"):
        chartdata.chart_data(people, "Line Plot", "price")
    with pytest.raises(ValueError, match="not found"):
        chartdata.chart_data(people, "Histogram", "nope")


def test_bar_and_pie(people):
    bars = [tuple(r) for r in chartdata.bar_counts(people, "name").collect()]
    assert bars == [(" Oslo ", 2), ("OSLO", 1), ("Rome", 1), ("oslo", 1)]
    pie = [tuple(r) for r in chartdata.pie_shares(people, "name", 2).collect()]
    assert sorted(pie) == [(" Oslo ", 2, 66.7), ("OSLO", 1, 33.3)]


def test_stream_applies_fitted_steps(spark, people, tmp_path):
    ops = [
        {"type": "fill_nulls", "column": "price", "method": "mean"},
        {"type": "fix_text", "column": "name", "mapping": {" Oslo ": "oslo"}},
        {"type": "normalize", "column": "score", "method": "minmax"},
    ]
    found = cleaning.clean(people, ops)
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    job = (
        clean_stream(stream, found.steps)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "marks"))
        .format("parquet")
        .start(str(tmp_path / "out"))
    )
    job.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(found.table.collect())
    with pytest.raises(ValueError, match="stream"):
        clean_stream(stream, cleaning.clean(people, [{"type": "remove_duplicates"}]).steps)


def pieces_of(folder, texts):
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"part-{i}.csv").write_bytes(t.encode())
    return str(folder)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_line_breaks_are_cut_by_many_tasks(spark, tmp_path, size):
    rng = random.Random(size)
    cells = ["plain", "a\nb", 'say ""hi""\n', "\n\n", "x,\n,y", '""', "", "long " * 9 + "\nend", "é\n東京"]
    rows = [(i, rng.choice(cells), rng.choice(cells)) for i in range(200)]
    lines = ["id,t,u"] + [f'{i},"{t}","{u}"' for i, t, u in rows]
    path = pieces_of(tmp_path / "csv", ["\n".join(lines) + "\n", "id,t,u\r\n\r\n900,plain,x\r\n901,,\"y\r\nz\"\r\n", "id,t,u\n902,p,q\n"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = readers.read_csv(spark, path)
        got = sorted((r.id, r.t, r.u) for r in found.collect())
        if size == 64:
            assert text_lines(spark, path).rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    clean = lambda t: t.replace('""', '"') or None
    wanted = [(i, clean(t), clean(u)) for i, t, u in rows] + [(900, "plain", "x"), (901, None, "y\r\nz"), (902, "p", "q")]
    assert got == wanted


def test_broken_lines_with_too_many_cells(spark, tmp_path):
    path = pieces_of(tmp_path / "csv", ['a,b\n1,"x\ny"\n2,"p\nq",3\n'])
    with pytest.raises(ValueError, match="1 row"):
        readers.read_csv(spark, path)


def test_json_columns_in_the_order_of_keys(spark, tmp_path):
    (tmp_path / "j").mkdir()
    put(tmp_path / "j", "1.json", '{"z": 1, "b": {"y": 2, "a": 3}}\n{"c": true, "z": 5}\n')
    put(tmp_path / "j", "2.json", '[\n  {"q": "x", "z": 3},\n  {"a": [1]}\n]\n')
    df = readers.load_table(spark, str(tmp_path / "j"), "json")
    assert df.columns == ["z", "b", "c", "q", "a"] and df.count() == 4
    lines = readers.load_table(spark, put(tmp_path, "l.jsonl", '{"m": 1, "e": 2}\n'))
    assert lines.columns == ["m", "e"]


def test_most_frequent_values_by_a_sketch(spark, monkeypatch):
    x = F.col("id")
    name = F.when(x % 3 == 0, F.lit("hot")).when(x % 3 == 1, F.concat(F.lit("long " * 30), x % 7)).otherwise(F.concat(F.lit("rare "), x))
    df = spark.range(9_000).select(name.alias("t"), x.alias("id"), (x % 40).alias("k"))
    assert set(frequency.frequent_values(df, "k", 5)) == set(range(40))
    got = [(r["value"], r["n"]) for r in frequency.top_values(df, "t", 4).collect()]
    assert frequency.frequent_values(df, "t", 4) is not None
    # Every value once: a sketch of few items cannot tell.
    monkeypatch.setattr(frequency, "TRACKED_VALUES", 48)
    monkeypatch.setattr(frequency, "NAMED_VALUES", 40)
    assert frequency.frequent_values(df, "id", 3) is None and frequency.frequent_values(df, "t", 20) is None
    assert [r["value"] for r in frequency.top_values(df, "id", 3).collect()] == [0, 1, 2]
    assert [(r["value"], r["n"]) for r in frequency.top_values(df, "t", 4).collect()] == got
    assert got[0] == ("hot", 3000) and got[1][1] == 429 and len(got) == 4
    assert frequency.top_values(df.where("id < 0"), "t", 3).collect() == []


def _blocks_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize("gap", ["", "\n", " \r\n  "])
@pytest.mark.parametrize("size", [50, 700])
def test_json_arrays_are_cut_by_many_tasks(spark, tmp_path, gap, size):
    hard = ["}", "{", '"', '\\', '\\"}', "],[{", "a\nb", "é}ü", "", "x" * 90, '"}, {"', "}}"]
    rows = [{"z": i, "t": hard[i % len(hard)], "o": {"p": [hard[-1 - i % len(hard)], "q"], "r": [{"s": i}]}} for i in range(60)]
    body = f",{gap}".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows))
    name = put(tmp_path, "a.json", f"{gap}[{gap}{body}{gap}]{gap}")
    try:
        _blocks_of(spark, size)
        df = readers.load_table(spark, name)
        assert df.columns == ["z", "t", "o"]
        assert sorted(df.toJSON().collect()) == sorted(json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows)
        pieces = records.json_records(records.text_lines(spark, name, "}"))
        order = [json.loads(r["record"])["z"] for r in pieces.orderBy("file", "block", "number").collect()]
        assert order == list(range(60))
        assert records.text_lines(spark, name, "}").rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_arrays_that_are_no_records(spark, tmp_path):
    body = ", ".join(f'{{"a": {i}}}' for i in range(50))
    bad = (f"[{body}", f"[{body},]", f"[{body}, 3]", f"[{body} {body}]", f"[null, {body}]", f"[[{body}]]", f"[{body}]]")
    for name in ("m", "bad"):
        (tmp_path / name).mkdir()
    put(tmp_path / "m", "1.json", f"[{body}]")
    put(tmp_path / "m", "2.json", '[{"b": "x", "a": 7}]')
    put(tmp_path / "m", "3.json", '{"c": 1}\n{"a": 8}\n')
    for i, text in enumerate(bad):
        put(tmp_path / "bad", f"{i}.json", text)
    try:
        _blocks_of(spark, 100)
        with pytest.raises(ValueError, match="as JSON records"):
            readers.load_table(spark, put(tmp_path, "r.json", bad[1]))
        df = readers.load_table(spark, str(tmp_path / "m"), "json")
        assert (df.columns, df.count(), df.where("a >= 0").count()) == (["a", "b", "c"], 53, 52)
        cut = records.json_records(records.text_lines(spark, str(tmp_path / "bad"), "}"))
        broken = cut.where(F.json_object_keys("record").isNull()).select("file").distinct().count()
        assert broken == len(bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
