"""Parsers and folds that SQL does not express, against small cases and round trips."""

from pyspark.sql import functions as F

from quillspark.functions import cells, text
from quillspark.operators import sequences
from quillspark.sources import documents, workbooks
from quillspark.streaming import sessions


def test_workbook_round_trip():
    grids = [[["a", "b & <c>"], ["", "1"]], [], [["x"] * 30]]
    got = workbooks.read_grids(workbooks.write_grids(grids, ["one", "two", "thr\"ee"]))
    assert [n for n, _ in got] == ["one", "two", "thr\"ee"]
    assert [g for _, g in got] == grids
    assert workbooks.read_grids(b"no workbook") == []


def test_workbook_cells(spark):
    files = spark.createDataFrame([("p", bytearray(workbooks.write_grids([[["a"], ["b"]]])))], "path string, content binary")
    assert [tuple(r) for r in workbooks.workbook_cells(files).orderBy("row").collect()] == [("p", "Sheet1", 0, 0, "a"), ("p", "Sheet1", 1, 0, "b")]


def test_csv_records(spark):
    rows = spark.createDataFrame([(1, 'a,"b\nc","d""e"\r\nf,,'), (2, None)], "id long, raw string")
    got = [(r["id"], r["row"], r["fields"]) for r in documents.csv_records(rows, "id", "raw").orderBy("row").collect()]
    assert got == [(1, 0, ["a", "b\nc", 'd"e']), (1, 1, ["f", "", ""])]


def test_html_nodes(spark):
    rows = spark.createDataFrame([(1, "<ul><li>a<li>b &amp; c</ul><br><p>x"), (2, None), (3, "</p><<")], "page_id long, html string")
    got = [(r["tag"], r["depth"], r["text"]) for r in documents.html_nodes(rows).where("page_id = 1").orderBy("node_id").collect()]
    assert got == [("ul", 0, None), ("li", 1, None), (None, 2, "a"), ("li", 1, None), (None, 2, "b & c"), ("br", 0, None), ("p", 0, None), (None, 1, "x")]


def test_markdown_kinds(spark):
    text_ = "# T #\n\n```py\n# no\n```\n- a\n  1. b\n> q\n---\n| x |\nplain"
    rows = documents.markdown_kinds(documents.lines(spark.createDataFrame([(1, text_)], "doc_id long, text string"))).orderBy("line_no")
    assert [(r["kind"], r["level"]) for r in rows.collect()] == [("heading", 1), ("blank", 0), ("fence", 0), ("code", 0), ("fence", 0), ("bullet", 0), ("ordered", 1), ("quote", 0), ("rule", 0), ("table", 0), ("text", 0)]


def test_cell_kinds(spark):
    given = ["", "TRUE", "2024-02-30", "2024-02-29", "2024-02-29T12:00", "007", "1e5", "-0.5", "1234567890123456", "5d", "NaN"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, c string").orderBy("i")
    got = rows.select(cells.infer_kind(F.col("c")).alias("k"), cells.infer_number(F.col("c")).alias("n")).collect()
    assert [r["k"] for r in got] == ["empty", "bool", "text", "date", "date", "text", "number", "number", "text", "text", "text"]
    assert got[4]["n"] == 45351.5 and got[6]["n"] == 100000.0


def test_edge_clusters(spark):
    rows = spark.createDataFrame([(1, x) for x in (10.0, 1.0, 3.0, 11.0, 30.0)], "k int, v double")
    assert sequences.cluster_edges(rows, "v", ["k"]).first()["edges"] == [2.0, 10.5, 30.0]


def test_labels(spark):
    row = spark.range(1).select(text.letters(F.lit(703)).alias("a"), text.repeated_letters(F.lit(28)).alias("b"), text.roman(F.lit(1994)).alias("c"), text.tidy_markdown(F.lit("a\n\n\n\nb\n\n")).alias("d")).first()
    assert tuple(row) == ("aaa", "bb", "MCMXCIV", "a\n\nb\n")


def test_stream_matches_batch(spark, tmp_path):
    batch = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 1d), (1, timestamp'2024-01-01 00:10:00', 2d), (1, timestamp'2024-01-01 02:00:00', 4d) as t(user_id, ts, value)")
    batch.write.parquet(str(tmp_path / "in"))
    stream = sessions.event_sessions(sessions.read_stream(spark, str(tmp_path / "in"), "user_id int, ts timestamp, value double"))
    run = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    closed = {tuple(r) for r in spark.table("sessions_out").collect()}
    assert closed <= {tuple(r) for r in sessions.event_sessions(batch).collect()}
