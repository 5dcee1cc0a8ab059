"""Functions over placed text, outlines, spans and stacks against cases worked out by hand."""

import hashlib
import hmac

from pyspark.sql import functions as F

from quillspark.functions import layout, text
from quillspark.operators import relations, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def test_anchors(spark):
    assert one(spark, layout.anchors(doubles([0, 10, 16, 17, 34]), F.lit(16.0))) == [0, 17, 34]
    assert one(spark, layout.anchors(doubles([]), F.lit(16.0))) == []
    assert one(spark, layout.column_gap(F.lit(5.0))) == 16 and one(spark, layout.column_gap(F.lit(12.0))) == 24
    places = doubles([0, 20, 40])
    assert [one(spark, layout.nearest_index(places, F.lit(x))) for x in (-5.0, 10.0, 10.1, 99.0)] == [0, 0, 1, 2]
    assert one(spark, layout.nearest_index(doubles([]), F.lit(1.0))) is None
    assert [one(spark, layout.indent_level(places, F.lit(x))) for x in (0.0, 19.0, 41.0)] == [0, 0, 2]


def test_headings(spark):
    levels = layout.heading_sizes(doubles([24, 23, 22, 18, 12]))
    assert one(spark, levels) == [24, 22, 18, 12]
    assert [one(spark, layout.heading_level(levels, F.lit(s))) for s in (30.0, 23.0, 12.1)] == [1, 1, 4]
    assert one(spark, layout.heading_level(layout.heading_sizes(doubles([])), F.lit(9.0))) == 1
    assert one(spark, layout.heading_level(doubles([90, 80, 70, 60, 50, 40, 30]), F.lit(30.0))) == 6
    got = [one(spark, layout.is_heading_size(F.lit(s), F.lit(b), F.lit(10.0))) for s, b in ((11.5, False), (11.4, False), (9.8, True), (9.7, True))]
    assert got == [True, False, True, False]


def test_joins_and_angles(spark):
    got = [one(spark, layout.runs_join(F.lit(10.0), F.lit(x), F.lit(12.0))) for x in (3.9, 4.0, 13.0, 13.1)]
    assert got == [False, True, True, False]
    given = [0.4, 90.5, -89.6, 179.8, -180.0, 450.0, 30.0, -30.0, 330.0, float("nan"), None]
    got = [one(spark, layout.rotation(F.lit(a).cast("double"))) for a in given]
    assert got == [0, 90, 270, 180, 180, 90, 30, -30, -30, 0, 0]


def test_colours(spark):
    part = lambda *inks: one(spark, layout.cmyk_bytes(*[F.lit(float(i)) for i in inks]))
    assert part(0, 0, 0, 0) == [255, 255, 255] and part(0, 0, 0, 1) == [0, 0, 0] and part(1, 0.5, 0, 0) == [0, 128, 255]


def test_outline(spark):
    levels = {1: [0, 1, 2, 1, 0], 2: [3, 3, 0, 5, 5, 1], 3: [0]}
    rows = [(d, i, lv) for d, ls in levels.items() for i, lv in enumerate(ls)]
    df = sequences.fold_outline(spark.createDataFrame(rows, "d int, i int, lv int"), "lv", ["d"], "i")
    got = {d: [] for d in levels}
    for r in df.orderBy("d", "i").collect():
        got[r["d"]].append((r["depth"], r["parent"]))
    assert got == {1: [(0, None), (1, 0), (2, 1), (1, 0), (0, None)], 2: [(0, None), (1, 0), (0, None), (1, 2), (2, 3), (1, 2)], 3: [(0, None)]}
    assert df.where("false").count() == 0


def test_spans_and_stacks(spark):
    cells = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 2), (1, 3, 9), (2, 0, 5), (2, 1, 1)], "t int, row int, span int")
    after = lambda at: sorted(map(tuple, relations.delete_spanned(cells, ["t"], "row", "span", at).collect()))
    assert after(2) == [(1, 0, 2), (1, 1, 1), (1, 2, 9), (2, 0, 5), (2, 1, 1)]
    assert after(9) == sorted(map(tuple, cells.collect()))
    page = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "p int, z int, e string")
    stacked = lambda at, front: [r["e"] for r in relations.restack(page, ["p"], "z", at, front).orderBy("z").collect()]
    assert (stacked(0, True), stacked(2, False), stacked(7, True)) == (["b", "c", "a"], ["c", "a", "b"], ["a", "b", "c"])


def test_escapes_and_macs(spark):
    given = ['a"b\\c\n\r\t\x01\x1f', "plain", "", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").orderBy("i")
    got = [r["v"] for r in rows.select(text.escape_json(F.col("s")).alias("v")).collect()]
    assert got == ['"a\\"b\\\\c\\n\\r\\t\\u0001\\u001f"', '"plain"', '""', None]
    yaml = ["", " a", "a ", "- x", "#a", "a: b", "a:b", "a #b", 'say "hi"', "- \"q\" \\", "a\tb", "é-"]
    rows = spark.createDataFrame(list(enumerate(yaml)), "i int, s string").orderBy("i")
    got = [r["v"] for r in rows.select(text.yaml_scalar(F.col("s")).alias("v")).collect()]
    assert got == ['""', '" a"', '"a "', '"- x"', '"#a"', '"a: b"', "a:b", '"a #b"', 'say "hi"', '"- \\"q\\" \\\\"', '"a\\tb"', "é-"]
    urls = ["http://a/b_(c)", "a b<c>(d)", "", "x\x85y"]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, s string").orderBy("i")
    assert [r["v"] for r in rows.select(text.link_destination(F.col("s")).alias("v")).collect()] == ["http://a/b_%28c%29", "<a b%3Cc%3E(d)>", "", "<x\x85y>"]
    for key in (b"", b"key", b"k" * 64, b"k" * 65):
        assert one(spark, text.hmac_sha256(key, F.lit("Grüße"))) == hmac.new(key, "Grüße".encode(), hashlib.sha256).hexdigest()
