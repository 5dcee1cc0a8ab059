"""Functions of the second round against cases worked out by hand."""

import struct

from pyspark.sql import functions as F

from quillspark.functions import cells, text
from quillspark.operators import relations
from quillspark.sources import documents


def values(spark, given, make):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, c string").orderBy("i")
    return [r["v"] for r in rows.select(make(F.col("c")).alias("v")).collect()]


def test_references_are_decoded_once(spark):
    given = ["&amp;lt; &#233;&#x1F600; &bogus; &lt", "&#xD800;&#1114112;&nbsp;", "plain", "", None]
    assert values(spark, given, text.decode_entities) == ["&lt; é😀 &bogus; &lt", "&#xD800;&#1114112; ", "plain", "", None]


def test_markers(spark):
    given = ["•item", "▪ x", "- a", "-a", "-", "+ a", "12345) x", "7.", "i. x", "iv) x", "XIV.", "b) x", "e.g. x", "1.2 x", " \t* x"]
    assert values(spark, given, text.list_marker) == ["bullet", "bullet", "bullet", "none", "none", "none", "decimal", "decimal", "letter", "roman", "roman", "letter", "none", "none", "bullet"]
    assert values(spark, given[:10], text.strip_marker) == ["item", "x", "a", "-a", "-", "+ a", "x", "", "x", "x"]
    assert values(spark, given, text.ordinal) == [None] * 6 + [12345, 7, 9, 4, 14, 2, None, None, None]


def test_captions_words_and_colours(spark):
    assert values(spark, ["Figure 3", " fig. x", "Tabletop", "TABLE", "imagery", "image: x", ""], text.is_caption) == [True, True, False, True, False, True, False]
    assert values(spark, ["ab  cD\néa", ""], text.capitalized) == ["Ab  CD\nÉa", ""]
    assert values(spark, ["#fa0", "#FFAA01 ", "red"], text.hex_color) == [[255, 170, 0], [255, 170, 1], None]


def test_delimiters_in_quotes(spark):
    given = ['a;"x,y,z";c\nd;"1\n2,3";f\n', "a\tb\r\nc\td", "one\ntwo", "", "a|b,c\nd|e,f"]
    assert values(spark, given, documents.csv_delimiter) == [";", "\t", ",", ",", ","]
    rows = spark.createDataFrame([(1, "a,b\nc\n", ","), (2, "x;y;z", ";")], "id long, raw string, d string")
    sheet = documents.csv_sheet(documents.csv_records(rows, "id", "raw", delimiter_col="d"), "id").orderBy("id", "row", "col").collect()
    assert [r["cell"] for r in sheet] == ["a", "b", "c", "", "x", "y", "z"]


def test_rk_numbers(spark):
    given = [(12 << 2) | 2, (-5 << 2) | 3, struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32, -0x40000000 + 1]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, c int").orderBy("i")
    assert [r["v"] for r in rows.select(cells.rk_number(F.col("c")).alias("v")).collect()] == [12.0, -0.05, 1.5, -0.02]


def test_furniture_stands_in_bands(spark):
    rows = [(1, p, k, y, t) for p in (1, 2, 3) for k, y, t in ((0, 10.0, "Title"), (1, 300.0, "Title"), (2, 770.0, f"Page {p}"), (3, 700.0, f"only {p} of this"), (4, 60.0, "  "))] + [(2, 1, 0, 10.0, "Title")]
    blocks = spark.createDataFrame(rows, "s int, page int, k int, y double, t string")
    found, rest = relations.running_furniture(blocks, "s", "page", "k", "t", text.signature(F.col("t")), relations.band(F.col("y"), F.lit(12.0), F.lit(792.0)))
    assert sorted(map(tuple, found.select("s", "edge", "signature", "n_pages", "representative").collect())) == [(1, "bottom", "page #", 3, "Page 1"), (1, "top", "title", 3, "Title")]
    assert sorted((r["page"], r["k"]) for r in rest.where("s = 1").collect()) == [(p, k) for p in (1, 2, 3) for k in (1, 3, 4)]
    assert rest.where("s = 2").count() == 1
