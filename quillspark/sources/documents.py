"""Readers: texts as lines, CSV strings as records, pages as links, headings and nodes, workbooks as cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line of each text, right-trimmed, numbered from 0; a blank line stays."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return df.select(key, F.posexplode(split).alias("line_no", "line")).withColumn("line", F.rtrim("line", F.lit(" \t\r\f")))


def matches_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip_tags(html: Column) -> Column:
    """A page's visible text by patterns: scripts, styles and comments removed, tags as spaces."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))


def detect_delimiter(records: DataFrame, key: str = "doc_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Each document's delimiter by its first ten lines: 100 times the lines of greatest width, plus that width;
    widths of 1 do not count; the first best of , ; tab | wins, and the comma if none counts."""
    first = records.where(F.col(line_no) < 10)
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), F.size(F.split(F.col(line), "\\" + d if d == "|" else d)).alias("width")) for i, d in enumerate(DELIMITERS)]))
    wide = first.select(key, tried.alias("t")).select(key, "t.*")
    counted = wide.groupBy(key, "rank", "delimiter", "width").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(key, "rank", "delimiter").agg(F.max(F.struct("width", "n")).alias("m"))
    score = F.when(F.col("m.width") > 1, 100 * F.col("m.n") + F.col("m.width")).otherwise(0)
    return best.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("rank")).alias("rank"), F.when(score > 0, F.col("delimiter")).otherwise(",").alias("delimiter"))).alias("b")).select(key, "b.delimiter", F.col("b.score").cast("long").alias("score"))


def csv_delimiter(raw: Column) -> Column:
    """A CSV string's delimiter, by the rule of detect_delimiter over its first ten records: what stands in quotes divides neither fields nor records."""
    plain = F.regexp_replace(F.regexp_replace(raw, "^\ufeff", ""), r'"(?:[^"]|"")*+"?', "q")
    records = F.slice(F.split(F.regexp_replace(plain, r"(?:\r\n|\n|\r)$", ""), r"\r\n|\n|\r"), 1, 10)

    def scored(rank: int, mark: str) -> Column:
        widths = F.transform(records, lambda r: F.size(F.split(r, "\\|" if mark == "|" else mark)))
        most = F.array_max(widths)
        score = F.when(most > 1, 100 * F.size(F.filter(widths, lambda w: w == most)) + most).otherwise(0)
        return F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.when(score > 0, F.lit(mark)).otherwise(",").alias("delimiter"))

    scores = [scored(rank, mark) for rank, mark in enumerate(DELIMITERS)]
    return F.array_max(F.array(*scores))["delimiter"]


def csv_records(df: DataFrame, key: str, raw: str, delimiter: str = ",", delimiter_col: str | None = None) -> DataFrame:
    """RFC 4180 records of CSV strings, line ends inside quotes included: key, row, fields. delimiter_col: a column with each string's own."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            marks = batch["__mark"]
            out = [(k, i, list(r)) for k, text, mark in zip(batch[key], batch[raw], marks) for i, r in enumerate(csv.reader(io.StringIO((text or "").removeprefix("﻿"), newline=""), delimiter=mark))]
            yield pd.DataFrame(out, columns=[key, "row", "fields"])

    return df.select(key, raw, (F.col(delimiter_col) if delimiter_col else F.lit(delimiter)).alias("__mark")).mapInPandas(run, f"`{key}` {kind}, row int, fields array<string>")


def csv_sheet(records: DataFrame, key: str) -> DataFrame:
    """Records to cells, each record padded to the widest of its string: key, row, col, cell."""
    widest = records.groupBy(key).agg(F.max(F.size("fields")).alias("__width"))
    cell = F.explode(F.expr("transform(sequence(0, __width - 1), i -> named_struct('col', i, 'cell', coalesce(get(fields, i), '')))"))
    return records.join(widest, key).where("__width > 0").select(key, "row", cell.alias("c")).select(key, "row", "c.col", "c.cell")


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.stack: list[tuple[int, str]] = []

    def _add(self, tag: str | None, attrs: dict, text: str | None) -> int:
        self.rows.append((len(self.rows), self.stack[-1][0] if self.stack else None, len(self.stack), tag, attrs, text))
        return len(self.rows) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.stack and self.stack[-1][1] in CLOSES.get(tag, ()):
            self.stack.pop()
        node = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.stack.append((node, tag))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for _, t in self.stack):
            while self.stack.pop()[1] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add(None, {}, data)


def html_nodes(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The pre-order nodes of pages: key, node_id, parent_id, depth, tag, attrs, text; no page is refused."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html]):
                parser = _Nodes()
                parser.feed(text or "")
                parser.close()
                out += [(k, *row) for row in parser.rows]
            yield pd.DataFrame(out, columns=[key, "node_id", "parent_id", "depth", "tag", "attrs", "text"]).astype({"parent_id": "Int64"})

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, node_id long, parent_id long, depth int, tag string, attrs map<string,string>, text string")


def markdown_kinds(records: DataFrame, key: str = "doc_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Each Markdown line's kind (blank, fence, code, rule, heading, quote, bullet, ordered, table, text), level and content."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(line_no)
    fence = F.col(line).rlike(r"^ {0,3}(```+|~~~+)")
    t = F.trim(F.col(line))
    out = records.withColumn("__fences", F.sum(fence.cast("int")).over(w))
    kind = (
        F.when(fence, "fence")
        .when(F.col("__fences") % 2 == 1, "code")
        .when(t == "", "blank")
        .when(t.rlike(r"^(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$"), "rule")
        .when(t.rlike(r"^#{1,6}(?: |$)"), "heading")
        .when(t.startswith(">"), "quote")
        .when(t.rlike(r"^[-*+] "), "bullet")
        .when(t.rlike(r"^[0-9]{1,9}[.)] "), "ordered")
        .when(t.startswith("|"), "table")
        .otherwise("text")
    )
    out = out.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(t, "^(#+)", 1))).when(F.col("kind").isin("bullet", "ordered"), F.floor(F.length(F.regexp_extract(F.col(line), "^( *)", 1)) / 2).cast("int")).otherwise(0)
    content = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(F.regexp_replace(t, "^#+ *", ""), " +#+ *$", ""))).when(F.col("kind").isin("bullet", "ordered"), F.regexp_replace(t, r"^(?:[-*+]|[0-9]{1,9}[.)]) +", "")).when(F.col("kind") == "quote", F.regexp_replace(t, "^> ?", "")).when(F.col("kind") == "code", F.col(line)).otherwise(t)
    return out.select(key, line_no, "kind", level.cast("int").alias("level"), content.alias("content"))
