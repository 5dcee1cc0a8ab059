"""More queries over the driver's tables: references, sheets, tables out, labels, list numbers, table edits, furniture in bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, text
from ..operators import relations
from ..sources import documents as src
from .registry import ALL_LINES_SQL, _roman_sql, all_lines, query, t


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- references, markers, words -----------------------------------------------------------------

_NAMED = " ".join(f"WHEN p = {_sql(f'&{name};')} THEN {_sql(char)}" for name, char in text.ENTITIES.items())
_CODE = "CASE WHEN lower(p[3:3]) = 'x' THEN try_cast('0x' || p[4:-2] AS BIGINT) ELSE try_cast(p[3:-2] AS BIGINT) END"


def decoded_sql(column: str) -> str:
    numeric = f"CASE WHEN ({_CODE}) < 1114112 AND NOT ({_CODE}) BETWEEN 55296 AND 57343 THEN chr(({_CODE})::INT) ELSE p END"
    return f"array_to_string(list_transform(regexp_extract_all({column}, '{text.REFERENCE}'), lambda p: CASE WHEN regexp_matches(p, '^&#.+;$') THEN {numeric} {_NAMED} ELSE p END), '')"


@query(f"SELECT id, {decoded_sql('line')} AS decoded FROM {ALL_LINES_SQL}")
def html_entity_lines(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.decode_entities(F.col("line")).alias("decoded"))


@query(f"SELECT page_id, md5({decoded_sql('html')}) AS digest FROM pages")
def html_entity_decode(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("digest"))


_LABEL = r"regexp_extract(line, '^\s*([0-9A-Za-z]+)[.)]', 1)"
_DIGIT = "MAP {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100, 'd': 500, 'm': 1000}"
_VALUE = f"list_sum(list_transform(range(1, length(l) + 1), lambda i: CASE WHEN {_DIGIT}[lower(l)[i]] < {_DIGIT}[lower(l)[i + 1]] THEN -{_DIGIT}[lower(l)[i]] ELSE {_DIGIT}[lower(l)[i]] END))"


@query(rf"""SELECT id, CASE WHEN regexp_matches(b, '^[0-9]+[.)](\s|$)') THEN try_cast(l AS BIGINT) WHEN regexp_matches(b, '^[A-Za-z][.)](\s|$)') THEN ascii(lower(l)) - 96
    WHEN regexp_matches(b, '^([ivxlcdm]{{2,}}|[IVXLCDM]{{2,}})[.)](\s|$)') THEN {_VALUE} END::BIGINT AS ordinal
    FROM (SELECT id, regexp_replace(line, '^\s+', '') AS b, {_LABEL} AS l FROM {ALL_LINES_SQL}) WHERE ordinal IS NOT NULL""")
def marker_ordinals(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.ordinal(F.col("line")).cast("bigint").alias("ordinal")).where("ordinal is not null")


@query("SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 3999 THEN p_partkey::INT END AS value FROM part")
def roman_values(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.roman_value(text.roman(F.col("p_partkey"))).alias("value"))


_CUES = "|".join(c.replace(".", "[.]") for c in text.CAPTION_CUES)


@query(rf"SELECT id, line FROM {ALL_LINES_SQL} WHERE regexp_matches(lower(line), '^\s*({_CUES})([^a-z]|$)')")
def caption_cues(spark, sf_dir):
    return all_lines(spark, sf_dir).where(text.is_caption(F.col("line"))).select("id", "line")


@query(r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '\s+|\S+'), lambda w: upper(w[1:1]) || w[2:]), '') AS name FROM part")
def text_capitalize(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.capitalized(F.col("p_name")).alias("name"))


_STYLE = "['D', 'R', 'r', 'A', 'a', ''][(p_partkey // 50) % 6 + 1]"
_NUMBER = "(p_partkey % 50 + 1)"
_LETTERS = f"repeat(chr((97 + ({_NUMBER} - 1) % 26)::INT), (({_NUMBER} - 1) // 26 + 1)::INT)"


@query(f"""SELECT p_partkey, 'S' || (p_partkey // 50)::VARCHAR || '-' || CASE {_STYLE} WHEN 'D' THEN {_NUMBER}::VARCHAR WHEN 'R' THEN {_roman_sql(_NUMBER)} WHEN 'r' THEN lower({_roman_sql(_NUMBER)})
    WHEN 'A' THEN upper({_LETTERS}) WHEN 'a' THEN {_LETTERS} ELSE '' END AS label FROM part""")
def page_labels(spark, sf_dir):
    """Ranges of 50 pages, each with its prefix and style, numbered from 1."""
    key = F.col("p_partkey")
    at = F.floor(key / 50)
    style = F.element_at(F.array(*map(F.lit, ("D", "R", "r", "A", "a", ""))), (at % 6 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", text.page_label(style, F.concat(F.lit("S"), at.cast("string"), F.lit("-")), key % 50 + 1).alias("label"))


# --- numbers, units, colours --------------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice * 20)::BIGINT AS twips, round(p_retailprice * 12700)::BIGINT AS emu, round(p_retailprice * 25.4 / 72, 6) AS mm FROM part")
def unit_conversions(spark, sf_dir):
    points = F.col("p_retailprice")
    return t(spark, sf_dir, "part").select("p_partkey", F.round(points * 20).cast("bigint").alias("twips"), F.round(points * 12700).cast("bigint").alias("emu"), F.round(points * 25.4 / 72, 6).alias("mm"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 100000) / (CASE WHEN o_orderkey % 2 = 0 THEN 100.0 ELSE 1.0 END)::DOUBLE AS value FROM orders")
def rk_numbers(spark, sf_dir):
    key = F.col("o_orderkey")
    rk = F.when(key % 3 == 0, -(key % 100000)).otherwise(key % 100000) * 4 + 2 + F.when(key % 2 == 0, 1).otherwise(0)
    return t(spark, sf_dir, "orders").select("o_orderkey", (cells.rk_number(rk.cast("int")) + 0.0).alias("value"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def serial_dates_back(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", cells.serial_date(cells.serial(F.col("o_orderdate"))).alias("day"))


@query("SELECT p_partkey, h AS hex, [('0x' || h[2:3])::INT, ('0x' || h[4:5])::INT, ('0x' || h[6:7])::INT] AS parts FROM (SELECT p_partkey, printf('#%02x%02x%02x', p_partkey % 256, p_size, 128) AS h FROM part)")
def color_round_trip(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select("p_partkey", text.color_hex(F.col("p_partkey") % 256 / 255.0, F.col("p_size") / 255.0, F.lit(0.5)).alias("hex"))
    return rows.withColumn("parts", text.hex_color(F.col("hex")))


# --- sheets and tables --------------------------------------------------------------------------

_MARK = "[',', ';', chr(9), '|'][(c_custkey // 20) % 4 + 1]"


def _csv_strings(spark, sf_dir) -> DataFrame:
    """CSV strings of at most 20 records, with quoted delimiters and quotes, and records of three or four fields."""
    key = F.col("c_custkey")
    group = F.floor(key / 20)
    mark = F.element_at(F.array(*map(F.lit, src.DELIMITERS)), (group % 4 + 1).cast("int"))
    name = F.concat(F.lit('"'), F.col("c_name"), mark, F.lit('""x""\n"'))
    last = F.when(key % 3 != 0, F.concat(mark, F.col("c_nationkey").cast("string"))).otherwise(F.lit(""))
    record = F.concat(name, mark, F.col("c_mktsegment"), mark, key.cast("string"), last, F.lit("\r\n"))
    rows = t(spark, sf_dir, "customer").select(group.alias("sheet"), F.struct(key.alias("k"), record.alias("r")).alias("r"))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["r"]), "").alias("raw"))


@query(f"SELECT c_custkey // 20 AS sheet, {_MARK} AS delimiter FROM customer GROUP BY ALL")
def csv_string_delimiter(spark, sf_dir):
    return _csv_strings(spark, sf_dir).select("sheet", src.csv_delimiter(F.col("raw")).alias("delimiter"))


@query(f"""SELECT sheet, row::INT AS row, (i - 1)::INT AS col, f[i] AS cell, ['text', 'text', 'number', CASE WHEN f[4] = '' THEN 'empty' ELSE 'number' END][i] AS kind
    FROM (SELECT c_custkey // 20 AS sheet, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS row,
    [c_name || {_MARK} || '"x"' || chr(10), c_mktsegment, c_custkey::VARCHAR, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey::VARCHAR ELSE '' END] AS f FROM customer), range(1, 5) AS g(i)""")
def csv_typed_sheet(spark, sf_dir):
    """CSV strings to typed cells: delimiter found, records read, padded to the widest, kinds inferred."""
    raw = _csv_strings(spark, sf_dir).withColumn("delimiter", src.csv_delimiter(F.col("raw")))
    rows = src.csv_sheet(src.csv_records(raw, "sheet", "raw", delimiter_col="delimiter"), "sheet")
    return rows.withColumn("kind", cells.infer_kind(F.col("cell")))


_CELLS = "[o_orderkey::VARCHAR, o_orderstatus, '|' || o_orderpriority]"


def _grids(spark, sf_dir) -> DataFrame:
    """Each customer's orders as a grid of strings."""
    row = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat(F.lit("|"), "o_orderpriority"))
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("k"), row.alias("cells")).alias("r"))
    return rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("grid"))


@query(f"SELECT o_custkey, to_json(list({_CELLS} ORDER BY o_orderkey))::VARCHAR AS grid FROM orders GROUP BY 1")
def grid_json(spark, sf_dir):
    return _grids(spark, sf_dir).select("o_custkey", F.to_json("grid").alias("grid"))


_MD = "'| ' || array_to_string(list_transform(" + _CELLS + r", lambda c: replace(c, '|', '\|')), ' | ') || ' |' || chr(10)"


@query(f"SELECT o_custkey, '| key | status | priority |' || chr(10) || '| :--- | :--- | :--- |' || chr(10) || string_agg({_MD}, '' ORDER BY o_orderkey) AS markdown FROM orders GROUP BY 1")
def to_markdown_table(spark, sf_dir):
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |\n"))
    head = "| key | status | priority |\n| :--- | :--- | :--- |\n"
    return _grids(spark, sf_dir).select("o_custkey", F.concat(F.lit(head), F.array_join(F.transform("grid", line), "")).alias("markdown"))


@query(f"SELECT o_custkey, '<table>' || string_agg('<tr><td>' || array_to_string({_CELLS}, '</td><td>') || '</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM orders GROUP BY 1")
def to_html_table(spark, sf_dir):
    line = lambda row: F.concat(F.lit("<tr><td>"), F.array_join(F.transform(row, text.escape_html), "</td><td>"), F.lit("</td></tr>"))
    return _grids(spark, sf_dir).select("o_custkey", F.concat(F.lit("<table>"), F.array_join(F.transform("grid", line), ""), F.lit("</table>")).alias("html"))


@query(f"""WITH c AS (SELECT o_custkey, o_orderkey, {_CELLS} AS f FROM orders), w AS (SELECT o_custkey, max(length(f[1])) AS a, max(length(f[2])) AS b FROM c GROUP BY 1)
    SELECT o_custkey, string_agg(rpad(f[1], a::INT, ' ') || '  ' || rpad(f[2], b::INT, ' ') || '  ' || f[3] || chr(10), '' ORDER BY o_orderkey) AS shown FROM c JOIN w USING (o_custkey) GROUP BY 1""")
def to_text_aligned(spark, sf_dir):
    """Columns as wide as their widest cell, two spaces between them."""
    wide = [F.expr(f"array_max(transform(grid, r -> length(r[{k}])))") for k in (0, 1)]
    grids = _grids(spark, sf_dir).withColumn("w", F.array(*wide))
    return grids.select("o_custkey", F.expr(r"array_join(transform(grid, r -> concat(rpad(r[0], w[0], ' '), '  ', rpad(r[1], w[1], ' '), '  ', r[2], '\n')), '')").alias("shown"))


_ROWS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS row, l_partkey FROM lineitem)"


def _table_rows(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("row"), "l_partkey")


@query(f"SELECT l_orderkey, (CASE WHEN row > 1 THEN row - 1 ELSE row END)::INT AS row, l_partkey FROM {_ROWS} WHERE row <> 1")
def delete_table_row(spark, sf_dir):
    return relations.delete_gap(_table_rows(spark, sf_dir), "row", 1)


@query("SELECT o_orderkey, (CASE WHEN col > 1 THEN col - 1 ELSE col END)::INT AS col, [o_orderstatus, o_orderpriority, o_custkey::VARCHAR][col + 1] AS cell FROM orders, range(3) AS g(col) WHERE col <> 1")
def delete_table_column(spark, sf_dir):
    cell = F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("col", "cell")
    return relations.delete_gap(t(spark, sf_dir, "orders").select("o_orderkey", cell), "col", 1)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders)
    SELECT o_custkey, place::INT AS place, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY w.k) - 1 AS place FROM p JOIN (VALUES (0, 2), (1, 0), (2, 99), (3, 2)) AS w(k, page) ON p.page = w.page)""")
def extract_pages(spark, sf_dir):
    """Pages 2, 0, 99 and 2 again of each document, in that order; a page that a document lacks is left out."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("page"))
    wanted = F.explode(F.expr("filter(transform(array(2, 0, 99, 2), (p, i) -> struct(i as at, p as page)), w -> w.page = page)"))
    chosen = pages.withColumn("w", wanted).withColumn("at", F.col("w.at"))
    return relations.renumber(chosen, ["o_custkey"], ["at"], "place").select("o_custkey", "place", "o_orderkey")


_LEVELS = 3


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT % {_LEVELS} AS level FROM lineitem),
    g AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN count(*) FILTER (level < 1) OVER w ELSE count(*) FILTER (level < 2) OVER w END AS parent FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
    SELECT l_orderkey, l_linenumber, l_partkey, level::INT AS level, row_number() OVER (PARTITION BY l_orderkey, level, parent ORDER BY l_linenumber, l_partkey)::INT AS number FROM g""")
def list_numbering(spark, sf_dir):
    """List items numbered by level; a level starts again after an item of a lower one."""
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("bigint") % _LEVELS).cast("int").alias("level"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    parent = F.lit(0)
    for level in range(1, _LEVELS):
        parent = F.when(F.col("level") == level, F.count(F.when(F.col("level") < level, 1)).over(w)).otherwise(parent)
    items = items.withColumn("parent", parent)
    return items.withColumn("number", F.row_number().over(Window.partitionBy("l_orderkey", "level", "parent").orderBy("l_linenumber", "l_partkey"))).drop("parent")


@query(r"""WITH r AS (SELECT c_custkey, '  ' || upper(c_mktsegment) || chr(9) || ' ' || (c_custkey % 7)::VARCHAR || ' ' AS label FROM customer),
    d AS (SELECT lower(o_orderstatus) AS x, NULL AS y FROM orders WHERE false UNION ALL SELECT lower(c_mktsegment || ' ' || (c_custkey % 5)::VARCHAR), min(c_custkey) FROM customer GROUP BY 1)
    SELECT c_custkey, y AS definition FROM r LEFT JOIN d ON trim(regexp_replace(lower(label), '\s+', ' ', 'g')) = x""")
def definition_resolve(spark, sf_dir):
    """References to definitions by label, case and white space apart; the first definition of a label counts, and a reference may have none."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    c = t(spark, sf_dir, "customer")
    definitions = c.select(plain(F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 5).cast("string"))).alias("x"), "c_custkey").groupBy("x").agg(F.min("c_custkey").alias("definition"))
    label = F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit("\t "), (F.col("c_custkey") % 7).cast("string"), F.lit(" "))
    return c.select("c_custkey", plain(label).alias("x")).join(definitions, "x", "left").select("c_custkey", "definition")


# --- running furniture --------------------------------------------------------------------------

_PAGES = "(SELECT doc_id, source, (len(string_split(coalesce(text, ''), chr(10))) - 1) // 8 + 1 AS pages FROM documents)"


@query(f"""SELECT doc_id, 'top' AS edge, lower('Report of ' || source) AS signature, pages::BIGINT AS n_pages, 'Report of ' || source AS representative FROM {_PAGES} WHERE pages > 1 AND source IS NOT NULL
    UNION ALL SELECT doc_id, 'bottom', 'page # of #', pages::BIGINT, 'Page 1 of ' || pages::VARCHAR FROM {_PAGES} WHERE pages > 1""")
def furniture_in_bands(spark, sf_dir):
    """Documents laid out as pages of eight lines with a header and a numbered footer, which are found again by signature."""
    docs = t(spark, sf_dir, "documents").withColumn("pages", F.floor((F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1) / 8) + 1)
    block = lambda at, y, text_: F.struct(F.lit(at).alias("at"), F.lit(y).alias("y"), text_.alias("text"))
    page = docs.select("doc_id", "source", "pages", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    edges = F.explode(F.array(block(-1, 20.0, F.concat(F.lit("Report of "), "source")), block(99, 760.0, F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of "), F.col("pages").cast("string")))))
    rows = page.select("doc_id", "page", edges.alias("b")).select("doc_id", "page", "b.*")
    body = src.lines(t(spark, sf_dir, "documents")).select("doc_id", (F.floor(F.col("line_no") / 8) + 1).cast("int").alias("page"), (F.col("line_no") % 8).alias("at"), (F.lit(120.0) + F.col("line_no") % 8 * 70).alias("y"), F.col("line").alias("text"))
    blocks = rows.unionByName(body)
    edge = relations.band(F.col("y"), F.lit(12.0), F.lit(792.0))
    found = relations.running_furniture(blocks, "doc_id", "page", "at", "text", text.signature(F.col("text")), edge)[0]
    return found.select("doc_id", "edge", "signature", "n_pages", "representative")
