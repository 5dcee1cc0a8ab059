"""The queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, text
from ..operators import relations, sequences
from ..shipping import ship
from ..sources import documents as src
from ..streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)  # some readers run Python on the executors
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that the driver's tables lack: other scripts, list markers, page numbers, Markdown.
SAMPLE_LINES = ["Hello world", "שלום עולם", "مرحبا بالعالم", "こんにちは世界", "你好世界", "Привет мир", "Γειά σου", "", "123 456", "abc שלום", "- item", "12. twelve", "iv) four", "b. letter", "Page 1", "Page 12 of 300", "Section 12345", "▪item", "+ plus", "-", "i. one", "iv.", "123456) long", "XIV. fourteen", "e.g. prose", "Fig. 3 shows", "Tabletop", "  IMAGE", "&#233;&#x41;&amp;lt;&bogus;&#xD800;&trade;", "`a` ``b``", "a|b*c_d", "x <y> & \"z\"", "é ü ñ", "# Title #", "> quoted", "  1) nested", "1 2 3"]
_VALUES = ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(SAMPLE_LINES))
SAMPLE_SQL = f"(SELECT * FROM (VALUES {_VALUES}) AS s(id, line))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLE_LINES)), "id int, line string")


LINES_SQL = r"""(SELECT doc_id, i - 1 AS line_no, regexp_replace(l[i], '[ \t\r\f]+$', '') AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS u(i))"""


#: All lines of the documents, and the sample rows beside them.
ALL_LINES_SQL = f"(SELECT doc_id::VARCHAR || ':' || line_no::VARCHAR AS id, line FROM {LINES_SQL} UNION ALL SELECT 'sample:' || id::VARCHAR, line FROM {SAMPLE_SQL})"


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.lines(t(spark, sf_dir, "documents"))
    rows = rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string")).alias("id"), "line")
    return rows.unionByName(samples(spark, sf_dir).select(F.concat(F.lit("sample:"), F.col("id").cast("string")).alias("id"), "line"))


def tally_sql(script: str, column: str) -> str:
    return f"length(regexp_replace({column}, '[^{text.SCRIPT_RANGES[script]}]', '', 'g'))"


# --- text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, line_no::INT AS line_no, line FROM {LINES_SQL}")
def text_to_lines(spark, sf_dir):
    return src.lines(t(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, line_no::INT AS line_no, line FROM {LINES_SQL} WHERE contains(lower(line), 'ation')")
def full_text_search(spark, sf_dir):
    return src.lines(t(spark, sf_dir, "documents")).where(F.contains(F.lower("line"), F.lit("ation")))


@query(f"SELECT doc_id, count(*) AS n_hits FROM {LINES_SQL} WHERE contains(lower(line), 'ation') GROUP BY doc_id ORDER BY n_hits DESC, doc_id LIMIT 20")
def search_top_docs(spark, sf_dir):
    return full_text_search(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits")).orderBy(F.desc("n_hits"), "doc_id").limit(20)


@query("SELECT doc_id, " + ", ".join(f"{tally_sql(name, 'text')}::INT AS {name}" for name in text.SCRIPT_RANGES) + " FROM documents")
def script_tallies(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.script_tallies(F.col("text")).items()])


_RTL = " + ".join(tally_sql(s, "line") for s in text.RTL)
_LTR = " + ".join(tally_sql(s, "line") for s in text.SCRIPT_RANGES if s not in text.RTL)


@query(f"SELECT id, CASE WHEN ({_RTL}) + ({_LTR}) = 0 THEN 'neutral' WHEN ({_RTL}) > ({_LTR}) THEN 'rtl' ELSE 'ltr' END AS direction FROM {ALL_LINES_SQL}")
def run_direction(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.direction(F.col("line")).alias("direction"))


_TOP = "greatest(" + ", ".join(tally_sql(s, "line") for s in text.SCRIPT_RANGES) + ")"
_SCRIPT = "CASE " + f"WHEN {_TOP} = 0 THEN 'other' " + " ".join(f"WHEN {tally_sql(s, 'line')} = {_TOP} THEN '{s}'" for s in text.SCRIPT_RANGES) + " END"


@query(f"""SELECT id, script, CASE WHEN script = 'arabic' THEN 'ar' WHEN script = 'hebrew' THEN 'he' WHEN script = 'cjk' AND regexp_matches(line, '[{text.KANA}]') THEN 'ja'
    WHEN script = 'cjk' THEN 'zh' END AS lang FROM (SELECT *, {_SCRIPT} AS script FROM {ALL_LINES_SQL})""")
def document_language(spark, sf_dir):
    rows = all_lines(spark, sf_dir).withColumn("script", text.script(F.col("line")))
    return rows.select("id", "script", text.language_guess(F.col("script"), F.col("line")).alias("lang"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS digest FROM documents")
def collapse_whitespace(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("digest"))


_PLAIN = r"trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_FOLD = "regexp_replace({0}, '(^|[^0-9])[0-9]{{1,4}}([^0-9]|$)', '\\1#\\2', 'g')"


@query(f"SELECT id, CASE WHEN length(regexp_replace({_PLAIN}, '[^\\p{{L}}]', '', 'g')) <= 6 THEN {_FOLD.format(_FOLD.format(_PLAIN))} ELSE {_PLAIN} END AS signature FROM {ALL_LINES_SQL}")
def furniture_signature(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.signature(F.col("line")).alias("signature"))


@query(rf"""SELECT id, CASE WHEN regexp_matches(l, '^([{text.GLYPHS}]|[{text.DASHES}]\s)') THEN 'bullet' WHEN regexp_matches(l, '^[0-9]+[.)](\s|$)') THEN 'decimal'
    WHEN regexp_matches(l, '^[A-Za-z][.)](\s|$)') THEN 'letter' WHEN regexp_matches(l, '^([ivxlcdm]{{2,}}|[IVXLCDM]{{2,}})[.)](\s|$)') THEN 'roman' ELSE 'none' END AS marker,
    regexp_replace(l, '^([{text.GLYPHS}]\s*|[{text.DASHES}]\s+|{text.ORDINAL}(\s+|$))', '') AS content FROM (SELECT id, regexp_replace(line, '^\s+', '') AS l FROM {ALL_LINES_SQL})""")
def list_markers(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.list_marker(F.col("line")).alias("marker"), text.strip_marker(F.col("line")).alias("content"))


def _roman_sql(n: str) -> str:
    parts = []
    for place, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        parts.append("[" + ", ".join(f"'{x}'" for x in forms) + f"][({n} // {place}) % 10 + 1]")
    return f"CASE WHEN {n} BETWEEN 1 AND 3999 THEN " + " || ".join(parts) + f" ELSE {n}::VARCHAR END"


@query(f"SELECT p_partkey, {_roman_sql('p_partkey')} AS roman FROM part")
def roman_labels(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.roman(F.col("p_partkey")).alias("roman"))


_LABEL = "repeat(chr((97 + (p_partkey - 1) % 26)::INT), ((p_partkey - 1) // 26 + 1)::INT)"


@query(f"""SELECT p_partkey, (CASE WHEN p_partkey > 18278 THEN chr((97 + ((p_partkey - 18279) // 17576) % 26)::INT) ELSE '' END) || (CASE WHEN p_partkey > 702 THEN chr((97 + ((p_partkey - 703) // 676) % 26)::INT) ELSE '' END)
    || (CASE WHEN p_partkey > 26 THEN chr((97 + ((p_partkey - 27) // 26) % 26)::INT) ELSE '' END) || (CASE WHEN p_partkey > 0 THEN chr((97 + (p_partkey - 1) % 26)::INT) ELSE '' END) AS letters,
    CASE WHEN p_partkey > 0 THEN length({_LABEL}) END AS n_label, CASE WHEN p_partkey > 0 THEN md5({_LABEL}) END AS label_md5 FROM part""")
def letter_labels(spark, sf_dir):
    """Every part's two labels, the long one as length and digest: labels of later pages are kilobytes long, so it is not written out."""
    key = F.col("p_partkey")
    length = F.when(key > 0, (F.floor((key - 1) / 26) + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", text.letters(key).alias("letters"), length.alias("n_label"), text.repeated_letters_md5(key).alias("label_md5"))


@query(rf"""SELECT id, replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, regexp_replace(line, '([\\`*_\[\]<>|#])', '\\\1', 'g') AS markdown,
    CASE WHEN regexp_matches(line, '[,"\r\n]') THEN '"' || replace(line, '"', '""') || '"' ELSE line END AS csv FROM {ALL_LINES_SQL}""")
def escapes(spark, sf_dir):
    line = F.col("line")
    return all_lines(spark, sf_dir).select("id", text.escape_html(line).alias("html"), text.escape_markdown(line).alias("markdown"), text.csv_field(line).alias("csv"))


@query(f"SELECT id, coalesce(list_max(list_transform(regexp_extract_all(line, '`+'), lambda x: length(x))), 0)::INT AS longest FROM {ALL_LINES_SQL}")
def longest_backticks(spark, sf_dir):
    return all_lines(spark, sf_dir).select("id", text.longest_backticks(F.col("line")).alias("longest"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def text_digests(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


# --- cells, dates, numbers ----------------------------------------------------------------------

_CELLS = """(SELECT o_orderkey AS id, 'status' AS col, o_orderstatus AS cell FROM orders UNION ALL SELECT o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT o_orderkey, 'key', '  ' || o_orderkey::VARCHAR || ' ' FROM orders UNION ALL SELECT o_orderkey, 'flag', CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE '0' || o_orderkey::VARCHAR END FROM orders)"""


@query(rf"""SELECT id, col, CASE WHEN c = '' THEN 'empty' WHEN lower(c) IN ('true', 'false') THEN 'bool' WHEN d IS NOT NULL THEN 'date' WHEN num THEN 'number' ELSE 'text' END AS kind,
    CASE WHEN d IS NOT NULL THEN date_diff('day', DATE '1899-12-30', d)::DOUBLE WHEN num THEN try_cast(c AS DOUBLE) END AS number
    FROM (SELECT id, col, trim(cell) AS c, CASE WHEN regexp_matches(trim(cell), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(trim(cell) AS DATE) END AS d,
    regexp_matches(trim(cell), '^[+-]?(0|[1-9][0-9]{{0,14}})([.][0-9]+)?$') AS num FROM {_CELLS})""")
def csv_infer_cells(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    pick = lambda name, c: orders.select(F.col("o_orderkey").alias("id"), F.lit(name).alias("col"), c.alias("cell"))
    key = F.col("o_orderkey").cast("string")
    rows = pick("status", F.col("o_orderstatus")).union(pick("day", F.date_format("o_orderdate", "yyyy-MM-dd"))).union(pick("key", F.concat(F.lit("  "), key, F.lit(" "))))
    rows = rows.union(pick("flag", F.when(F.col("o_orderkey") % 2 == 0, "TRUE").otherwise(F.concat(F.lit("0"), key))))
    return rows.select("id", "col", cells.infer_kind(F.col("cell")).alias("kind"), cells.infer_number(F.col("cell")).alias("number"))


@query("""WITH r AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS line_no,
      concat_ws([',', ';', chr(9), '|'][c_nationkey % 4 + 1], c_name, c_mktsegment, c_custkey::VARCHAR) AS line FROM customer),
    w AS (SELECT doc_id, k AS rank, [',', ';', chr(9), '|'][k + 1] AS d, len(string_split(line, [',', ';', chr(9), '|'][k + 1])) AS width FROM r, range(4) AS g(k) WHERE line_no < 10),
    m AS (SELECT doc_id, rank, d, max(width) AS mw FROM w GROUP BY ALL),
    s AS (SELECT m.doc_id, m.rank, m.d, CASE WHEN mw > 1 THEN 100 * count(*) + mw ELSE 0 END AS score FROM m JOIN w ON m.doc_id = w.doc_id AND m.rank = w.rank AND w.width = mw GROUP BY m.doc_id, m.rank, m.d, mw)
    SELECT doc_id, CASE WHEN score > 0 THEN d ELSE ',' END AS delimiter, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1""")
def csv_detect_delimiter(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    marks = F.array(*map(F.lit, src.DELIMITERS))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    line = F.array_join(F.array("c_name", "c_mktsegment", F.col("c_custkey").cast("string")), "\x00")
    rows = c.select(F.col("c_nationkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("line_no"), F.replace(line, F.lit("\x00"), F.element_at(marks, F.col("c_nationkey") % 4 + 1)).alias("line"))
    return src.detect_delimiter(rows)


@query("SELECT o_orderkey, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::DOUBLE AS serial, day(last_day(o_orderdate))::INT AS days_in_month FROM orders")
def excel_serial_dates(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.floor(cells.serial(F.col("o_orderdate"))).cast("double").alias("serial"), F.day(F.last_day("o_orderdate")).alias("days_in_month"))


@query("""SELECT o_orderkey, concat_ws(',', o_orderkey::VARCHAR, o_orderstatus, CASE WHEN regexp_matches(p, '[,"]') THEN '"' || replace(p, '"', '""') || '"' ELSE p END) || chr(13) || chr(10) AS record
    FROM (SELECT *, o_orderpriority || ', "' || o_custkey::VARCHAR || '"' AS p FROM orders)""")
def csv_record_export(spark, sf_dir):
    note = F.concat("o_orderpriority", F.lit(', "'), F.col("o_custkey").cast("string"), F.lit('"'))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.concat_ws(",", text.csv_field(F.col("o_orderkey").cast("string")), text.csv_field(F.col("o_orderstatus")), text.csv_field(note)), F.lit("\r\n")).alias("record"))


@query("""SELECT p_partkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace((floor(v * 1000000) / 1000000)::DECIMAL(30,6)::VARCHAR, '0+$', ''), '[.]$', '') END AS shown
    FROM (SELECT p_partkey, p_retailprice / 8 AS v FROM part)""")
def format_number(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", cells.format_number(F.col("p_retailprice") / 8).alias("shown"))


@query("""SELECT s, round(p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 5 THEN 5 ELSE 10 END, 6) AS step
    FROM (SELECT l_suppkey AS s, (max(l_extendedprice) - min(l_extendedprice)) / 5 AS raw, power(10.0, floor(log10((max(l_extendedprice) - min(l_extendedprice)) / 5))) AS p FROM lineitem GROUP BY 1)""")
def nice_axis_step(spark, sf_dir):
    spans = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("span"))
    return spans.select("s", F.round(cells.nice_step(F.col("span"), 5), 6).alias("step"))


@query("SELECT o_orderkey, m AS mask, (m & 4) <> 0 AS can_print, (m & 16) <> 0 AS can_copy FROM (SELECT o_orderkey, (-3904 | (CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END) | (CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 0 END))::INT AS m FROM orders)")
def permission_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    none = F.lit(False)
    mask = cells.permission_mask({name: none for name in cells.PERMISSION_BITS} | {"print": key % 2 == 0, "copy": key % 3 == 0})
    rows = t(spark, sf_dir, "orders").select("o_orderkey", mask.cast("int").alias("mask"))
    return rows.select("*", cells.has_permission(F.col("mask"), "print").alias("can_print"), cells.has_permission(F.col("mask"), "copy").alias("can_copy"))


# --- pages --------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


def _exploded(pattern: str, name: str) -> tuple[str, Callable]:
    sql = f"SELECT page_id, i::INT AS n, m[i] AS {name} FROM (SELECT page_id, regexp_extract_all(html, '{pattern}', 1) AS m FROM pages), unnest(generate_series(1, len(m))) AS u(i)"

    def run(spark, sf_dir):
        return t(spark, sf_dir, "pages").select("page_id", F.posexplode(src.matches_of(F.col("html"), pattern)).alias("n", name)).withColumn("n", F.col("n") + 1)

    return sql, run


for _key, _pattern, _name in (
    ("html_links", r'<a\s[^>]*href="([^"]*)"', "href"),
    ("html_list_items", r"(?s)<li>(.*?)</li>", "item"),
    ("html_headings", r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", "heading"),
):
    ORACLES[_key], QUERIES[_key] = _exploded(_pattern, _name)


# whole paragraphs: from <p> to the next tag of a block, without the inline tags in them
_HIDDEN = (r"(?is)<(script|style|head)\b.*?</(script|style|head)>", r"(?s)<!--.*?-->")
_P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
_P_REST = r"(?is)</?(p|div|article|main|section|header|footer|nav|aside|body|html|table|ul|ol|dl|li|form|figure|blockquote|pre|hr|h[1-6]|address|details|fieldset)\b.*$"


@query(rf"""SELECT page_id, i::INT AS n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m[i + 1], '{_P_REST}', ''), '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS paragraph
    FROM (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(html, '{_HIDDEN[0]}', ' ', 'g'), '{_HIDDEN[1]}', ' ', 'g'), '{_P_OPEN}') AS m FROM pages), unnest(generate_series(1, len(m) - 1)) AS u(i)""")
def html_paragraph_blocks(spark, sf_dir):
    html = F.regexp_replace(F.regexp_replace("html", _HIDDEN[0], " "), _HIDDEN[1], " ")
    rows = t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(html, _P_OPEN)).alias("n", "part")).where("n > 0")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace("part", _P_REST, ""), r"(?i)<br\b[^>]*>", " "), "<[^>]*>", "")
    return rows.select("page_id", "n", F.trim(text.collapse_whitespace(inner)).alias("paragraph"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS visible FROM pages""")
def html_visible_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", src.strip_tags(F.col("html")).alias("visible"))


@query("SELECT kind, resource, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS resource FROM pages) GROUP BY ALL")
def html_needed_resources(spark, sf_dir):
    found = t(spark, sf_dir, "pages").select("page_id", F.lit("link").alias("kind"), F.explode(src.matches_of(F.col("html"), 'href="([^"]*)"')).alias("resource"))
    return found.groupBy("kind", "resource").agg(F.countDistinct("page_id").alias("n_pages"))


@query()
def html_node_tags(spark, sf_dir):
    return src.html_nodes(t(spark, sf_dir, "pages")).where("tag is not null").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


_BLOCKS_SQL = """(SELECT host, page_id, unnest(parts) AS block FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id,
    list_concat(string_split(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), ' &middot; '), regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS parts FROM pages))"""


def _host_blocks(spark, sf_dir) -> DataFrame:
    html = F.col("html")
    parts = F.concat(F.split(F.regexp_extract(html, r"(?s)<footer>(.*?)</footer>", 1), " &middot; "), src.matches_of(html, r"(?s)<li>(.*?)</li>"))
    return t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "page_id", F.explode(parts).alias("block"))


@query(f"""WITH b AS {_BLOCKS_SQL}, p AS (SELECT host, count(DISTINCT page_id) AS pages FROM b GROUP BY host HAVING pages > 1)
    SELECT b.host, b.block, count(DISTINCT b.page_id) AS n_pages FROM b JOIN p ON b.host = p.host GROUP BY b.host, b.block, p.pages HAVING 2 * n_pages > p.pages""")
def running_furniture(spark, sf_dir):
    return relations.strip_furniture(_host_blocks(spark, sf_dir), "host", "page_id", "block")[0]


@query(f"""WITH b AS {_BLOCKS_SQL}, p AS (SELECT host, count(DISTINCT page_id) AS pages FROM b GROUP BY host HAVING pages > 1),
    f AS (SELECT b.host, b.block FROM b JOIN p ON b.host = p.host GROUP BY b.host, b.block, p.pages HAVING 2 * count(DISTINCT b.page_id) > p.pages)
    SELECT b.host, b.page_id, b.block FROM b ANTI JOIN f ON b.host = f.host AND b.block = f.block""")
def strip_running_furniture(spark, sf_dir):
    return relations.strip_furniture(_host_blocks(spark, sf_dir), "host", "page_id", "block")[1].select("host", "page_id", "block")


# --- sequences ----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, event_id, value, coalesce((value - lag(value) OVER w > 5)::INT, 1) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
    c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY value, event_id) AS cluster FROM s)
    SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, round(avg(value), 6) AS mean FROM c GROUP BY ALL""")
def gap_clusters(spark, sf_dir):
    rows = sequences.gap_clusters(t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", F.lit(5), ["user_id"], "event_id")
    return rows.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events), s AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS step FROM e),
    m AS (SELECT user_id, median(step) AS middle FROM s GROUP BY user_id), f AS (SELECT s.*, coalesce((step > 1.5 * middle)::INT, 1) AS f FROM s JOIN m USING (user_id)),
    p AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS part FROM f)
    SELECT user_id, part::BIGINT AS part, count(*) AS n, min(sec) AS start, max(sec) AS stop FROM p GROUP BY ALL""")
def events_gap_sessions(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("sec"))
    parts = sequences.split_at_gaps(rows, "sec", ["user_id"], "event_id")
    return parts.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("start"), F.max("sec").alias("stop"))


@query("""WITH s AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
    SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n_rows, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS joined FROM r GROUP BY user_id, run, event_type""")
def coalesce_runs(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("word", F.col("event_id").cast("string"))
    return sequences.coalesce_runs(rows, "event_type", ["user_id"], ["ts", "event_id"], "word")


@query("""WITH o AS (SELECT l_suppkey, l_linenumber, l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS step FROM lineitem)
    SELECT l_orderkey, count(*) AS n, coalesce(count(*) >= 2 AND bool_and(step BETWEEN 1 AND 2) AND (min(l_linenumber) = 1 OR count(*) >= 3 AND bool_and(step = 1)), false) AS valid FROM o GROUP BY l_orderkey""")
def ordinal_sequences(spark, sf_dir):
    return sequences.ordinals_valid(t(spark, sf_dir, "lineitem"), "l_linenumber", ["l_orderkey"], "l_linenumber")


@query("""WITH b AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS low, epoch(ts)::DOUBLE + 60 * abs(value) AS high FROM events),
    r AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    g AS (SELECT *, sum(coalesce((low - reach >= 600)::INT, 1)) OVER (PARTITION BY user_id ORDER BY low, event_id) AS band FROM r)
    SELECT user_id, band::BIGINT AS band, round(min(low), 3) AS low, round(max(high), 3) AS high, count(*) AS n FROM g GROUP BY ALL""")
def merge_rule_bands(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", at.alias("low"), (at + 60 * F.abs("value")).alias("high"))
    return sequences.merge_intervals(rows, "low", "high", ["user_id"], 600, "event_id").select("user_id", "band", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "n")


@query("""WITH b AS (SELECT s_nationkey AS page, s_suppkey % 97 * 10 AS low, s_suppkey % 97 * 10 + 12 AS high FROM supplier), e AS (SELECT page, low AS x, 1 AS d FROM b UNION ALL SELECT page, high, -1 FROM b),
    g AS (SELECT page, x, sum(d) AS d FROM e GROUP BY ALL), s AS (SELECT page, x, sum(d) OVER w AS cover, lead(x) OVER w AS nx FROM g WINDOW w AS (PARTITION BY page ORDER BY x))
    SELECT page, x AS gap_low, nx AS gap_high, (x + nx) / 2 AS middle FROM s WHERE cover = 0 AND nx - x >= 18""")
def gutter_sweep(spark, sf_dir):
    low = F.col("s_suppkey") % 97 * 10
    rows = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), low.alias("low"), (low + 12).alias("high"))
    return sequences.uncovered_gaps(rows, "low", "high", ["page"], 18)


@query("""WITH RECURSIVE v AS (SELECT l_suppkey, x, row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS i FROM (SELECT DISTINCT l_suppkey, l_quantity AS x FROM lineitem)),
    f AS (SELECT l_suppkey, i, [x] AS edges FROM v WHERE i = 1 UNION ALL SELECT v.l_suppkey, v.i, CASE WHEN v.x - f.edges[-1] <= 3 THEN list_append(f.edges[1:len(f.edges) - 1], (f.edges[-1] + v.x) / 2) ELSE list_append(f.edges, v.x) END
    FROM f JOIN v ON v.l_suppkey = f.l_suppkey AND v.i = f.i + 1) SELECT l_suppkey, arg_max(edges, i) AS edges FROM f GROUP BY l_suppkey""")
def edge_clusters(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity").distinct()
    return sequences.cluster_edges(rows, "l_quantity", ["l_suppkey"], 3.0)


@query("""SELECT o_custkey AS doc, o_orderkey, row_number() OVER w AS page, replace(replace('Page {{page}} of {{pages}}', '{{page}}', (row_number() OVER w)::VARCHAR), '{{pages}}', (count(*) OVER (PARTITION BY o_custkey))::VARCHAR) AS header,
    CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN row_number() OVER w % 2 = 1 THEN 'odd' ELSE 'even' END AS zone FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def page_headers(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t(spark, sf_dir, "orders").withColumn("page", F.row_number().over(w)).withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    header = F.replace(F.replace(F.lit("Page {{page}} of {{pages}}"), F.lit("{{page}}"), F.col("page").cast("string")), F.lit("{{pages}}"), F.col("pages").cast("string"))
    zone = F.when(F.col("page") == 1, "first").when(F.col("page") % 2 == 1, "odd").otherwise("even")
    return rows.select(F.col("o_custkey").alias("doc"), "o_orderkey", F.col("page").cast("long").alias("page"), header.alias("header"), zone.alias("zone"))


@query("""WITH r AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) AS k, w FROM (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM """ + LINES_SQL + """)) WHERE w <> '')
    SELECT doc_id, line_no::INT AS line_no, string_agg(w, ' ' ORDER BY k) AS line FROM r GROUP BY ALL""")
def group_lines(spark, sf_dir):
    """Words placed on a page (14 points a line), grouped back into lines by their centres."""
    placed = src.lines(t(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("line", " ")).alias("k", "w"), (F.col("line_no") * -14.0).alias("y")).where("w <> ''")
    w = Window.partitionBy("doc_id").orderBy(F.desc("y"), "k")
    banded = sequences.number_islands(placed.withColumn("__y", -F.col("y")).withColumn("__before", F.lag("y").over(w)), F.abs(F.col("y") - F.col("__before")) > 0.6 * 12, ["doc_id"], ["__y", "k"], "band")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), " ")
    return banded.groupBy("doc_id", "band").agg((-F.first("y") / 14).cast("int").alias("line_no"), joined.alias("line")).drop("band")


# --- joins --------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, arg_min(a, abs(l_extendedprice - a) * 100000000 + a) AS anchor FROM lineitem, (SELECT unnest([1000.0, 10000.0, 25000.0, 50000.0, 90000.0])::DOUBLE AS a) GROUP BY l_orderkey, l_linenumber, l_extendedprice""")
def nearest_anchor(spark, sf_dir):
    anchors = F.array(*[F.lit(a) for a in (1000.0, 10000.0, 25000.0, 50000.0, 90000.0)])
    best = F.array_min(F.transform(anchors, lambda a: F.struct(F.abs(F.col("l_extendedprice") - a).alias("d"), a.alias("a"))))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", best["a"].alias("anchor")).distinct()


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 35 THEN 2 WHEN p_size < 50 THEN 3 END AS bucket FROM part")
def interval_bucket(spark, sf_dir):
    edges = [0, 10, 20, 35, 50]
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bucket int, low int, high int")
    part = t(spark, sf_dir, "part")
    return part.join(F.broadcast(ranges), (F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high")), "left").select("p_partkey", "bucket")


_BOXES = """(SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 500)::DOUBLE AS x, (l_orderkey % 700)::DOUBLE AS y, 40.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM lineitem)"""
_RECTS = """(SELECT s_suppkey AS page, s_suppkey AS rect, (s_suppkey * 7 % 400)::DOUBLE AS x, (s_suppkey * 13 % 600)::DOUBLE AS y, 120.0::DOUBLE AS w, 90.0::DOUBLE AS h FROM supplier)"""


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = t(spark, sf_dir, "lineitem").selectExpr("l_suppkey as page", "l_orderkey * 10 + l_linenumber as id", "cast(l_partkey % 500 as double) as x", "cast(l_orderkey % 700 as double) as y", "40d as w", "12d as h")
    r = t(spark, sf_dir, "supplier").selectExpr("s_suppkey as page", "s_suppkey as rect", "cast(s_suppkey * 7 % 400 as double) as x", "cast(s_suppkey * 13 % 600 as double) as y", "120d as w", "90d as h")
    return b, r


@query(f"SELECT a.page, a.id, b.rect FROM {_BOXES} a JOIN {_RECTS} b ON a.page = b.page AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def link_overlap(spark, sf_dir):
    b, r = _boxes(spark, sf_dir)
    return b.alias("a").join(r.alias("b"), (F.col("a.page") == F.col("b.page")) & relations.overlaps("a", "b")).select("a.page", "a.id", "b.rect")


@query(f"SELECT page, count(*) AS left_over FROM (SELECT a.* FROM {_BOXES} a ANTI JOIN {_RECTS} b ON a.page = b.page AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) GROUP BY page")
def region_redact(spark, sf_dir):
    b, r = _boxes(spark, sf_dir)
    return b.alias("a").join(r.alias("b"), (F.col("a.page") == F.col("b.page")) & relations.overlaps("a", "b"), "left_anti").groupBy("page").agg(F.count(F.lit(1)).alias("left_over"))


@query(f"""SELECT b.page, b.rect, a.id FROM {_RECTS} b JOIN {_BOXES} a ON a.page = b.page WHERE a.y >= b.y + b.h AND a.y - (b.y + b.h) <= 24 QUALIFY row_number() OVER (PARTITION BY b.page, b.rect ORDER BY a.y - (b.y + b.h), a.id) = 1""")
def caption_nearest(spark, sf_dir):
    b, r = _boxes(spark, sf_dir)
    bottom = r.select("page", "rect", (F.col("y") + F.col("h")).alias("bottom"))
    below = b.select("page", "id", F.col("y").alias("top"))
    near = relations.nearest(bottom, below, ["page"], F.when((F.col("top") >= F.col("bottom")) & (F.col("top") - F.col("bottom") <= 24), F.col("top") - F.col("bottom")).otherwise(1e9), ["id"], ["page", "rect"])
    return near.where("top >= bottom and top - bottom <= 24").select("page", "rect", "id")


@query("""SELECT e.event_id, e.user_id, s.value AS label FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def label_as_of(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    starts = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("label"))
    return relations.as_of(events.select("user_id", "event_id", "ts"), starts, "ts", "ts", ["user_id"], ["label"]).select("event_id", "user_id", "label")


# --- charts and aggregates ----------------------------------------------------------------------

_FACTS = "(SELECT l_returnflag AS series, o_orderpriority AS category, l_extendedprice * (CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _facts(spark, sf_dir) -> DataFrame:
    joined = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_returnflag").alias("series"), F.col("o_orderpriority").alias("category"), (F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)).alias("v"))


@query(f"SELECT category, round(coalesce(sum(v) FILTER (series = 'A'), 0), 2) AS a, round(coalesce(sum(v) FILTER (series = 'N'), 0), 2) AS n, round(coalesce(sum(v) FILTER (series = 'R'), 0), 2) AS r FROM {_FACTS} GROUP BY category")
def chart_data_table(spark, sf_dir):
    wide = _facts(spark, sf_dir).groupBy("category").pivot("series", ["A", "N", "R"]).agg(F.sum("v"))
    return wide.select("category", *[F.round(F.coalesce(F.col(s), F.lit(0.0)), 2).alias(s.lower()) for s in "ANR"])


@query(f"SELECT category, series, round(abs(s) / sum(abs(s)) OVER (PARTITION BY category), 6) AS share FROM (SELECT category, series, sum(v) AS s FROM {_FACTS} GROUP BY ALL)")
def percent_stack(spark, sf_dir):
    sums = _facts(spark, sf_dir).groupBy("category", "series").agg(F.sum("v").alias("s"))
    return sums.select("category", "series", F.round(F.abs("s") / F.sum(F.abs("s")).over(Window.partitionBy("category")), 6).alias("share"))


@query(f"SELECT category, round(least(0, sum(CASE WHEN v < 0 THEN v ELSE 0 END)), 2) AS low, round(greatest(0, sum(CASE WHEN v >= 0 THEN v ELSE 0 END)), 2) AS high FROM {_FACTS} GROUP BY category")
def value_range(spark, sf_dir):
    neg, pos = F.sum(F.when(F.col("v") < 0, F.col("v")).otherwise(0)), F.sum(F.when(F.col("v") >= 0, F.col("v")).otherwise(0))
    return _facts(spark, sf_dir).groupBy("category").agg(F.round(F.least(F.lit(0.0), neg), 2).alias("low"), F.round(F.greatest(F.lit(0.0), pos), 2).alias("high"))


@query(f"SELECT page, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, median(x) AS middle, count(*) AS n FROM {_BOXES} GROUP BY page")
def bounding_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir)[0]
    return b.groupBy("page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.expr("percentile(x, 0.5)").alias("middle"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT page, id, id % 4 // 2 AS grid_row, id % 2 AS grid_col, 2.0 * x + 3.0 AS tx, -1.0 * y + 800.0 AS ty FROM {_BOXES}")
def affine_and_grid(spark, sf_dir):
    b = _boxes(spark, sf_dir)[0]
    return b.select("page", "id", F.floor(F.col("id") % 4 / 2).alias("grid_row"), (F.col("id") % 2).alias("grid_col"), (2.0 * F.col("x") + 3.0).alias("tx"), (-1.0 * F.col("y") + 800.0).alias("ty"))


# --- trees --------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey::VARCHAR AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'n' || c_nationkey::VARCHAR FROM customer),
    d AS (SELECT node, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, d.depth + 1 FROM e JOIN d ON e.parent = d.node) SELECT depth, count(*) AS n FROM d GROUP BY depth""")
def hierarchy_depth(spark, sf_dir):
    region, nation, customer = (t(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    edges = region.selectExpr("concat('r', r_regionkey) as node", "cast(null as string) as parent").union(nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")).union(customer.selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)"))
    level, depth, out = edges.where("parent is null").select("node"), 0, None
    while depth < 3:  # the depth of this hierarchy
        own = level.agg(F.lit(depth).alias("depth"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.union(own)
        level = edges.join(level.withColumnRenamed("node", "parent"), "parent").select("node")
        depth += 1
    return out


@query("""WITH o AS (SELECT l_orderkey AS doc, l_linenumber AS idx, least(l_partkey % 3, l_linenumber - 1) AS depth FROM lineitem),
    u AS (SELECT doc, idx, min(depth) AS depth FROM o GROUP BY ALL)
    SELECT a.doc, a.idx, a.depth::INT AS depth, max(b.idx) AS parent FROM u a LEFT JOIN u b ON a.doc = b.doc AND b.idx < a.idx AND b.depth < a.depth GROUP BY a.doc, a.idx, a.depth""")
def outline_parents(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as idx", "cast(least(l_partkey % 3, l_linenumber - 1) as int) as depth")
    rows = rows.groupBy("doc", "idx").agg(F.min("depth").alias("depth"))
    w = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    # the last earlier entry of each lesser depth; the latest of them is the parent
    above = [F.max(F.when(F.col("depth") == k, F.col("idx"))).over(w) for k in range(3)]
    return rows.select("doc", "idx", "depth", F.when(F.col("depth") == 1, above[0]).when(F.col("depth") == 2, F.greatest(above[0], above[1])).alias("parent"))


# --- edits --------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN i = 3 THEN 0.5 ELSE i END)::INT - 1 AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)""")
def move_block(spark, sf_dir):
    rows = relations.renumber(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "place")
    return relations.move_row(rows, ["o_custkey"], "place", 3, 1)


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber >= 3 THEN l_linenumber + 1 ELSE l_linenumber END)::INT AS row_no FROM lineitem")
def insert_sheet_row(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", relations.insert_gap(F.col("l_linenumber"), 3).cast("int").alias("row_no"))


@query("""WITH p AS (SELECT user_id AS k, arg_max(event_type, event_id) AS name, arg_max(value, event_id) FILTER (event_type = 'click') AS v FROM events GROUP BY user_id)
    SELECT c_custkey, coalesce(p.name, c_name) AS c_name, coalesce(p.v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN p ON c_custkey = p.k""")
def apply_last_wins(spark, sf_dir):
    patches = t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("event_type").alias("c_name"), F.when(F.col("event_type") == "click", F.col("value")).alias("c_acctbal"))
    last = relations.last_wins(patches, ["c_custkey"], "event_id", ["c_name", "c_acctbal"])
    return relations.patch(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), last, ["c_custkey"], ["c_name", "c_acctbal"])


@query("""SELECT page, n AS label, (row_number() OVER (ORDER BY o, n))::INT AS place FROM (SELECT n_nationkey AS page, n_name AS n, 0 AS o FROM nation UNION ALL SELECT n_nationkey, n_name, 1 FROM nation WHERE n_nationkey IN (3, 5, 7))""")
def append_pages_subset(spark, sf_dir):
    own = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_name").alias("label"))
    both = own.withColumn("o", F.lit(0)).unionByName(own.where(F.col("page").isin(3, 5, 7)).withColumn("o", F.lit(1)))
    return relations.renumber(both, [], ["o", "label"], "place", 1).drop("o")


@query("SELECT o_orderkey, (((o_orderkey % 4) * 90 - 270) % 360 + 360) % 360 AS rotation, coalesce(NULLIF(o_orderstatus, 'F'), 'media') AS crop FROM orders")
def page_rotation_and_boxes(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") % 4 * 90 - 270, F.lit(360)).alias("rotation"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("media")).alias("crop"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_on, bool_and(o_orderstatus = 'O') AS all_on, bool_or(o_orderstatus <> 'O') AS any_off, bool_and(o_orderstatus <> 'O') AS all_off FROM orders GROUP BY o_custkey")
def layer_visibility(spark, sf_dir):
    on = F.col("o_orderstatus") == "O"
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(on).alias("any_on"), F.bool_and(on).alias("all_on"), F.bool_or(~on).alias("any_off"), F.bool_and(~on).alias("all_off"))


# --- vectors ------------------------------------------------------------------------------------


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best, list_max(embedding) AS score FROM embeddings")
def argmax_class(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"), F.array_max("embedding").alias("score"))


@query("""WITH a AS (SELECT vec_id, vec_id // 8 AS line, (list_position(embedding, list_max(embedding)) - 1) % 27 AS c FROM embeddings),
    b AS (SELECT *, lag(c) OVER (PARTITION BY line ORDER BY vec_id) AS p FROM a)
    SELECT line, coalesce(string_agg(chr((96 + c)::INT), '' ORDER BY vec_id) FILTER (c <> 0 AND (p IS NULL OR c <> p)), '') AS decoded FROM b GROUP BY line""")
def ctc_decode(spark, sf_dir):
    steps = t(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("line"), ((F.array_position("embedding", F.array_max("embedding")) - 1) % 27).alias("c"))
    seen = steps.withColumn("p", F.lag("c").over(Window.partitionBy("line").orderBy("vec_id")))
    kept = F.collect_list(F.when((F.col("c") != 0) & (F.col("p").isNull() | (F.col("c") != F.col("p"))), F.struct("vec_id", F.char(96 + F.col("c")).alias("s"))))
    return seen.groupBy("line").agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["s"]), "").alias("decoded"))


# --- streaming's batch twins --------------------------------------------------------------------


@query("""WITH s AS (SELECT *, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT, 1) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return sessions.event_sessions(t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query()
def markdown_lines(spark, sf_dir):
    return src.markdown_kinds(src.lines(t(spark, sf_dir, "documents"))).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))


from . import layout, more  # noqa: E402, F401  their queries join these
