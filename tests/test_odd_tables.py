"""Queries against their DuckDB twins on small tables made for the purpose: ties, nulls, other sizes."""

import duckdb
import pyspark.sql.functions as F

from quillspark.functions import text
from quillspark.operators import relations
from quillspark.plans import registry


def differing(spark, folder, name, tables):
    """The rows that only the query has, and those that only its twin has; a table is SQL for DuckDB."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"CREATE TABLE {table} AS {sql}")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    df = registry.QUERIES[name](spark, str(folder))
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))), sorted(map(repr, map(tuple, cursor.fetchall())))
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def test_best_recognizer(spark, tmp_path):
    scores = "0, 0.5), (1, 0.5005), (2, 0.501), (12, 0.5), (13, 0.502), (14, 0.5025), (24, -0.5), (25, -0.25), (26, NULL), (-1, 0.5), (36, NULL), (37, NULL"
    rows = f"SELECT v::BIGINT AS vec_id, CASE WHEN x IS NOT NULL THEN [x::FLOAT, -1] END::FLOAT[] AS embedding, 0 AS label FROM (VALUES ({scores})) s(v, x)"
    assert differing(spark, tmp_path, "best_recognizer", {"embeddings": rows}) == ([], [], 0)


def test_runs_joined(spark, tmp_path):
    runs = ["1, 10, 5, 2, 'A'", "1, 10, 5, 2, 'A'", "1, 12, 5, 1, 'N'", "2, 7, 4, 1, 'R'", "2, NULL, 4, 2, 'A'", "2, 12, 4, 3, 'N'", "2, 15, NULL, 4, 'N'", "2, 18, 1, 5, 'N'"]
    runs += ["3, 5, 1, 1, NULL", "4, 5, 1, 1, NULL", "4, 6, 1, 2, 'A'", "4, 60, 1, 3, 'R'"]
    rows = f"SELECT k::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, q::DOUBLE AS l_quantity, n::INT AS l_linenumber, f::VARCHAR AS l_returnflag FROM (VALUES ({'), ('.join(runs)})) v(k, p, q, n, f)"
    assert differing(spark, tmp_path, "runs_joined", {"lineitem": rows}) == ([], [], 0)


def test_runs_joined_ties(spark, tmp_path):
    """Runs of one place: the first has no space before it, whichever of them is first."""
    rows = "SELECT 1::BIGINT AS l_orderkey, 10::BIGINT AS l_partkey, 9::DOUBLE AS l_quantity, 2::INT AS l_linenumber, f AS l_returnflag FROM (VALUES ('R'), ('A'), ('N')) v(f)"
    differing(spark, tmp_path, "runs_joined", {"lineitem": rows})
    assert [r["joined"] for r in registry.QUERIES["runs_joined"](spark, str(tmp_path)).collect()] == ["2A 2N 2R"]


def test_letter_labels(spark, tmp_path):
    rows = "SELECT k::BIGINT AS p_partkey FROM (SELECT * FROM range(0, 456976, 971) UNION ALL SELECT * FROM (VALUES (1), (26), (27), (1663), (1664), (1665), (106470), (106471), (5), (-3), (27)) ORDER BY 1 DESC) v(k)"
    assert differing(spark, tmp_path, "letter_labels", {"part": rows}) == ([], [], 0)
    nulls = spark.sql("SELECT cast(null AS bigint) AS n UNION ALL SELECT -1").select(text.repeated_letters_md5(F.col("n")).alias("d")).collect()
    assert [r["d"] for r in nulls] == [None, None]


def test_letter_labels_cost():
    """Bytes hashed for labels in any order: the longest one's, and a stride for each label."""
    runs, hashed = text.RunningHashes(b"a"), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def update(self, data):
            hashed.append(len(data))
            self.inner.update(data)

        def copy(self):
            return Counting(self.inner.copy())

        def hexdigest(self):
            return self.inner.hexdigest()

    runs.last, runs.kept = Counting(runs.last), [Counting(h) for h in runs.kept]
    lengths = [(i * 7919) % 400_000 for i in range(1, 2000)]
    want = {n: text.hashlib.md5(b"a" * n).hexdigest() for n in lengths[::100]}
    got = {n: runs.digest(n) for n in lengths}
    assert {n: got[n] for n in want} == want
    assert sum(hashed) <= 400_000 + len(lengths) * runs.STRIDE < sum(lengths) / 40
    few = text.RunningHashes(b"b")
    few.KEEP = 3
    assert [few.digest(n) for n in (70_000, 5000, 33_000, 0, 70_001)] == [text.hashlib.md5(b"b" * n).hexdigest() for n in (70_000, 5000, 33_000, 0, 70_001)] and len(few.kept) <= 3


ODD_LINES = ["שלוaם", "abשל", "abcשלוםא", "é", "ÀÉשל", "Жשa", "日本aあ", "ab日本", "Ωx", "x Ωω", "\u200f 12", "ſƀ", "", " ", "Ж\u0600", "\U0001F600", "a  \u2028", "b \u0085", "c \u0001", "א \r", "ﬁ", "\ufeffא"]


def test_scripts(spark, tmp_path):
    """Lines in which two scripts or directions are level, or nothing is strong; and white space before other line ends."""
    texts = [*ODD_LINES, "\n".join(ODD_LINES)]
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(texts))
    tables = {"documents": f"SELECT i::BIGINT AS doc_id, s::VARCHAR AS text FROM (VALUES {values}) v(i, s)"}
    for name in ("script_tallies", "run_direction", "document_language", "text_to_lines"):
        (tmp_path / name).mkdir()
        assert (name, differing(spark, tmp_path / name, name, tables)) == (name, ([], [], 0))


def test_scripts_of_null(spark):
    row = spark.sql("SELECT cast(null AS string) AS t").select(text.direction(F.col("t")).alias("d"), text.script(F.col("t")).alias("s"), text.script_tallies(F.col("t"))["latin"].alias("n")).first()
    assert tuple(row) == ("ltr", "other", None)


def test_scripts_counted_once(spark):
    """A tally stands in the choice of a script once: with each tally six times over, 78 passes went over a line."""
    script = text.dominant_script({n: F.length(F.regexp_replace("t", n, "")) for n in text.SCRIPT_RANGES})
    assert str(script).count("regexp_replace") == len(text.SCRIPT_RANGES)


def test_outline_fold(spark, tmp_path, monkeypatch):
    """Small tasks give the same outlines, and are dealt by rows: 12 of 40 at most, however few bytes they have."""
    monkeypatch.setattr(relations, "TASK_ROWS", 40)
    rows = "SELECT i * 7 % 1009 AS o_orderkey, CASE WHEN i % 10 < 5 THEN 3 ELSE i % 23 END AS o_custkey FROM range(457) r(i)"
    assert differing(spark, tmp_path, "outline_fold", {"orders": rows}) == ([], [], 0)
    assert registry.QUERIES["outline_fold"](spark, str(tmp_path)).rdd.getNumPartitions() == 12
