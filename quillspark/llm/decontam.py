"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's words are hashed in overlapping runs of GRAM; of every WINDOW neighbouring hashes the smallest is
kept. Equal runs of GRAM + WINDOW - 1 words have one full window of equal hashes, so they share a kept
hash, whatever stands around them: with 5 and 6, every shared run of 10 words is found. Kept hashes of
documents and items are joined; in the documents that have a hit, each hit is extended to the windows of 10 words around
it, and these are compared with the items' windows as text, which settles it exactly. Items of fewer words are one window of
their own length. Every step makes rows in proportion to a text's words, whatever the text repeats.

Defined results: a null text has no words; words that stand in an item with a null identifier are hit, but the item
cannot be named and is not counted; items that share an identifier count as one; a repeated row is returned as often as
given; an empty documents table gives no rows, and with no items no document is hit. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bit_filter, filter_hits, fold_ascii, materialize, pinned

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Bytes of benchmark text up to which its kept hashes are broadcast; beyond, both joins are shuffled.
BROADCAST_BYTES = 8_000_000
#: Fixed value: what separates words, once A-Z are folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(text), SEPARATORS), "")


def grams(of: str, n: int) -> Column:
    """The hash of each run of n words; empty if there are fewer."""
    return F.expr(f"transform(if(size({of}) < {n}, array(), sequence(1, size({of}) - {n - 1})), i -> xxhash64(slice({of}, i, {n}), {n}))")


def winnowed(of: str) -> Column:
    """The smallest hash of each window, each once."""
    return F.expr(f"array_distinct(transform(if(size({of}) < {WINDOW}, array(), sequence(1, size({of}) - {WINDOW - 1})), i -> array_min(slice({of}, i, {WINDOW}))))")


def windows(of: str, n: int) -> Column:
    """Each run of n words as (place, span, run); empty if there are fewer. Words hold no space, so a run joined by spaces is unambiguous."""
    return F.expr(f"transform(if(size({of}) < {n}, array(), sequence(1, size({of}) - {n - 1})), i -> named_struct('place', i, 'span', {n}, 'run', array_join(slice({of}, i, {n}), ' ')))")


def item_tables(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The items' windows (run, span, item_id) and kept hashes (mark, span), each once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("item")).where(F.size("item") > 0)
    items = pinned(items, n=F.size("item"))
    full, short = items.where(F.col("n") >= SPAN), items.where(F.col("n") < SPAN)
    runs = full.select("item_id", F.explode(windows("item", SPAN)).alias("w")).select("w.run", "w.span", "item_id")
    runs = runs.unionByName(short.select(F.array_join("item", " ").alias("run"), F.col("n").alias("span"), "item_id"))
    marks = pinned(full, h=grams("item", GRAM)).select(F.explode(winnowed("h")).alias("mark"), F.lit(SPAN).alias("span"))
    marks = marks.unionByName(short.select(F.xxhash64("item", "n").alias("mark"), F.col("n").alias("span")))
    return materialize(runs.distinct(), "decontam-windows"), materialize(marks.distinct(), "decontam-marks")


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted), contaminated."""
    runs, marks = item_tables(benchmark, item_col, item_text_col)
    # every word of an item begins at most one window
    told = runs.agg(F.sum(F.length("run") / F.col("span") * 4), F.collect_set("span")).first()
    small, spans = (told[0] or 0) <= broadcast_bytes, sorted(told[1])
    short = [n for n in spans if n < SPAN]

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = texts.withColumn("twin", F.md5("body"))
    split = pinned(pinned(texts, words=words(F.col("body"))), h=grams("words", GRAM))
    kept = winnowed("h")
    for n in short:  # items of so many words are marked as a whole
        kept = F.concat(kept, grams("words", n))
    # one more mark, that of no text, brings each document through with its number of words
    every = pinned(split, n_words=F.size("words"), marks=F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(kept)))
    every = every.select("doc_id", "twin", "n_words", F.explode("marks").alias("mark")).withColumn("self", F.col("mark").isNull()).withColumn("mark", F.coalesce("mark", F.lit(0)))
    named = marks.select("mark").distinct().withColumn("self", F.lit(False))
    none = marks.sparkSession.range(1).select(F.lit(0).cast("long").alias("mark"), F.lit(True).alias("self"))
    if small:
        found = every.join(F.broadcast(named.unionByName(none)), ["mark", "self"])
        found = materialize(found.select("doc_id", "twin", "self", F.when(F.col("self"), F.col("n_words")).alias("n_words")), "decontam-found")
        told, hits = found.where("self").select("doc_id", "twin", "n_words"), found.where("not self")
    else:
        told = split.select("doc_id", "twin", F.size("words").alias("n_words"))
        hits = every.where("not self").select("doc_id", "twin", "mark").join(named.select("mark"), "mark", "left_semi")
    suspects = materialize(hits.select("doc_id", "twin").distinct(), "decontam-suspects")

    # the whole texts of the suspects, each once
    held = filter_hits(texts, bit_filter(suspects, "doc_id", "twin"), [F.col("doc_id"), F.col("twin")], "hit").where("hit")
    other = suspects.select(F.col("doc_id").alias("i"), F.col("twin").alias("t"))
    held = held.join(other, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("twin") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "twin"])
    held = pinned(pinned(held.select("doc_id", "twin", "body"), words=words(F.col("body"))).drop("body"), h=grams("words", GRAM))
    seeds = held.select("doc_id", "twin", "words", F.posexplode("h").alias("at", "mark")).join(_sized(marks.where(f"span = {SPAN}").select("mark"), small), "mark")
    around = F.expr(f"sequence(greatest(1, at + {2 - WINDOW}), least(at + 1, size(words) - {SPAN - 1}))")
    seeds = seeds.where(f"size(words) >= {SPAN}").select("doc_id", "twin", "words", F.explode(around).alias("place"))
    seen = seeds.select("doc_id", "twin", "place", F.lit(SPAN).alias("span"), F.expr(f"array_join(slice(words, place, {SPAN}), ' ')").alias("run")).distinct()
    for n in short:
        seen = seen.unionByName(held.select("doc_id", "twin", F.explode(windows("words", n)).alias("w")).select("doc_id", "twin", "w.place", "w.span", "w.run"))
    equal = seen.join(_sized(runs.select("run", "span").distinct(), small), ["run", "span"], "left_semi")
    equal = materialize(equal.select("doc_id", "twin", "place", "span", "run"), "decontam-equal")
    items = equal.select("doc_id", "twin", "run", "span").distinct().join(_sized(runs, small), ["run", "span"]).where("item_id is not null").select("doc_id", "twin", "item_id").distinct()

    blank = lambda kind: F.lit(None).cast(kind)
    piece = "struct<place:int,span:int>"
    rows = told.select("doc_id", "twin", "n_words", blank(piece).alias("piece"), blank("string").alias("item_id"))
    rows = rows.unionByName(equal.select("doc_id", "twin", blank("int").alias("n_words"), F.struct("place", "span").cast(piece).alias("piece"), blank("string").alias("item_id")))
    rows = rows.unionByName(items.select("doc_id", "twin", blank("int").alias("n_words"), blank(piece).alias("piece"), "item_id"))
    out = rows.groupBy("doc_id", "twin").agg(F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("piece")).alias("pieces"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    # words in at least one of the pieces, which are in order of place
    fold = "aggregate(pieces, named_struct('top', 0, 'n', 0L), (a, p) -> named_struct('top', greatest(a.top, p.place + p.span - 1), 'n', a.n + greatest(0, p.place + p.span - 1 - greatest(a.top, p.place - 1)))).n"
    out = out.withColumn("n_hit", F.expr(fold)).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
