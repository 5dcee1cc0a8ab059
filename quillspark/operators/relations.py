"""Joins and row edits that documents need: nearest, interval, overlap, as-of; insert, delete, move, patch; running furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Whether two boxes (x, y, w, h) share some area."""
    return F.expr(f"{a}.x < {b}.x + {b}.w and {b}.x < {a}.x + {a}.w and {a}.y < {b}.y + {b}.h and {b}.y < {a}.y + {a}.h")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], distance: Column, order: list[str], row: list[str]) -> DataFrame:
    """Each left row with the right row of the same keys that is nearest; `order` breaks ties."""
    w = Window.partitionBy(*row).orderBy(distance, *order)
    return left.join(right, keys).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def as_of(facts: DataFrame, starts: DataFrame, at: str, start: str, keys: list[str], take: list[str]) -> DataFrame:
    """facts with the columns `take` of the last start at or before each; by one window, without a range join."""
    told = starts.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__order"), F.struct(F.col(start).alias("__start"), *take).alias("__told"), F.lit(None).cast(facts.drop(*keys).select(F.struct("*").alias("s")).schema["s"].dataType).alias("__fact"))
    rows = facts.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__order"), F.lit(None).cast(told.schema["__told"].dataType).alias("__told"), F.struct(*[c for c in facts.columns if c not in keys]).alias("__fact"))
    w = Window.partitionBy(*keys).orderBy("__at", "__order").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(rows).withColumn("__told", F.last("__told", ignorenulls=True).over(w)).where("__order = 1")
    return both.select(*keys, "__fact.*", *[F.col(f"__told.{c}").alias(c) for c in take])


#: How many rows a task gets where a step holds several sorted copies of them.
TASK_ROWS = 300_000


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by its keys over as many tasks as its rows need, so that a task's memory does not grow with the input.

    Narrow rows of rising keys are a few bytes each in a shuffle, by which adaptive execution would put millions in a task.
    Counting the rows of a table reads none of its columns.
    """
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)


def renumber(df: DataFrame, keys: list[str], order: list[Column | str], out: str, start: int = 0) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start).cast("int"))


def move_row(df: DataFrame, keys: list[str], index: str, source: int, target: int) -> DataFrame:
    """df with the row at `source` moved to `target`, clamped, and the index renewed."""
    shift = 0.5 if target > source else -0.5
    place = F.when(F.col(index) == source, F.lit(target + shift)).otherwise(F.col(index).cast("double"))
    return renumber(df.withColumn("__place", place), keys, ["__place"], index).drop("__place")


def insert_gap(index: Column, at: int) -> Column:
    """The index after a row or column has been put in at `at`."""
    return F.when(index >= at, index + 1).otherwise(index)


def delete_gap(df: DataFrame, index: str, at: int) -> DataFrame:
    """df without the rows or columns at `at`, those after it moved up."""
    return df.where(F.col(index) != at).withColumn(index, F.when(F.col(index) > at, F.col(index) - 1).otherwise(F.col(index)))


def delete_spanned(df: DataFrame, keys: list[str], index: str, span: str, at: int) -> DataFrame:
    """delete_gap for cells that span several rows: those above `at` that reach over it get one shorter.

    A table (rows of the same keys) without a row `at` stays as it is, though a span may reach beyond its end.
    """
    there = F.max(index).over(Window.partitionBy(*keys)) >= at
    over = there & (F.col(index) < at) & (F.col(span) > at - F.col(index))
    return delete_gap(df.withColumn(span, F.when(over, F.col(span) - 1).otherwise(F.col(span))), index, at)


def restack(df: DataFrame, keys: list[str], index: str, at: int, to_front: bool) -> DataFrame:
    """df with the element at `at` drawn last (to_front) or first, and the index renewed; one that is not there moves nothing."""
    end = F.lit(float("inf") if to_front else float("-inf"))
    place = F.when(F.col(index) == at, end).otherwise(F.col(index).cast("double"))
    return renumber(df.withColumn("__place", place), keys, ["__place"], index).drop("__place")


def last_wins(patches: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """For each key the last value that any patch names, field by field."""
    return patches.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def patch(df: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """df with the fields that a patch names; a null leaves the old value."""
    new = patches.select(*keys, *[F.col(f).alias(f"__new_{f}") for f in fields])
    out = df.join(new, keys, "left")
    return out.withColumns({f: F.coalesce(F.col(f"__new_{f}"), F.col(f)) for f in fields}).drop(*[f"__new_{f}" for f in fields])


def strip_furniture(blocks: DataFrame, section: str, page: str, sig: str) -> tuple[DataFrame, DataFrame]:
    """What repeats on more than half the pages of a section, one representative of each, and the other blocks."""
    pages = blocks.groupBy(section).agg(F.countDistinct(page).alias("__pages")).where("__pages > 1")
    often = blocks.groupBy(section, sig).agg(F.countDistinct(page).alias("__n")).join(pages, section).where("2 * __n > __pages").select(section, sig)
    repeated = blocks.join(often, [section, sig], "left_semi").groupBy(section, sig).agg(F.countDistinct(page).alias("n_pages"))
    return repeated, blocks.join(often, [section, sig], "left_anti")


#: The share of a page's height, at its top and at its bottom, in which running furniture stands; and the tolerance at its edges.
BAND, SLACK = 0.12, 0.5


def band(y: Column, height: Column, page_height: Column) -> Column:
    """top or bottom if a block (y down, page top 0) lies wholly in that band of its page, else null."""
    low = y + height
    return F.when((y >= -SLACK) & (low <= BAND * page_height + SLACK), "top").when((y >= page_height - BAND * page_height - SLACK) & (low <= page_height + SLACK), "bottom")


def running_furniture(blocks: DataFrame, section: str, page: str, order: str, text: str, sig: Column, edge: Column) -> tuple[DataFrame, DataFrame]:
    """Headers and footers: what the bands of more than half the pages of a section hold, by signature, and the other blocks.

    The first result has section, edge, signature, n_pages and the text of the first page's block. A section of one page has none.
    """
    held = blocks.withColumns({"edge": edge, "signature": F.when(F.trim(F.col(text)) != "", sig)})
    pages = blocks.groupBy(section).agg(F.countDistinct(page).alias("__pages")).where("__pages > 1")
    banded = held.where("edge is not null and signature is not null")
    counted = banded.groupBy(section, "edge", "signature").agg(F.countDistinct(page).alias("n_pages"), F.min_by(text, F.struct(page, order)).alias("representative"))
    often = counted.join(pages, section).where("2 * n_pages > __pages").drop("__pages")
    return often, held.join(often.select(section, "edge", "signature"), [section, "edge", "signature"], "left_anti")
