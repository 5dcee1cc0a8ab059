"""Operators over ordered rows: clusters, sessions, islands, interval merges, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_islands(df: DataFrame, starts: Column, partition: list[str], order: list[str], out: str = "island") -> DataFrame:
    """df with the running count of rows where `starts` holds."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__starts", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(out, F.sum("__starts").over(w)).drop("__starts")


def gap_clusters(df: DataFrame, value: str, gap: Column, partition: list[str], tie: str) -> DataFrame:
    """df with `cluster`: a new one wherever the value leaves the one before it by more than gap."""
    w = Window.partitionBy(*partition).orderBy(value, tie)
    return number_islands(df.withColumn("__before", F.lag(value).over(w)), F.col(value) - F.col("__before") > gap, partition, [value, tie], "cluster").drop("__before")


def split_at_gaps(df: DataFrame, at: str, partition: list[str], tie: str, factor: float = 1.5) -> DataFrame:
    """df with `part`: a new one wherever a step exceeds factor times the group's median step."""
    w = Window.partitionBy(*partition).orderBy(at, tie)
    stepped = df.withColumn("__step", F.col(at) - F.lag(at).over(w))
    middle = stepped.groupBy(*partition).agg(F.expr("percentile(__step, 0.5)").alias("__middle"))
    joined = stepped.join(middle, partition)
    return number_islands(joined, F.col("__step") > factor * F.col("__middle"), partition, [at, tie], "part").drop("__step", "__middle")


def coalesce_runs(df: DataFrame, style: str, partition: list[str], order: list[str], text: str) -> DataFrame:
    """Adjacent rows of equal style as one, their texts joined by single spaces."""
    w = Window.partitionBy(*partition).orderBy(*order)
    islands = number_islands(df.withColumn("__last", F.lag(style).over(w)), F.col(style) != F.col("__last"), partition, order, "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))), lambda x: x["__text"]), " ")
    return islands.groupBy(*partition, "run", style).agg(F.count(F.lit(1)).alias("n_rows"), joined.alias("joined"))


def merge_intervals(df: DataFrame, low: str, high: str, partition: list[str], slack: float, tie: str) -> DataFrame:
    """Intervals that overlap, or lie within slack of each other, as one: partition, band, low, high, n."""
    w = Window.partitionBy(*partition).orderBy(low, tie)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bands = number_islands(df.withColumn("__reach", reach), F.col(low) - F.col("__reach") >= slack, partition, [low, tie], "band")
    return bands.groupBy(*partition, "band").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n"))


def uncovered_gaps(df: DataFrame, low: str, high: str, partition: list[str], least: float) -> DataFrame:
    """Stretches between intervals that none covers, at least so wide: partition, gap_low, gap_high, middle."""
    ends = df.select(*partition, F.col(low).alias("x"), F.lit(1).alias("d")).union(df.select(*partition, F.col(high), F.lit(-1)))
    steps = ends.groupBy(*partition, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*partition).orderBy("x")
    swept = steps.withColumn("cover", F.sum("d").over(w)).withColumn("next_x", F.lead("x").over(w))
    gaps = swept.where((F.col("cover") == 0) & (F.col("next_x") - F.col("x") >= least))
    return gaps.select(*partition, F.col("x").alias("gap_low"), F.col("next_x").alias("gap_high"), ((F.col("x") + F.col("next_x")) / 2).alias("middle"))


def ordinals_valid(df: DataFrame, ordinal: str, partition: list[str], order: str) -> DataFrame:
    """For each group whether its ordinals make a list: two or more, rising by 1 or 2, and from 1 on, or
    three or more by steps of 1."""
    w = Window.partitionBy(*partition).orderBy(order)
    steps = df.withColumn("__step", F.col(ordinal) - F.lag(ordinal).over(w))
    groups = steps.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.col("__step").between(1, 2)), F.lit(False)).alias("__rising"),
        F.coalesce(F.bool_and(F.col("__step") == 1), F.lit(False)).alias("__single"),
        F.min_by(ordinal, order).alias("__first"),
    )
    valid = (F.col("n") >= 2) & F.col("__rising") & ((F.col("__first") == 1) | (F.col("n") >= 3) & F.col("__single"))
    return groups.select(*partition, "n", valid.alias("valid"))


def cluster_edges(df: DataFrame, value: str, partition: list[str], slack: float = 3.0) -> DataFrame:
    """Each group's sorted values as clusters whose representative is the mean of it and each value that joins."""
    fold = f"""aggregate(array_sort(collect_list({value})), cast(array() as array<double>), (a, x) ->
        if(size(a) > 0 and x - a[size(a) - 1] <= {slack}, concat(slice(a, 1, size(a) - 1), array((a[size(a) - 1] + x) / 2)), array_append(a, x)))"""
    return df.groupBy(*partition).agg(F.expr(fold).alias("edges"))


def fold_outline(df: DataFrame, level: str, partition: list[str], index: str) -> DataFrame:
    """df with `depth` and `parent` (the index of the entry that it hangs under): a level deeper than the open path allows is clamped.

    `index` counts a group's entries from 0. A depth is at most one more than the depth before it, so depth minus index
    is the least of 0 and level minus index so far: a running minimum, without a loop.
    """
    w = Window.partitionBy(*partition).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col(index) + F.least(F.lit(0), F.min(F.col(level) - F.col(index)).over(w))
    rows = df.withColumn("__depth", depth.cast("int"))
    # Each entry stands twice: as itself, and, without what it carries, as the parent of those one deeper.
    twice = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    carried = [F.when(F.col("__own"), F.col(c)).alias(c) for c in df.columns if c not in (*partition, index)]
    marked = twice.select(*partition, index, *carried, "__own", F.when(F.col("__own"), F.col("__depth")).otherwise(F.col("__depth") + 1).alias("depth"))
    under = Window.partitionBy(*partition, "depth").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(~F.col("__own"), F.col(index)), ignorenulls=True).over(under)
    return marked.withColumn("parent", parent).where("__own").select(*df.columns, "depth", "parent")
