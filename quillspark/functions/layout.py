"""Column functions over sizes, places and angles: anchors, headings, joins of runs, rotation, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much larger than the body a heading is, how large a bold one is at least, how close the sizes of one level are, levels.
HEADING, BOLD_HEADING, SAME_LEVEL, MAX_LEVEL = 1.15, 0.98, 0.94, 6
# The least and the greatest gap between runs of one word, in heights; the snap of an angle to a right one, in degrees.
JOIN_LOW, JOIN_HIGH, SNAP = -0.5, 0.25, 0.5


def _representatives(values: Column, starts) -> Column:
    """The values, in their order, at which `starts(value, last representative)` holds; the first always does."""
    empty = F.array().cast("array<double>")
    return F.aggregate(values, empty, lambda a, x: F.when((F.size(a) == 0) | starts(x, F.get(a, F.size(a) - 1)), F.array_append(a, x)).otherwise(a))


def anchors(values: Column, gap: Column) -> Column:
    """Left edges of columns: of ascending values those that lie more than gap beyond the anchor before them."""
    return _representatives(values, lambda x, last: x - last > gap)


def column_gap(median_height: Column) -> Column:
    return F.greatest(median_height * 2, F.lit(16.0))


def nearest_index(places: Column, x: Column) -> Column:
    """The index of the place nearest to x, the first of equals; null without places."""
    return F.array_min(F.transform(places, lambda a, i: F.struct(F.abs(x - a).alias("d"), i.alias("i"))))["i"]


def indent_level(reps: Column, x: Column) -> Column:
    """The nesting level of a marker at x, from 0: the last representative that is not right of it."""
    return F.size(F.filter(reps, lambda r: r <= x)) - 1


def is_heading_size(size: Column, bold: Column, body: Column) -> Column:
    return (size >= body * HEADING) | (bold & (size >= body * BOLD_HEADING))


def heading_sizes(sizes: Column) -> Column:
    """One size for each level: of descending sizes those below 94 % of the one before."""
    return _representatives(sizes, lambda x, last: (last <= 0) | (x < last * SAME_LEVEL))


def heading_level(levels: Column, size: Column) -> Column:
    """1 to 6 by the nearest of the levels' sizes; 1 if there is none."""
    return F.least(F.coalesce(nearest_index(levels, size), F.lit(0)) + 1, F.lit(MAX_LEVEL))


def runs_join(right: Column, x: Column, height: Column) -> Column:
    """Whether a run at x belongs to the word that ends at `right`."""
    tall, gap = F.greatest(height, F.lit(1.0)), x - right
    return (gap <= tall * JOIN_HIGH) & (gap >= tall * JOIN_LOW)


def rotation(angle: Column) -> Column:
    """A baseline's angle in (-180, 180], or 0, 90, 180 or 270 if it is within half a degree of one; no angle is 0."""
    a = angle % 360
    a = F.when(a > 180, a - 360).when(a <= -180, a + 360).otherwise(a)
    near = lambda target: F.abs(a - target) <= SNAP
    snapped = F.when(near(0), 0.0).when(near(90), 90.0).when(near(180) | near(-180), 180.0).when(near(-90), 270.0).otherwise(a)
    return F.when(angle.isNull() | F.isnan(angle) | (F.abs(angle) == float("inf")), 0.0).otherwise(snapped)


def cmyk_bytes(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Red, green and blue, 0 to 255, of inks from 0 to 1."""
    byte = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")
    return F.array(*[byte((1 - ink) * (1 - k)) for ink in (c, m, y)])
