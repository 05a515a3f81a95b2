"""Gapless numbers inside keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut


def ordered_slots(df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in ascending order (null first), and count them in ``total``. Key values must not be null.

    Rows are sorted in ranges of keys and order over all tasks, rows alike in these by row
    number, so that neither a large key nor many equal rows meet in one task; a row's number is its
    place in the range and the number of rows of its key in the ranges before it.
    """
    place, tie, piece, first, count = _free(df, "place", "tie", "piece", "first", "count")
    ranges = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*keys, *order, tie).drop(tie)
    ranges = cut(ranges.withColumn(place, F.monotonically_increasing_id())).withColumn(piece, F.shiftright(place, 33))
    sizes = ranges.groupBy(*keys, piece).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(count))
    ahead = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    if total:
        sizes = sizes.withColumn(total, F.sum(count).over(Window.partitionBy(*keys)))
    sizes = sizes.withColumn(count, F.coalesce(F.sum(count).over(ahead), F.lit(0)))
    return ranges.join(sizes, [*keys, piece]).withColumn(out, F.col(place) - F.col(first) + F.col(count)).drop(place, piece, first, count)


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as the columns of ``df`` ask for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
