"""Running sums over ordered cells without a task per group: cells are cut into ranges, ranges are summed first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Ranges that a group's cells are cut into: each is sorted by itself.
RANGES = 64


def bucket_of(grid: str, value: str, most: int) -> tuple[F.Column, F.Column]:
    """How many elements of a sorted array column of at most `most` lie below a value: by blocks first (column _block), then inside one.

    Comparisons written out, so that they stay in generated code; higher-order functions are interpreted row by row.
    """
    width = math.isqrt(most - 1) + 1
    below = lambda at: f"coalesce(cast(get({grid}, {at}) < {value} as int), 0)"
    block = F.expr(" + ".join(below(i * width + width - 1) for i in range(width)))
    inside = F.expr(" + ".join(below(f"_block * {width} + {k}") for k in range(width)))
    return F.when(F.size(grid) > most, F.raise_error(F.lit("more thresholds than `most`")).cast("int")).otherwise(block), F.col("_block") * width + inside


def running_sums(cells: DataFrame, by: tuple[str, ...], order: str, sums: tuple[str, ...], ranges: int = RANGES) -> DataFrame:
    """cells (by, order, sums; one row per value of the numeric order column) with upto_x and total_x of every sum, and `next`, the value after the row's.

    The borders of a group's ranges are approximate quantiles of its cells: they only say which task sorts what.
    The table of ranges has at most `ranges` rows a group, and one window runs over these.
    """
    cells, keys = settled(cells), list(by)
    borders = cells.groupBy(*keys).agg(F.percentile_approx(order, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 1000).alias("_borders"))
    block, bucket = bucket_of("_borders", order, ranges)
    placed = _joined(cells, borders, keys).withColumn("_block", block).withColumn("_range", bucket).drop("_borders", "_block")
    parts = placed.groupBy(*keys, "_range").agg(*(F.sum(x).alias(f"_{x}") for x in sums), F.min(order).alias("_first"))
    per = Window.partitionBy(*(keys or [F.lit(0)]))
    before = per.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_range", F.lead("_first").over(per.orderBy("_range")).alias("_after"), *(F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_before_{x}") for x in sums), *(F.sum(f"_{x}").over(per).alias(f"total_{x}") for x in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    out = _joined(placed, parts, [*keys, "_range"])
    out = out.withColumns({**{f"upto_{x}": F.col(f"_before_{x}") + F.sum(x).over(inside) for x in sums}, "next": F.coalesce(F.lead(order).over(inside), F.col("_after"))})
    return out.drop("_range", "_after", *(f"_before_{x}" for x in sums))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    if not keys:
        return left.crossJoin(right)  # one row
    right = right.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    return left.join(right, on).drop(*(f"_of_{i}" for i in range(len(keys))))
