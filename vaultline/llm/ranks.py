"""Places of rows in their group's order, without a window over a group.

Rows are dealt by ranges of (group, order, row number) and sorted inside each
range, so a group of any size is spread over many tasks; the row number also
parts rows that are equal in everything else. The numbers of rows per (range,
group) are a small table: at most one row for each range and for each group.
Their running sums give the place of a range's first row in its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch

_ROW, _AT, _PART = "__rank_row", "__rank_at", "__rank_part"


def ranked(rows: DataFrame, group: str, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``r`` (place from 0 in its group) and ``n`` (rows of the
    group). ``group`` must not be null; equal rows get places in any order."""
    keys = [F.col(group), *order, F.col(_ROW)]
    dealt = (rows.withColumn(_ROW, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
             .withColumn(_AT, F.monotonically_increasing_id()))
    dealt = scratch.save(dealt.drop(_ROW).withColumn(_PART, F.shiftright(_AT, 33)), f"{name}-sorted")
    sizes = dealt.groupBy(_PART, group).agg(F.min(_AT).alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        _PART, group, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return dealt.join(sizes, [_PART, group]).withColumn("r", F.col(_AT) + F.col("shift")).drop(_PART, _AT, "shift")
