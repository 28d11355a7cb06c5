"""Ranks, running sums and islands over whole tables or very large groups, by range partitions.

Rows are sorted into range partitions once and written with their places. What precedes a partition is then a running sum over one
row for each partition (and group), the only thing that a window without keys ever sees. A key that repeats very often, or a
group of any size, spreads over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.tables import written


def by_ranges(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = ()) -> DataFrame:
    """``df`` in order, with _at (increasing along it) and _part, the partition; a written table. Rows that ``order`` cannot tell
    apart are in any order."""
    by = [*within, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return written(placed).withColumn("_part", F.shiftright("_at", 33))


def _ahead(within: Sequence[str]):
    """All earlier partitions of the same group; one row for each partition that a group reaches."""
    return Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """The rank from 1 in ``order``, over all rows or ``within`` equal values of columns that are not null."""
    at = by_ranges(df, order, within)
    held = at.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = held.select("_part", *within, (F.coalesce(F.sum("_n").over(_ahead(within)), F.lit(0)) - F.col("_first") + 1).alias("_before"))
    return at.join(before, ["_part", *within]).withColumn(name, F.col("_at") + F.col("_before")).select(*df.columns, name)


def running(df: DataFrame, order: Sequence[str | Column], value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """The sum of ``value`` over all rows before each row; 0 for the first."""
    at = by_ranges(df, order, within)
    held = at.groupBy("_part", *within).agg(F.sum(value).alias("_n"))
    before = held.select("_part", *within, F.coalesce(F.sum("_n").over(_ahead(within)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("_own", own).join(before, ["_part", *within]).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def islands(df: DataFrame, value: Column, delta, keys: Sequence[str], tie: str, name: str = "cluster") -> DataFrame:
    """``stitch.cluster_1d`` for keys of any number of rows: a new cluster starts where the gap to the next smaller value exceeds
    ``delta`` (a number or a column).

    The last value of a partition is carried to the next one of the same key, and so is the number of clusters opened before.
    """
    at = by_ranges(df.withColumn("_value", value), ["_value", tie], keys)
    along = Window.partitionBy("_part", *keys).orderBy("_at")
    carried = at.groupBy("_part", *keys).agg(F.max("_value").alias("_last")).select("_part", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carried"))
    before = F.coalesce(F.lag("_value").over(along), "_carried")
    opened = written(at.join(carried, ["_part", *keys]).withColumn("_opens", F.coalesce((F.col("_value") - before > delta).cast("int"), F.lit(0))))
    sums = opened.groupBy("_part", *keys).agg(F.sum("_opens").alias("_n")).select("_part", *keys, F.coalesce(F.sum("_n").over(_ahead(keys)), F.lit(0)).alias("_before"))
    own = F.sum("_opens").over(along)
    return opened.withColumn("_own", own).join(sums, ["_part", *keys]).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)
