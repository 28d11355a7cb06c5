"""Range joins of rectangles by grid cells.

Rectangles are dealt over the cells of a grid that they touch, and meet in cells; a pair counts only in the cell that holds the
top left corner of what it shares, so it comes out once. A join row is a pair within a cell: an image with very many rectangles
is spread over its cells instead of meeting all with all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 1024
Box = Sequence[str | Column]


def _columns(box: Box) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in box]


def dealt(df: DataFrame, box: Box, cell: int = CELL) -> DataFrame:
    """Each row once for each cell (_cx, _cy) that its closed rectangle touches. Rows with a null corner are in no cell."""
    x1, y1, x2, y2 = _columns(box)

    def span(low, high):
        first = F.floor(low / cell)
        return F.explode(F.sequence(first, F.greatest(first, F.floor(high / cell)), F.lit(1).cast("long")))

    held = df.where(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull())
    return held.withColumn("_cx", span(x1, x2)).withColumn("_cy", span(y1, y2))


def touch(a: Box, b: Box) -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = _columns(a), _columns(b)
    return (ax1 <= bx2) & (bx1 <= ax2) & (ay1 <= by2) & (by1 <= ay2)


def meet(left: DataFrame, right: DataFrame, a: Box, b: Box, on: Sequence[str] = ("image_id",), cell: int = CELL) -> DataFrame:
    """The pairs of rows whose closed rectangles touch, each once. The frames share no columns but those of ``on``."""
    first = [F.floor(F.greatest(p, q) / cell) for p, q in zip(_columns(a)[:2], _columns(b)[:2], strict=True)]
    pairs = dealt(left, a, cell).join(dealt(right, b, cell), [*on, "_cx", "_cy"])
    return pairs.where(touch(a, b) & (F.col("_cx") == first[0]) & (F.col("_cy") == first[1])).drop("_cx", "_cy")


def touched(left: DataFrame, right: DataFrame, a: Box, b: Box, keys: Sequence[str], on: Sequence[str] = ("image_id",), cell: int = CELL) -> DataFrame:
    """The different ``keys`` of the rows of ``left`` that some row of ``right`` touches. A cell lets a row through once at most."""
    other = dealt(right.select(*on, *(c.alias(n) for c, n in zip(_columns(b), ("_bx1", "_by1", "_bx2", "_by2"), strict=True))), ("_bx1", "_by1", "_bx2", "_by2"), cell)
    mine = dealt(left, a, cell)
    here = mine.select(*keys, *(c for c in on if c not in keys), "_cx", "_cy", *(c.alias(n) for c, n in zip(_columns(a), ("_ax1", "_ay1", "_ax2", "_ay2"), strict=True))).alias("l")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*on, "_cx", "_cy")]
    near = touch(("_ax1", "_ay1", "_ax2", "_ay2"), ("_bx1", "_by1", "_bx2", "_by2"))
    for s in same:
        near = near & s
    return here.join(other.alias("r"), near, "left_semi").select(*keys).distinct()
