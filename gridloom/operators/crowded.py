"""Suppression and anchor clusters of images with very many boxes: edges by grid cells, then rounds.

The folds of ``stitch`` walk the boxes of one image in one task. Here an image is spread over tasks. Boxes that touch meet in grid
cells; an edge runs from the box that is walked first to the one that it would suppress or take in. The boxes that the walk keeps
are those with no edge from a kept one. They are found in rounds: a box with no edge from a live box is kept, the boxes it has an
edge to are gone, and the edges of both fall away. A round handles the whole table at once; their number is the longest chain of
boxes that decide one another, not the number of boxes.

A cluster's anchors are found the same way, for a box that joins an anchor is none itself: it joins the first anchor with an edge
to it. Edges grow with the pairs that truly overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.boxes import INCLUSIVE, iou, short_side
from gridloom.operators.cells import CELL, meet
from gridloom.operators.stitch import CORNERS, _mean
from gridloom.sources.tables import dropped, written


def _walk(dets: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Boxes with their place in the walk, ``at``: score descending, then det_id."""
    at = F.struct((-F.col("score")).cast("double").alias("less"), F.col("det_id").cast("long").alias("det_id"))
    return dets.select(*keys, at.alias("at"), *(F.col(c).cast("double").alias(c) for c in CORNERS), "score", *extra)


def _edges(boxes: DataFrame, box: Sequence[Column | str], other: Sequence[Column | str], edge: Column, keys: Sequence[str], cell: float) -> DataFrame:
    """Rows (keys, hi, lo) of places in the walk: pairs (h_..., l_...) with an ``edge``; a written table."""
    sides = {s: boxes.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in boxes.columns if c not in keys)) for s in "hl"}
    met = meet(sides["h"], sides["l"], box, other, keys, cell).where((F.col("h_at") < F.col("l_at")) & edge)
    return written(met.select(*keys, F.col("h_at").alias("hi"), F.col("l_at").alias("lo")))


def outdone(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, at) of the boxes that a kept one has an edge to. ``edges`` is a written table."""
    live, gone = edges, edges.limit(0).select(*keys, F.col("lo").alias("at"))
    while True:
        held = live.select(*keys, F.col("lo").alias("hi")).distinct()
        free = live.select(*keys, "hi").distinct().join(held, [*keys, "hi"], "left_anti")
        now = written(live.join(free, [*keys, "hi"], "left_semi").select(*keys, "lo").distinct())
        if now.isEmpty():
            return gone
        gone = gone.unionByName(now.withColumnRenamed("lo", "at"))
        left = written(live.join(now, [*keys, "lo"], "left_anti").join(now.withColumnRenamed("lo", "hi"), [*keys, "hi"], "left_anti"))
        if live is not edges:
            dropped(live)
        live = left


def _overlap(most: float, mode: str, reach: bool) -> Column:
    value = iou(tuple(f"h_{c}" for c in CORNERS), tuple(f"l_{c}" for c in CORNERS), mode)
    return value >= most if reach else value > most


def _wide(mode: str) -> list[list[Column | str]]:
    """The rectangles that meet where two boxes can overlap; inclusive corners reach one pixel further."""
    more = 1 if mode == INCLUSIVE else 0
    return [[F.col(f"{s}_x1"), F.col(f"{s}_y1"), F.col(f"{s}_x2") + more, F.col(f"{s}_y2") + more] for s in "hl"]


def nms(dets: DataFrame, most: float, mode: str = INCLUSIVE, keys: Sequence[str] = ("image_id",), cell: int = CELL) -> DataFrame:
    """``stitch.nms`` for a number ``most`` of 0 or more, in rounds; (keys, det_id) is unique."""
    if most < 0:
        raise ValueError("boxes that do not overlap have no edge")
    boxes = _walk(dets, keys)
    edges = _edges(boxes, *_wide(mode), _overlap(most, mode, False), keys, cell)
    kept = boxes.join(outdone(edges, keys), [*keys, "at"], "left_anti")
    return kept.select(*keys, F.col("at.det_id").alias("det_id"), *CORNERS, "score")


def _members(boxes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``boxes`` (keys, at, ...) with det_id and the anchor that each joins."""
    gone = outdone(edges, keys)
    anchors = edges.join(gone.withColumnRenamed("at", "hi"), [*keys, "hi"], "left_anti")
    first = anchors.groupBy(*keys, F.col("lo").alias("at")).agg(F.min("hi").alias("anchor"))
    return boxes.join(first, [*keys, "at"], "left").withColumns({"det_id": F.col("at.det_id"), "anchor": F.coalesce("anchor.det_id", "at.det_id")})


def _clustered(dets: DataFrame, least: float, keys: Sequence[str], cell: int, merge: Callable) -> DataFrame:
    if not least > 0:
        raise ValueError("boxes that do not overlap have no edge")
    boxes = _walk(dets, keys)
    edges = _edges(boxes, *_wide(INCLUSIVE), _overlap(least, INCLUSIVE, True), keys, cell)
    return merge(_members(boxes, edges, keys), keys)


def merge_iou_avg(dets: DataFrame, least: float, keys: Sequence[str] = ("image_id",), cell: int = CELL) -> DataFrame:
    """``stitch.merge_iou_avg`` in rounds."""
    return _clustered(dets, least, keys, cell, _mean).select(*keys, "det_id", *CORNERS, "score")


def merge_minmax(dets: DataFrame, least: float, keys: Sequence[str] = ("image_id",), cell: int = CELL) -> DataFrame:
    """``stitch.merge_minmax`` in rounds."""

    def ends(members, keys):
        out = members.groupBy(*keys, "anchor").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("score").alias("score"))
        return out.withColumnRenamed("anchor", "det_id")

    return _clustered(dets, least, keys, cell, ends).select(*keys, "det_id", *CORNERS, "score")


def merge_center(dets: DataFrame, ratio: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``stitch.merge_center`` in rounds. The grid is measured in radii: a centre meets those in a square of two radii around it."""
    radius = dets.groupBy(*keys).agg((F.median(short_side(CORNERS)) * ratio).alias("radius"))
    boxes = written(_walk(dets.join(radius, list(keys)), keys, ["radius"]))

    def centre(s):
        return [(F.col(f"{s}_{c}1") / F.col(f"{s}_radius") + F.col(f"{s}_{c}2") / F.col(f"{s}_radius")) / 2 for c in "xy"]

    (hx, hy), (lx, ly) = centre("h"), centre("l")
    # a little more than a radius, so that rounding loses no pair; the edge decides
    square = [hx - 1.01, hy - 1.01, hx + 1.01, hy + 1.01]
    dx, dy = ((F.col(f"h_{c}1") / F.col("h_radius") + F.col(f"h_{c}2") / F.col("h_radius") - F.col(f"l_{c}1") / F.col("h_radius") - F.col(f"l_{c}2") / F.col("h_radius")) / 2 for c in "xy")
    edges = _edges(boxes.where("radius > 0"), square, [lx, ly, lx, ly], dx * dx + dy * dy <= 1.0, keys, 4)
    return _mean(_members(boxes.drop("radius"), edges, keys), keys).select(*keys, "det_id", *CORNERS, "score")
